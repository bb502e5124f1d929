"""Measure builders shared by the reports (M1-M39 in Column form)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.functions.exact import (
    SQUARE_DIGITS,
    SUM_DIGITS,
    add_digits,
    dec,
    moment_aggs,
    rate_scale,
    ratio_cmp,
    round_ratio,
    to_units,
)
from farelens.functions.exact_sql import q, round_ratio_sql, units_sql
from farelens.functions.ladders import band
from farelens.params import Params

c = F.col

# Fraction digits of the enriched DECIMAL columns that reports sum; money
# and rounded rates have 2.  Sums run over LONG units (primitive adds),
# and each group's result is rounded once, exactly, after aggregation.
UNIT_SCALE = {"trip_miles": 3}


def unit_scale(name: str) -> int:
    return UNIT_SCALE.get(name, 2)


def units(name: str) -> Column:
    """Per-row LONG units of an enriched DECIMAL column."""
    return to_units(c(name), unit_scale(name))


# --- where a report's aggregates come from ---------------------------------
#
# A report aggregates trips, or the rows of a state table (operators/cuboid.py)
# that already hold sums of trips.  The builders below are the only ones that
# touch per-trip columns inside an aggregate, so the same report text serves
# both; ``over_states`` switches them while a report's plan is built.

_OVER_STATES: ContextVar[bool] = ContextVar("over_states", default=False)


@contextmanager
def over_states() -> Iterator[None]:
    token = _OVER_STATES.set(True)
    try:
        yield
    finally:
        _OVER_STATES.reset(token)


def from_states() -> bool:
    return _OVER_STATES.get()


#: Conditions that reports count, by the name of their state column.
FLAGS = {
    "negative_take": "`take_rate_pct` < 0",
    "underpaid": "`below_tlc_minimum` = 1",
    "congested": "`total_congestion_fees` > 0",
    "cbd": "`cbd_congestion_fee` > 0",
    "wav_request": "`wav_request_flag` = 'Y'",
    "wav_match": "`wav_match_flag` = 'Y'",
    "shared_request": "`shared_request_flag` = 'Y'",
}


def rows_sql() -> str:
    return "SUM(`n`)" if from_states() else "COUNT(1)"


def usum_sql(name: str) -> str:
    return f"SUM({q('s_' + name)})" if from_states() else f"SUM({units_sql(name, unit_scale(name))})"


def int_sum_sql(name: str) -> str:
    return f"SUM({q('s_' + name)})" if from_states() else f"SUM({q(name)})"


def count_sql(name: str) -> str:
    return f"SUM({q('c_' + name)})" if from_states() else f"COUNT({q(name)})"


def flag_sql(flag: str) -> str:
    return f"SUM({q('f_' + flag)})" if from_states() else f"SUM(CASE WHEN {FLAGS[flag]} THEN 1 ELSE 0 END)"


def usum(name: str) -> Column:
    """SUM of a DECIMAL column in LONG units."""
    return F.expr(usum_sql(name))


def flag_count(flag: str) -> Column:
    """Number of trips for which a condition of FLAGS holds."""
    return F.expr(flag_sql(flag)).cast("long")


def int_sum(name: str) -> Column:
    return F.expr(int_sum_sql(name))


def count_of(name: str) -> Column:
    return F.expr(count_sql(name))


def least(name: str) -> Column:
    return F.min(f"min_{name}" if from_states() else name)


def most(name: str) -> Column:
    return F.max(f"max_{name}" if from_states() else name)


def moments(name: str, prefix: str) -> list[Column]:
    """count, digit sums of x and of x * x of a DECIMAL column (``functions.exact``)."""
    if not from_states():
        return moment_aggs(units(name), prefix)
    return [
        count_of(name).alias(f"{prefix}_n"),
        add_digits(c(f"digits_{name}"), SUM_DIGITS).alias(f"{prefix}_s"),
        add_digits(c(f"squares_{name}"), SQUARE_DIGITS).alias(f"{prefix}_ss"),
    ]


def _ratio(num: str, den: str, scale: int) -> Column:
    return F.expr(round_ratio_sql(num, den, scale))


def section(params: Params, key: str) -> Column:
    return F.lit(params.sections[key]).alias("section")


def trips() -> Column:
    """M1: COUNT(*)."""
    return F.expr(rows_sql())


def negative_take_flag() -> Column:
    """1 when the per-trip take rate is negative; NULL rates count as 0."""
    return F.when(c("take_rate_pct") < 0, 1).otherwise(0)


def negative_take_pct() -> Column:
    """M3: SUM(rate < 0) * 100 / COUNT(*) at 2 dp (NULL rates count as not negative)."""
    return _ratio(f"{flag_sql('negative_take')} * 100", rows_sql(), 2)


def sum_take_rate() -> Column:
    """M2: (SUM(fare) - SUM(pay)) / NULLIF(SUM(fare), 0) * 100 at 2 dp."""
    fare, pay = usum_sql("base_passenger_fare"), usum_sql("driver_pay")
    return _ratio(f"({fare} - {pay}) * 100", fare, 2)


def sla_pct() -> Column:
    """ROUND(AVG(sla_5min_met) * 100, 2)."""
    return _ratio(f"{int_sum_sql('sla_5min_met')} * 100", count_sql("sla_5min_met"), 2)


def sla_below(k) -> Column:
    """Unrounded AVG(sla_5min_met) * 100 < k."""
    return ratio_cmp(int_sum("sla_5min_met") * 100, count_of("sla_5min_met"), "<", k)


def _rate_units(rate, k: int) -> int:
    return int(Decimal(str(rate)).scaleb(k))


def due_scale(params: Params) -> int:
    """Fraction digits of the legal-minimum amount: miles (3) + rate digits."""
    return 3 + rate_scale(params.pay_per_mile, params.pay_per_minute)


#: LONG parts of the legal minimum and the shortfall, per trip; rated: both factors known, violating: rated and underpaid.
_RATED = "`trip_miles` IS NOT NULL AND `trip_min` IS NOT NULL"
_VIOLATES = f"`below_tlc_minimum` = 1 AND {_RATED} AND `driver_pay` IS NOT NULL"
DUE_PARTS = {
    "due_miles": f"CASE WHEN {_RATED} THEN {units_sql('trip_miles', 3)} END",
    "due_minutes": f"CASE WHEN {_RATED} THEN {units_sql('trip_min', 2)} END",
    "short_miles": f"CASE WHEN {_VIOLATES} THEN {units_sql('trip_miles', 3)} END",
    "short_minutes": f"CASE WHEN {_VIOLATES} THEN {units_sql('trip_min', 2)} END",
    "short_pay": f"CASE WHEN {_VIOLATES} THEN {units_sql('driver_pay', 2)} END",
    "short_trips": f"CASE WHEN {_VIOLATES} THEN 1L END",
}


def _part(name: str) -> Column:
    return F.expr(f"SUM({q('s_' + name) if from_states() else DUE_PARTS[name]})").cast("decimal(20,0)")


def _due_total(params: Params, kind: str) -> Column:
    """SUM(miles * per_mile + trip_min * per_minute) in 10^-due_scale units, as DECIMAL.

    Miles and minutes are summed apart as LONGs and meet their rates once a group, so no per-trip product is summed.
    """
    k = due_scale(params) - 3
    miles = _part(f"{kind}_miles") * dec(_rate_units(params.pay_per_mile, k))
    minutes = _part(f"{kind}_minutes") * dec(10 * _rate_units(params.pay_per_minute, k))
    return miles + minutes


def mean_due(params: Params) -> Column:
    """ROUND(AVG(miles * per_mile + trip_min * per_minute), 2)."""
    return round_ratio(_due_total(params, "due"), trips().cast("decimal(20,0)") * dec(10 ** due_scale(params)), 2)


def mean_shortfall(params: Params) -> Column:
    """Mean of (due - pay) over violating trips, 2 dp; NULL when there are none."""
    gap = _due_total(params, "short") - _part("short_pay") * dec(10 ** (due_scale(params) - 2))
    return round_ratio(gap, _part("short_trips") * dec(10 ** due_scale(params)), 2)


def pay_band(params: Params) -> Column:
    return c("pay_band") if from_states() else band(c("trip_miles"), params.pay_distance_bands, params.pay_distance_rest)


def congestion_band(params: Params) -> Column:
    return c("congestion_band") if from_states() else band(c("trip_miles"), params.congestion_distance_bands, params.congestion_distance_rest)


def share_of_charge(*names: str) -> Column:
    """(AVG(x) [+ AVG(y) ...]) / NULLIF(AVG(passenger_total_charge), 0) * 100 at 1 dp.

    Means over the same rows, so the ratio of sums in cents is exact.
    """
    num = " + ".join(usum_sql(n) for n in names)
    return _ratio(f"({num}) * 100", usum_sql("passenger_total_charge"), 1)


def pct_where(flag: str, scale: int = 2) -> Column:
    """ROUND(SUM(CASE WHEN flag THEN 1 ELSE 0 END) * 100 / COUNT(*), scale); ``flag`` is a name of FLAGS."""
    return _ratio(f"{flag_sql(flag)} * 100", rows_sql(), scale)


def pct_mean_of(name: str, scale: int = 2) -> Column:
    """ROUND(AVG(flag) * 100, scale) of a 0/1 column, NULLs skipped."""
    return _ratio(f"{int_sum_sql(name)} * 100", count_sql(name), scale)


def money_total(col: str) -> Column:
    """ROUND(SUM(col), 0)."""
    return _ratio(usum_sql(col), "100", 0)


def avg(col: str, scale: int = 2) -> Column:
    """ROUND(AVG(col), scale), NULLs skipped, from the exact LONG sum."""
    return _ratio(usum_sql(col), f"{count_sql(col)} * {10 ** unit_scale(col)}", scale)


def with_section(df: DataFrame, params: Params, key: str) -> DataFrame:
    return df.select(section(params, key), "*")
