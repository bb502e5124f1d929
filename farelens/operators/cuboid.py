"""The base cuboid: one mergeable state table that the reports re-aggregate.

``build_states`` reduces enriched trips to one row per (date, platform,
pickup and drop-off location id, hour, distance bands, airport flag, whether
the pay-floor test applies) with counts, LONG sums, digit sums of squares and
extremes.  Everything a report needs beyond these keys is additive, so
states of several loads merge by another sum, in any order, and a report
over states equals the report over trips digit for digit: all parts are
integers, and rounding happens once, in the report.

The cuboid is keyed by location id, not by name: the zone lookup meets
states, or even states grouped further, and never a trip.

A state table is small where trips repeat their keys; its size is at most
the number of trips, so it is never broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.functions.exact import SQUARE_DIGITS, SUM_DIGITS, add_digits, square_digits, sum_digits
from farelens.operators.enrich import hour_bucket, with_zone_names
from farelens.params import Params
from farelens.plans import _common as m
from farelens.sources.zones import prepare_zones

KEYS = (
    "trip_date",
    "company_name",
    "PULocationID",
    "DOLocationID",
    "hour",
    "pay_band",
    "congestion_band",
    "is_airport_trip",
    "pay_tested",
)
#: DECIMAL measures that reports sum or average, and 0/1 columns.
AMOUNTS = (
    "base_passenger_fare",
    "tolls",
    "bcf",
    "sales_tax",
    "congestion_surcharge",
    "airport_fee",
    "cbd_congestion_fee",
    "tips",
    "driver_pay",
    "passenger_total_charge",
    "total_congestion_fees",
    "platform_spread",
    "fare_per_mile",
    "driver_pay_per_hour",
    "trip_miles",
    "trip_min",
    "request_to_pickup_min",
)
MARKS = ("sla_5min_met", "below_tlc_minimum")
FARE = "base_passenger_fare"


#: The keys that a report needs when its states are made for it alone (``eager_report``).
REPORT_KEYS = {
    "borough_demand": ("company_name", "PULocationID"),
    "top_corridors": ("PULocationID", "DOLocationID"),
    "zone_opportunity": ("PULocationID", "pay_tested"),
}


def _keys(params: Params) -> dict[str, Column]:
    made = {
        "hour": F.hour("pickup_datetime"),
        "pay_band": m.pay_band(params),
        "congestion_band": m.congestion_band(params),
        "pay_tested": F.col("below_tlc_minimum").isNotNull(),
    }
    return {key: made.get(key, F.col(key)).alias(key) for key in KEYS}


def build_states(enriched: DataFrame, params: Params, keys: Sequence[str] = KEYS) -> DataFrame:
    """Trips to states, one partial and one final aggregation; sums that no report above reads are pruned."""
    aggs = [m.trips().alias("n")]
    for name in AMOUNTS:
        aggs += [m.usum(name).alias(f"s_{name}"), m.count_of(name).alias(f"c_{name}")]
    for name in MARKS:
        aggs += [m.int_sum(name).alias(f"s_{name}"), m.count_of(name).alias(f"c_{name}")]
    aggs += [m.flag_count(flag).alias(f"f_{flag}") for flag in m.FLAGS]
    aggs += [F.expr(f"SUM({sql})").alias(f"s_{name}") for name, sql in m.DUE_PARTS.items()]
    aggs += [F.min(FARE).alias(f"min_{FARE}"), F.max(FARE).alias(f"max_{FARE}")]
    aggs += [sum_digits(m.units(FARE)).alias(f"digits_{FARE}"), square_digits(m.units(FARE)).alias(f"squares_{FARE}")]
    made = _keys(params)
    return enriched.groupBy(*[made[key] for key in keys]).agg(*aggs)


def _merge(name: str) -> Column:
    if name.startswith("digits_"):
        return add_digits(F.col(name), SUM_DIGITS).alias(name)
    if name.startswith("squares_"):
        return add_digits(F.col(name), SQUARE_DIGITS).alias(name)
    if name.startswith("min_"):
        return F.min(name).alias(name)
    return (F.max(name) if name.startswith("max_") else F.sum(name)).alias(name)


def merge_states(states: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """States of several loads (unioned), or states on fewer keys, as one row per key."""
    return states.groupBy(*keys).agg(*[_merge(name) for name in states.columns if name not in KEYS])


def state_relation(states: DataFrame, zones: DataFrame, params: Params) -> DataFrame:
    """States under the column names that reports group and filter by; lookups that a report never reads drop out."""
    # Keys that states made for one report lack stand as NULL: that report does not read them.
    missing = {key: F.lit(None).cast("int") for key in ("PULocationID", "DOLocationID", "hour") if key not in states.columns}
    tested = F.col("pay_tested") if "pay_tested" in states.columns else F.lit(True)
    named = with_zone_names(states.withColumns(missing) if missing else states, prepare_zones(zones, params.max_broadcast_rows))
    # Reports test the flag for NULL only; its counts are f_underpaid and s_/c_below_tlc_minimum.
    flag = F.when(tested, F.lit(0)).alias("below_tlc_minimum")
    return named.select("*", hour_bucket(F.col("hour"), params).alias("time_of_day"), flag)


def report_from_states(report: Callable, states: DataFrame, zones: DataFrame, params: Params) -> DataFrame:
    """A report of ``farelens.plans`` over states in place of trips (all but the per-trip ones: P4 and W3)."""
    relation = state_relation(states, zones, params)
    with m.over_states():
        return report(relation, params)


def eager_report(report: Callable, enriched: DataFrame, zones: DataFrame, params: Params) -> DataFrame:
    """A report of REPORT_KEYS with its sums taken by location id first, below the zone lookup, and again by name above."""
    return report_from_states(report, build_states(enriched, params, REPORT_KEYS[report.__name__]), zones, params)
