"""Daily revenue trend and the holiday demand cliff."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farelens.functions.exact import round_ratio
from farelens.functions.ladders import ladder
from farelens.operators.extremes import peak_and_trough
from farelens.params import EVE_DAYS, PEAK_DAY_LABEL, RECOVERY_DAY, TROUGH_DAY, Params
from farelens.plans._common import avg, c, money_total, section, sla_pct, sum_take_rate, trips


DAILY_COLUMNS = (
    "daily_trips",
    "daily_base_revenue",
    "daily_total_revenue",
    "daily_margin",
    "avg_base_fare",
    "avg_take_rate_pct",
    "sla_5min_pct",
)


def daily_measures() -> list:
    """Aggregates of one (day, platform) cell, named as DAILY_COLUMNS."""
    return [
        trips().alias("daily_trips"),
        money_total("base_passenger_fare").alias("daily_base_revenue"),
        money_total("passenger_total_charge").alias("daily_total_revenue"),
        money_total("platform_spread").alias("daily_margin"),
        avg("base_passenger_fare").alias("avg_base_fare"),
        sum_take_rate().alias("avg_take_rate_pct"),
        sla_pct().alias("sla_5min_pct"),
    ]


def daily_revenue(enriched: DataFrame) -> DataFrame:
    """One row per (day, platform): the shared CTE of both reports."""
    return enriched.groupBy("trip_date", "company_name").agg(*daily_measures())


def daily_revenue_trend(enriched: DataFrame, params: Params) -> DataFrame:
    return trend_from_daily(daily_revenue(enriched), params)


def trend_from_daily(daily: DataFrame, params: Params) -> DataFrame:
    """P8a's windows and labels over a daily table (of trips, or of published day states)."""
    # W4-W7 run over days per platform (after the trip-scale aggregation).
    by_day = Window.partitionBy("company_name").orderBy("trip_date")
    last7 = by_day.rowsBetween(-6, Window.currentRow)
    to_date = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_rev = Window.partitionBy("company_name").orderBy(F.desc("daily_base_revenue"))
    rev = c("daily_base_revenue")
    prev = F.lag(rev).over(by_day)
    rank = F.rank().over(by_rev)
    month, day = F.month("trip_date"), F.dayofmonth("trip_date")
    with_windows = daily.select(
        "*",
        prev.alias("prev_day_revenue"),
        round_ratio(F.sum(rev).over(last7), F.count(rev).over(last7), 0).alias("rolling_7day_avg"),
        F.sum(rev).over(to_date).alias("cumulative_revenue"),
        rank.alias("revenue_rank"),
    )
    trough_day, trough_label = TROUGH_DAY
    recovery_day, recovery_label = RECOVERY_DAY
    eve_days, eve_label = EVE_DAYS
    holiday = month == params.holiday_month
    p = c("prev_day_revenue")
    out = with_windows.select(
        section(params, "daily_revenue_trend"),
        "trip_date",
        "company_name",
        "daily_trips",
        "daily_base_revenue",
        "daily_total_revenue",
        "daily_margin",
        "avg_base_fare",
        "avg_take_rate_pct",
        "sla_5min_pct",
        "prev_day_revenue",
        F.when(p.isNotNull() & (p > 0), round_ratio((rev - p) * 100, p, 1)).alias("dod_change_pct"),
        "rolling_7day_avg",
        "cumulative_revenue",
        "revenue_rank",
        ladder(
            [
                (c("revenue_rank") == 1, PEAK_DAY_LABEL),
                (holiday & (day == trough_day), trough_label),
                (holiday & (day == recovery_day), recovery_label),
                (holiday & day.isin(*eve_days), eve_label),
            ],
            F.lit(None).cast("string"),
        ).alias("day_label"),
    )
    return out.orderBy("company_name", "trip_date")


def peak_vs_trough(enriched: DataFrame, params: Params) -> DataFrame:
    daily = enriched.groupBy("trip_date", "company_name").agg(
        money_total("base_passenger_fare").alias("daily_base_revenue"),
    )
    return peak_from_daily(daily, params)


def peak_from_daily(daily: DataFrame, params: Params) -> DataFrame:
    """P8b over a daily table."""
    pt = peak_and_trough(daily, "company_name", "trip_date", "daily_base_revenue")
    peak, trough = c("peak_daily_base_revenue"), c("trough_daily_base_revenue")
    return pt.select(
        section(params, "peak_vs_trough"),
        "company_name",
        c("peak_trip_date").alias("peak_date"),
        peak.alias("peak_revenue"),
        c("trough_trip_date").alias("trough_date"),
        trough.alias("trough_revenue"),
        round_ratio((trough - peak) * 100, peak, 1).alias("cliff_pct"),
        round_ratio(peak, trough, 2).alias("peak_to_trough_ratio"),
    ).orderBy("company_name")
