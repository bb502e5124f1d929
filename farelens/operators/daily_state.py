"""P8 over a growing relation: one state per date and platform, replaced when a date is published again.

A load of trips is reduced to additive sums per (date, platform), the columns
that the daily measures need, and published with its dates under a manifest.
The trend and the peak / trough report then read states only, never the trip
history.  A date that arrives late, or again with corrections, replaces its
state and nothing else, whatever the order of loads; there is no watermark
behind which a trip is dropped.

A load must hold all trips of the dates it publishes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from farelens.params import Params
from farelens.plans import _common as m
from farelens.plans.holiday import daily_measures, peak_from_daily, trend_from_daily
from farelens.sources import manifest

AMOUNTS = ("base_passenger_fare", "passenger_total_charge", "platform_spread", "driver_pay")
MARK = "sla_5min_met"


def day_states(enriched: DataFrame) -> DataFrame:
    """(trip_date, company_name) -> trips, LONG sums and counts."""
    aggs = [m.trips().alias("n"), m.int_sum(MARK).alias(f"s_{MARK}"), m.count_of(MARK).alias(f"c_{MARK}")]
    for name in AMOUNTS:
        aggs += [m.usum(name).alias(f"s_{name}"), m.count_of(name).alias(f"c_{name}")]
    return enriched.groupBy("trip_date", "company_name").agg(*aggs)


def publish_days(enriched: DataFrame, path: str, covers: Iterable[str] = ()) -> None:
    """Publish the states of the load's dates, in place of what these dates had; ``covers``: also dates left empty."""
    rows = day_states(enriched).hint("rebalance", "trip_date")
    manifest.publish(enriched.sparkSession, path, lambda folder: rows.write.partitionBy("trip_date").parquet(folder), "trip_date", True, covers)


def daily_table(spark: SparkSession, path: str) -> DataFrame:
    """The daily measures of all published dates."""
    with m.over_states():
        measures = daily_measures()
    return manifest.read(spark, path).groupBy("trip_date", "company_name").agg(*measures)


def trend(spark: SparkSession, path: str, params: Params) -> DataFrame:
    """P8a over the published days."""
    return trend_from_daily(daily_table(spark, path), params)


def peak_vs_trough(spark: SparkSession, path: str, params: Params) -> DataFrame:
    """P8b over the published days."""
    return peak_from_daily(daily_table(spark, path), params)
