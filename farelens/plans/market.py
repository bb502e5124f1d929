"""Platform scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farelens.functions.exact import round_ratio
from farelens.params import Params
from farelens.plans._common import avg, c, money_total, negative_take_pct, pct_where, sla_pct, sum_take_rate, trips


def market_position(enriched: DataFrame, params: Params) -> DataFrame:
    per_platform = enriched.groupBy("company_name").agg(
        trips().alias("total_trips"),
        avg("base_passenger_fare").alias("avg_base_fare"),
        avg("passenger_total_charge").alias("avg_total_charge"),
        avg("driver_pay").alias("avg_driver_pay"),
        avg("tips").alias("avg_tip"),
        avg("driver_pay_per_hour").alias("avg_driver_hourly"),
        sum_take_rate().alias("avg_take_rate_pct"),
        avg("platform_spread").alias("avg_platform_spread"),
        negative_take_pct().alias("negative_take_rate_pct"),
        avg("trip_miles").alias("avg_trip_miles"),
        avg("trip_min").alias("avg_trip_min"),
        avg("fare_per_mile").alias("avg_fare_per_mile"),
        avg("request_to_pickup_min").alias("avg_wait_min"),
        sla_pct().alias("sla_5min_pct"),
        pct_where("underpaid", 2).alias("below_tlc_min_pct"),
        money_total("base_passenger_fare").alias("total_base_revenue"),
        money_total("passenger_total_charge").alias("total_charge_revenue"),
        money_total("platform_spread").alias("total_platform_margin"),
    )
    # The share window runs over one row per platform (bounded by the
    # platform map), never over trips.
    everyone = Window.partitionBy()
    share = round_ratio(c("total_trips") * 100, F.sum("total_trips").over(everyone), 2)
    cols = per_platform.columns
    out = per_platform.select(*cols[:2], share.alias("market_share_pct"), *cols[2:])
    return out.orderBy(F.desc("total_trips"), "company_name")
