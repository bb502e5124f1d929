"""Borough demand and service status by time of day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farelens.functions.ladders import category_position, ladder
from farelens.params import SERVICE_STATUS, Params
from farelens.plans._common import avg, c, negative_take_pct, section, sla_below, sla_pct, sum_take_rate, trips


def borough_demand(enriched: DataFrame, params: Params) -> DataFrame:
    g = (
        enriched.where(c("pu_borough").isNotNull())
        .groupBy(c("pu_borough").alias("borough"), "company_name")
        .agg(
            trips().alias("total_trips"),
            avg("base_passenger_fare").alias("avg_base_fare"),
            avg("passenger_total_charge").alias("avg_total_charge"),
            avg("driver_pay").alias("avg_driver_pay"),
            sum_take_rate().alias("avg_take_rate_pct"),
            avg("trip_miles").alias("avg_miles"),
            avg("fare_per_mile").alias("avg_fare_per_mile"),
            avg("request_to_pickup_min").alias("avg_wait_min"),
            sla_pct().alias("sla_5min_pct"),
            negative_take_pct().alias("negative_take_rate_pct"),
        )
    )
    # W2 over grouped rows (boroughs per platform).
    w = Window.partitionBy("company_name").orderBy(F.desc("total_trips"))
    return g.select(
        section(params, "borough_demand"), "*", F.rank().over(w).alias("volume_rank_within_platform")
    ).orderBy("company_name", F.desc("total_trips"), "borough")


def borough_time_demand(enriched: DataFrame, params: Params) -> DataFrame:
    (under, under_label), (risk, risk_label), fallback = SERVICE_STATUS
    g = (
        enriched.where(c("pu_borough").isNotNull())
        .groupBy(c("pu_borough").alias("borough"), "time_of_day", "company_name")
        .agg(
            trips().alias("total_trips"),
            avg("base_passenger_fare").alias("avg_base_fare"),
            avg("passenger_total_charge").alias("avg_total_charge"),
            avg("driver_pay").alias("avg_driver_pay"),
            sum_take_rate().alias("avg_take_rate_pct"),
            avg("request_to_pickup_min").alias("avg_wait_min"),
            sla_pct().alias("sla_5min_pct"),
            ladder([(sla_below(under), under_label), (sla_below(risk), risk_label)], fallback).alias(
                "service_status"
            ),
        )
    )
    return g.select(section(params, "borough_time_demand"), "*").orderBy(
        "borough", "company_name", category_position(c("time_of_day"), params.time_bucket_order), "time_of_day"
    )
