"""Origin-destination corridors, airport split, borough matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.functions.ladders import airport_label
from farelens.params import AIRPORT_LABEL, NON_AIRPORT_LABEL, Params
from farelens.plans._common import avg, c, money_total, section, sla_pct, sum_take_rate, trips


def top_corridors(enriched: DataFrame, params: Params) -> DataFrame:
    g = (
        enriched.where(c("pu_borough").isNotNull() & c("do_borough").isNotNull())
        .groupBy(
            c("pu_borough").alias("origin_borough"),
            c("pu_zone").alias("origin_zone"),
            c("do_borough").alias("dest_borough"),
            c("do_zone").alias("dest_zone"),
        )
        .agg(
            trips().alias("total_trips"),
            avg("base_passenger_fare").alias("avg_base_fare"),
            avg("passenger_total_charge").alias("avg_total_charge"),
            avg("driver_pay").alias("avg_driver_pay"),
            sum_take_rate().alias("take_rate_pct"),
            avg("trip_miles").alias("avg_miles"),
            avg("fare_per_mile").alias("avg_fare_per_mile"),
            sla_pct().alias("sla_5min_pct"),
            avg("request_to_pickup_min").alias("avg_wait_min"),
            money_total("base_passenger_fare").alias("total_base_revenue"),
        )
        .where(c("total_trips") >= params.min_trips_corridor)
    )
    out = g.select(
        section(params, "top_corridors"),
        "origin_borough",
        "origin_zone",
        "dest_borough",
        "dest_zone",
        F.concat(c("origin_borough"), F.lit(" to "), c("dest_borough")).alias("corridor"),
        *g.columns[4:],
    )
    # Top-k: Spark plans TakeOrderedAndProject (per-partition top-k, then merge).
    return out.orderBy(
        F.desc("total_trips"), "origin_borough", "origin_zone", "dest_borough", "dest_zone"
    ).limit(params.top_corridors)


def airport_segment(enriched: DataFrame, params: Params) -> DataFrame:
    g = enriched.groupBy("company_name", "is_airport_trip").agg(
        trips().alias("total_trips"),
        avg("base_passenger_fare").alias("avg_base_fare"),
        avg("passenger_total_charge").alias("avg_total_charge"),
        avg("driver_pay").alias("avg_driver_pay"),
        sum_take_rate().alias("take_rate_pct"),
        avg("trip_miles").alias("avg_miles"),
        avg("fare_per_mile").alias("avg_fare_per_mile"),
        sla_pct().alias("sla_5min_pct"),
        avg("request_to_pickup_min").alias("avg_wait_min"),
    )
    return (
        g.orderBy("company_name", F.desc("is_airport_trip"))
        .select(
            section(params, "airport_segment"),
            "company_name",
            airport_label(c("is_airport_trip"), AIRPORT_LABEL, NON_AIRPORT_LABEL).alias("trip_type"),
            *g.columns[2:],
        )
    )


def borough_matrix(enriched: DataFrame, params: Params) -> DataFrame:
    g = (
        enriched.where(c("pu_borough").isNotNull() & c("do_borough").isNotNull())
        .groupBy(c("pu_borough").alias("origin"), c("do_borough").alias("destination"))
        .agg(
            trips().alias("total_trips"),
            avg("base_passenger_fare").alias("avg_base_fare"),
            avg("fare_per_mile").alias("avg_fare_per_mile"),
            sum_take_rate().alias("take_rate_pct"),
            sla_pct().alias("sla_5min_pct"),
            money_total("base_passenger_fare").alias("total_revenue"),
        )
    )
    return (
        g.select(section(params, "borough_matrix"), "*")
        .orderBy(F.desc("total_trips"), "origin", "destination")
        .limit(params.top_borough_pairs)
    )
