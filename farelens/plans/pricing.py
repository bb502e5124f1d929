"""Where each rider dollar goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.functions.ladders import airport_label
from farelens.params import AIRPORT_LABEL, NON_AIRPORT_LABEL, Params
from farelens.plans._common import avg, c, section, share_of_charge, sum_take_rate, trips


def price_decomposition(enriched: DataFrame, params: Params) -> DataFrame:
    g = enriched.groupBy("company_name").agg(
        trips().alias("total_trips"),
        avg("base_passenger_fare").alias("avg_base_fare"),
        avg("tolls").alias("avg_tolls"),
        avg("bcf").alias("avg_bcf"),
        avg("sales_tax").alias("avg_sales_tax"),
        avg("congestion_surcharge").alias("avg_congestion_surcharge"),
        avg("cbd_congestion_fee").alias("avg_cbd_fee"),
        avg("airport_fee").alias("avg_airport_fee"),
        avg("tips").alias("avg_tips"),
        avg("passenger_total_charge").alias("avg_total_charge"),
        # Ratios of means over the same rows = ratios of sums (exact).
        share_of_charge("base_passenger_fare").alias("base_pct_of_total"),
        share_of_charge("congestion_surcharge").alias("congestion_pct_of_total"),
        share_of_charge("cbd_congestion_fee").alias("cbd_pct_of_total"),
        share_of_charge("congestion_surcharge", "cbd_congestion_fee").alias("total_congestion_pct"),
        share_of_charge("sales_tax").alias("tax_pct_of_total"),
        share_of_charge("tips").alias("tips_pct_of_total"),
        share_of_charge("driver_pay").alias("driver_pct_of_total"),
        share_of_charge("platform_spread").alias("platform_pct_of_total"),
    )
    return g.select(section(params, "price_decomposition"), "*").orderBy("company_name")


def borough_fee_burden(enriched: DataFrame, params: Params) -> DataFrame:
    g = (
        enriched.where(c("pu_borough").isNotNull())
        .groupBy(c("pu_borough").alias("borough"), "company_name")
        .agg(
            trips().alias("total_trips"),
            avg("base_passenger_fare").alias("avg_base_fare"),
            avg("passenger_total_charge").alias("avg_total_charge"),
            avg("total_congestion_fees").alias("avg_congestion_fees"),
            share_of_charge("total_congestion_fees").alias("congestion_burden_pct"),
            avg("tips").alias("avg_tips"),
            avg("driver_pay").alias("avg_driver_pay"),
        )
    )
    return g.select(section(params, "borough_fee_burden"), "*").orderBy("borough", "company_name")


def airport_fee_structure(enriched: DataFrame, params: Params) -> DataFrame:
    g = enriched.groupBy("company_name", "is_airport_trip").agg(
        trips().alias("total_trips"),
        avg("base_passenger_fare").alias("avg_base_fare"),
        avg("airport_fee").alias("avg_airport_fee"),
        avg("passenger_total_charge").alias("avg_total_charge"),
        share_of_charge("airport_fee").alias("airport_fee_pct_of_total"),
        sum_take_rate().alias("take_rate_pct"),
    )
    return g.orderBy("company_name", F.desc("is_airport_trip")).select(
        section(params, "airport_fee_structure"),
        "company_name",
        airport_label(c("is_airport_trip"), AIRPORT_LABEL, NON_AIRPORT_LABEL).alias("trip_type"),
        *g.columns[2:],
    )
