"""Congestion-fee burden by borough, distance and zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.functions.exact import ratio_cmp, round_ratio
from farelens.functions.ladders import category_position, ladder
from farelens.params import EQUITY_STATUS, Params
from farelens.plans._common import avg, c, congestion_band, money_total, pct_where, section, share_of_charge, trips, usum


def congestion_by_borough(enriched: DataFrame, params: Params) -> DataFrame:
    (high, high_l), (mod, mod_l), low_l = EQUITY_STATUS
    cong, total = usum("total_congestion_fees") * 100, usum("passenger_total_charge")
    g = (
        enriched.where(c("pu_borough").isNotNull())
        .groupBy(c("pu_borough").alias("borough"), "company_name")
        .agg(
            trips().alias("total_trips"),
            avg("base_passenger_fare").alias("avg_base_fare"),
            avg("passenger_total_charge").alias("avg_total_charge"),
            avg("congestion_surcharge").alias("avg_congestion_surcharge"),
            avg("cbd_congestion_fee").alias("avg_cbd_fee"),
            avg("total_congestion_fees").alias("avg_total_congestion"),
            share_of_charge("total_congestion_fees").alias("congestion_burden_pct"),
            round_ratio(cong, usum("base_passenger_fare"), 1).alias("congestion_vs_base_pct"),
            pct_where("congested", 1).alias("trips_with_congestion_pct"),
            ladder(
                [(ratio_cmp(cong, total, ">=", high), high_l), (ratio_cmp(cong, total, ">=", mod), mod_l)],
                low_l,
            ).alias("equity_status"),
        )
    )
    return g.select(section(params, "congestion_by_borough"), "*").orderBy(
        F.desc("congestion_burden_pct"), "borough", "company_name"
    )


def congestion_by_distance(enriched: DataFrame, params: Params) -> DataFrame:
    bands = params.congestion_distance_bands
    order = [label for _, label in bands] + [params.congestion_distance_rest]
    g = (
        enriched.withColumn("distance_band", congestion_band(params))
        .groupBy("company_name", "distance_band")
        .agg(
            trips().alias("total_trips"),
            avg("base_passenger_fare").alias("avg_base_fare"),
            avg("total_congestion_fees").alias("avg_congestion_fees"),
            share_of_charge("total_congestion_fees").alias("congestion_burden_pct"),
        )
    )
    return g.select(section(params, "congestion_by_distance"), "*").orderBy(
        "company_name", category_position(c("distance_band"), order)
    )


def cbd_zone_footprint(enriched: DataFrame, params: Params) -> DataFrame:
    g = (
        enriched.where(c("pu_borough").isNotNull())
        .groupBy(c("pu_borough").alias("borough"), c("pu_zone").alias("zone"))
        .agg(
            trips().alias("total_trips"),
            avg("cbd_congestion_fee").alias("avg_cbd_fee"),
            money_total("cbd_congestion_fee").alias("total_cbd_fees_collected"),
            pct_where("cbd", 1).alias("trips_with_cbd_fee_pct"),
            usum("cbd_congestion_fee").alias("_cbd_sum"),
        )
        # HAVING AVG(fee) > 0 over a non-empty group is SUM(fee) > 0.
        .where(c("_cbd_sum") > 0)
        .drop("_cbd_sum")
    )
    return (
        g.select(section(params, "cbd_zone_footprint"), "*")
        .orderBy(F.desc("total_cbd_fees_collected"), "borough", "zone")
        .limit(params.top_cbd_zones)
    )
