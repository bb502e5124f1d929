"""P6a-P6d: driver pay-floor compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.functions.exact import ratio_cmp
from farelens.functions.ladders import category_position, ladder
from farelens.params import COMPLIANCE_STATUS, Params
from farelens.plans._common import avg, c, count_of, int_sum, mean_due, mean_shortfall, pay_band, pct_mean_of, section, trips


def _flagged(enriched: DataFrame) -> DataFrame:
    """trips where the pay-floor test applies."""
    return enriched.where(c("below_tlc_minimum").isNotNull())


def _violations() -> list[Column]:
    return [
        int_sum("below_tlc_minimum").cast("long").alias("violation_trips"),
        pct_mean_of("below_tlc_minimum", 2).alias("violation_pct"),
    ]


def pay_compliance_platform(enriched: DataFrame, params: Params) -> DataFrame:
    g = _flagged(enriched).groupBy("company_name").agg(
        trips().alias("total_trips"),
        *_violations(),
        avg("driver_pay").alias("avg_driver_pay"),
        avg("driver_pay_per_hour").alias("avg_driver_hourly"),
        avg("trip_miles").alias("avg_miles"),
        avg("trip_min").alias("avg_trip_min"),
        mean_due(params).alias("avg_tlc_minimum_due"),
        mean_shortfall(params).alias("avg_shortfall_on_violations"),
    )
    return g.select(section(params, "pay_compliance_platform"), "*").orderBy(
        F.desc("violation_pct"), "company_name"
    )


def _compliance_status() -> Column:
    (high, high_l), (mod, mod_l), (low, low_l), ok_l = COMPLIANCE_STATUS
    num, den = int_sum("below_tlc_minimum") * 100, count_of("below_tlc_minimum")
    return ladder(
        [
            (ratio_cmp(num, den, ">=", high), high_l),
            (ratio_cmp(num, den, ">=", mod), mod_l),
            (ratio_cmp(num, den, ">", low), low_l),
        ],
        ok_l,
    )


def pay_compliance_borough(enriched: DataFrame, params: Params) -> DataFrame:
    g = (
        _flagged(enriched)
        .where(c("pu_borough").isNotNull())
        .groupBy("company_name", c("pu_borough").alias("borough"))
        .agg(
            trips().alias("total_trips"),
            *_violations(),
            avg("driver_pay").alias("avg_driver_pay"),
            avg("driver_pay_per_hour").alias("avg_driver_hourly"),
            _compliance_status().alias("compliance_status"),
        )
    )
    return g.select(section(params, "pay_compliance_borough"), "*").orderBy(
        "company_name", F.desc("violation_pct"), "borough"
    )


def pay_compliance_time(enriched: DataFrame, params: Params) -> DataFrame:
    g = _flagged(enriched).groupBy("company_name", "time_of_day").agg(
        trips().alias("total_trips"),
        *_violations(),
        avg("driver_pay").alias("avg_driver_pay"),
        avg("trip_miles").alias("avg_miles"),
        avg("trip_min").alias("avg_trip_min"),
    )
    return g.select(section(params, "pay_compliance_time"), "*").orderBy(
        "company_name", F.desc("violation_pct"), "time_of_day"
    )


def pay_compliance_distance(enriched: DataFrame, params: Params) -> DataFrame:
    bands = params.pay_distance_bands
    order = [label for _, label in bands] + [params.pay_distance_rest]
    g = (
        _flagged(enriched)
        .withColumn("distance_band", pay_band(params))
        .groupBy("company_name", "distance_band")
        .agg(
            trips().alias("total_trips"),
            *_violations(),
            avg("driver_pay").alias("avg_driver_pay"),
            mean_due(params).alias("avg_tlc_minimum_due"),
            mean_shortfall(params).alias("avg_shortfall"),
        )
    )
    return g.select(section(params, "pay_compliance_distance"), "*").orderBy(
        "company_name", category_position(c("distance_band"), order)
    )
