"""Fare volatility (population standard deviation and CV)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.functions.exact import cv_pct_rounded, dec, stddev_pop_rounded
from farelens.functions.ladders import ladder
from farelens.params import ENTRY_SIGNAL, VOLATILITY_CLASS, Params
from farelens.plans._common import avg, c, least, moments, most, section, sla_pct, sum_take_rate, trips


def fare_moments() -> list[Column]:
    """Exact count and digit sums of the fare in cents and of its square."""
    return moments("base_passenger_fare", "_fare")


def fare_stddev() -> Column:
    return stddev_pop_rounded("_fare_n", "_fare_s", "_fare_ss")


def fare_cv() -> Column:
    return cv_pct_rounded("_fare_n", "_fare_s", "_fare_ss")


def zone_volatility(enriched: DataFrame, params: Params) -> DataFrame:
    g = (
        enriched.where(c("pu_zone").isNotNull())
        .groupBy(c("pu_borough").alias("borough"), c("pu_zone").alias("zone"), "company_name")
        .agg(
            trips().alias("total_trips"),
            avg("base_passenger_fare").alias("avg_fare"),
            least("base_passenger_fare").alias("fare_min"),
            most("base_passenger_fare").alias("fare_max"),
            sla_pct().alias("sla_pct"),
            sum_take_rate().alias("avg_take_rate_pct"),
            *fare_moments(),
        )
        .where(c("total_trips") >= params.min_trips_zone_volatility)
    )
    (hi, hi_l), (mod, mod_l), stable_l = VOLATILITY_CLASS
    (e_cv, e_trips, e_sla, e_label), (v_cv, v_sla, v_label), std_label = ENTRY_SIGNAL
    cv, sla = c("coeff_of_variation_pct"), c("sla_pct")
    scored = g.select(
        "borough",
        "zone",
        "company_name",
        "total_trips",
        "avg_fare",
        fare_stddev().alias("fare_stddev"),
        "fare_min",
        "fare_max",
        (c("fare_max") - c("fare_min")).alias("fare_range"),
        fare_cv().alias("coeff_of_variation_pct"),
        "sla_pct",
        "avg_take_rate_pct",
    )
    out = scored.select(
        section(params, "zone_volatility"),
        "*",
        ladder([(cv >= dec(hi), hi_l), (cv >= dec(mod), mod_l)], stable_l).alias("volatility_class"),
        ladder(
            [
                ((cv < dec(e_cv)) & (c("total_trips") >= e_trips) & (sla < dec(e_sla)), e_label),
                ((cv >= dec(v_cv)) & (sla < dec(v_sla)), v_label),
            ],
            std_label,
        ).alias("entry_signal"),
    )
    return out.orderBy(F.desc("coeff_of_variation_pct"), "borough", "zone", "company_name").limit(
        params.top_volatile_zones
    )


def _borough_volatility(enriched: DataFrame, extra: list[Column]) -> DataFrame:
    g = (
        enriched.where(c("pu_borough").isNotNull())
        .groupBy(c("pu_borough").alias("borough"), "company_name")
        .agg(trips().alias("total_trips"), avg("base_passenger_fare").alias("avg_fare"), sla_pct().alias("sla_pct"), *extra, *fare_moments())
    )
    return g


def borough_volatility(enriched: DataFrame, params: Params) -> DataFrame:
    g = _borough_volatility(enriched, [])
    return g.select(
        section(params, "borough_volatility"),
        "borough",
        "company_name",
        "total_trips",
        "avg_fare",
        fare_stddev().alias("fare_stddev"),
        fare_cv().alias("coeff_of_variation_pct"),
        "sla_pct",
    ).orderBy(F.desc("coeff_of_variation_pct"), "borough", "company_name")


def late_night_volatility(enriched: DataFrame, params: Params) -> DataFrame:
    late = enriched.where(c("time_of_day") == params.default_time_bucket)
    g = _borough_volatility(late, [avg("request_to_pickup_min").alias("avg_wait_min")])
    return g.select(
        section(params, "late_night_volatility"),
        "borough",
        "company_name",
        "total_trips",
        "avg_fare",
        fare_stddev().alias("fare_stddev"),
        fare_cv().alias("coeff_of_variation_pct"),
        "sla_pct",
        "avg_wait_min",
    ).orderBy("sla_pct", "borough", "company_name")
