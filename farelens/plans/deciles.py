"""Margin by fare decile (and the decile assignment itself, W3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farelens.functions.exact import ratio_cmp, round_ratio
from farelens.functions.ladders import ladder
from farelens.operators.ntile import assign_tiles, tile_sums
from farelens.params import MARGIN_HEALTH, Params
from farelens.plans._common import c, negative_take_flag, section, units


def fare_deciles(enriched: DataFrame, params: Params) -> DataFrame:
    """Every trip with a take rate, tiled by fare within its platform."""
    base = enriched.where(c("take_rate_pct").isNotNull()).select(
        "company_name",
        "base_passenger_fare",
        "driver_pay",
        "take_rate_pct",
        "platform_spread",
        "pu_borough",
        "time_of_day",
        "trip_miles",
        "trip_id",
    )
    return assign_tiles(
        base, params.fare_tiles, "company_name", "base_passenger_fare", "trip_id", "fare_decile"
    )


def fare_decile_margin(enriched: DataFrame, params: Params) -> DataFrame:
    (h, h_l), (m, m_l), (t, t_l), loss_l = MARGIN_HEALTH
    rated = enriched.where(c("take_rate_pct").isNotNull())
    # Additive per-trip parts of every decile measure, in LONG units.
    parts = {
        "fare_c": units("base_passenger_fare"),
        "pay_c": units("driver_pay"),
        "spread_c": units("platform_spread"),
        "miles_m": units("trip_miles"),
        "neg": negative_take_flag().cast("long"),
        "rate_u": units("take_rate_pct"),
    }
    g = tile_sums(
        rated, params.fare_tiles, "company_name", "base_passenger_fare", "trip_id", parts, "fare_decile"
    )
    n, s = c("_rows"), c
    rate_sum, rate_n = s("rate_u"), n * 100
    return g.select(
        section(params, "fare_decile_margin"),
        "company_name",
        "fare_decile",
        F.concat(
            F.lit("$"),
            c("base_passenger_fare_min").cast("string"),
            F.lit(" to $"),
            c("base_passenger_fare_max").cast("string"),
        ).alias("fare_range"),
        n.alias("trips_in_decile"),
        round_ratio(s("fare_c"), n * 100, 2).alias("avg_base_fare"),
        round_ratio(s("pay_c"), n * 100, 2).alias("avg_driver_pay"),
        round_ratio((s("fare_c") - s("pay_c")) * 100, s("fare_c"), 2).alias("avg_take_rate_pct"),
        round_ratio(s("spread_c"), n * 100, 2).alias("avg_platform_spread"),
        round_ratio(s("miles_m"), n * 1000, 2).alias("avg_miles"),
        s("neg").alias("negative_take_rate_trips"),
        round_ratio(s("neg") * 100, n, 2).alias("negative_take_rate_pct"),
        round_ratio(s("spread_c"), F.lit(100), 0).alias("total_margin"),
        ladder(
            [
                (ratio_cmp(rate_sum, rate_n, ">=", h), h_l),
                (ratio_cmp(rate_sum, rate_n, ">=", m), m_l),
                (ratio_cmp(rate_sum, rate_n, ">=", t), t_l),
            ],
            loss_l,
        ).alias("margin_health"),
    ).orderBy("company_name", "fare_decile")


def fare_deciles_report(enriched: DataFrame, params: Params) -> DataFrame:
    """W3 on its own: platform, trip key, fare and decile per trip."""
    return fare_deciles(enriched, params).select("company_name", "trip_id", "base_passenger_fare", "fare_decile")
