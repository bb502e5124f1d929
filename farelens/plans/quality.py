"""Segment growth-quality scores and the platform summary.

The segment table is computed once and both outputs derive from it (the
original second statement referenced a CTE of the first, which cannot
resolve on its own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.functions.exact import dec, mean
from farelens.functions.ladders import ladder
from farelens.params import (
    COMPLIANCE_SCORE,
    MARGIN_SCORE,
    SERVICE_SCORE,
    STABILITY_SCORE,
    STRATEGIC_VERDICT,
    SUSTAINABLE_CUTOFF,
    VULNERABLE_CUTOFF,
    Params,
)
from farelens.plans._common import avg, c, negative_take_pct, pct_mean_of, section, sla_pct, sum_take_rate, trips
from farelens.plans.volatility import fare_cv, fare_moments

SEGMENT_KEYS = ("company_name", "borough", "time_of_day")
SCORES = ("margin_score", "service_score", "compliance_score", "stability_score")


def _margin_score() -> Column:
    *rungs, fallback = MARGIN_SCORE
    rate, neg = c("avg_take_rate_pct"), c("negative_take_rate_pct")
    return ladder(
        [((rate >= dec(r)) & (neg < dec(n)) if n is not None else rate >= dec(r), pts) for r, n, pts in rungs],
        fallback,
    )


def _service_score() -> Column:
    *rungs, fallback = SERVICE_SCORE
    sla, wait = c("sla_pct"), c("avg_wait_min")
    return ladder(
        [((sla >= dec(s)) & (wait <= dec(w)) if w is not None else sla >= dec(s), pts) for s, w, pts in rungs],
        fallback,
    )


def _compliance_score() -> Column:
    zero_pts, *rungs, fallback = COMPLIANCE_SCORE
    v = c("violation_pct")
    return ladder([(v == dec(0), zero_pts), *[(v < dec(b), pts) for b, pts in rungs]], fallback)


def _stability_score() -> Column:
    *rungs, fallback = STABILITY_SCORE
    cv = c("price_volatility_pct")
    return ladder([(cv < dec(b), pts) for b, pts in rungs], fallback)


def segment_scores(enriched: DataFrame, params: Params) -> DataFrame:
    """Segments (platform x borough x time bucket) with scores and ranks."""
    base = (
        enriched.where(c("pu_borough").isNotNull() & c("below_tlc_minimum").isNotNull())
        .groupBy("company_name", c("pu_borough").alias("borough"), "time_of_day")
        .agg(
            trips().alias("total_trips"),
            avg("base_passenger_fare").alias("avg_base_fare"),
            sum_take_rate().alias("avg_take_rate_pct"),
            negative_take_pct().alias("negative_take_rate_pct"),
            sla_pct().alias("sla_pct"),
            avg("request_to_pickup_min").alias("avg_wait_min"),
            pct_mean_of("below_tlc_minimum", 2).alias("violation_pct"),
            avg("driver_pay_per_hour").alias("avg_driver_hourly"),
            *fare_moments(),
        )
        .where(c("total_trips") >= params.min_trips_segment)
    )
    base = base.select(
        *SEGMENT_KEYS,
        "total_trips",
        "avg_base_fare",
        "avg_take_rate_pct",
        "negative_take_rate_pct",
        "sla_pct",
        "avg_wait_min",
        "violation_pct",
        fare_cv().alias("price_volatility_pct"),
        "avg_driver_hourly",
    )
    scored = base.select(
        "*",
        _margin_score().alias("margin_score"),
        _service_score().alias("service_score"),
        _compliance_score().alias("compliance_score"),
        _stability_score().alias("stability_score"),
    )
    total = c("margin_score") + c("service_score") + c("compliance_score") + c("stability_score")
    # W10 / W11 rank segments (grouped rows, bounded by platforms x boroughs x buckets).
    return scored.select(
        "*",
        total.alias("growth_quality_score"),
        F.rank().over(Window.orderBy(total.desc())).alias("quality_rank"),
        F.rank().over(Window.partitionBy("company_name").orderBy(total.desc())).alias(
            "quality_rank_within_platform"
        ),
    )


def growth_quality(enriched: DataFrame, params: Params) -> DataFrame:
    s = segment_scores(enriched, params)
    *rungs, fallback = STRATEGIC_VERDICT
    score = c("growth_quality_score")
    return s.select(
        section(params, "growth_quality"),
        "*",
        ladder([(score >= cut, label) for cut, label in rungs], fallback).alias("strategic_verdict"),
    ).orderBy(F.desc("growth_quality_score"), *SEGMENT_KEYS)


def platform_quality(enriched: DataFrame, params: Params) -> DataFrame:
    s = segment_scores(enriched, params)
    score = c("growth_quality_score")
    g = s.groupBy("company_name").agg(
        mean(score, 1).alias("avg_quality_score"),
        *[mean(c(name), 1).alias(f"avg_{name}") for name in SCORES],
        F.count_if(score >= SUSTAINABLE_CUTOFF).cast("long").alias("sustainable_segments"),
        F.count_if(score < VULNERABLE_CUTOFF).cast("long").alias("vulnerable_segments"),
        F.count(F.lit(1)).alias("total_segments"),
    )
    return g.select(section(params, "platform_quality"), "*").orderBy(F.desc("avg_quality_score"), "company_name")

