"""Zone opportunity matrix and the WAV accessibility gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farelens.functions.exact import dec
from farelens.functions.ladders import ladder
from farelens.operators.scores import minmax_scores, weighted_sum
from farelens.params import ENTRY_RECOMMENDATION, WAV_INTERPRETATION, WAV_STATUS, Params
from farelens.plans._common import avg, c, flag_count, pct_mean_of, pct_where, section, sla_pct, sum_take_rate, trips
from farelens.plans.volatility import fare_moments, fare_stddev


def zone_metrics(enriched: DataFrame, params: Params) -> DataFrame:
    g = (
        enriched.where(c("pu_zone").isNotNull() & c("below_tlc_minimum").isNotNull())
        .groupBy(c("pu_borough").alias("borough"), c("pu_zone").alias("zone"))
        .agg(
            trips().alias("total_trips"),
            avg("base_passenger_fare").alias("avg_base_fare"),
            avg("passenger_total_charge").alias("avg_total_charge"),
            sum_take_rate().alias("avg_take_rate_pct"),
            sla_pct().alias("sla_pct"),
            avg("request_to_pickup_min").alias("avg_wait_min"),
            pct_mean_of("below_tlc_minimum", 2).alias("violation_pct"),
            flag_count("wav_request").alias("wav_requests"),
            flag_count("wav_match").alias("wav_matches"),
            flag_count("shared_request").alias("shared_requests"),
            *fare_moments(),
        )
        .where(c("total_trips") >= params.min_trips_opportunity)
    )
    return g.select(
        "borough",
        "zone",
        "total_trips",
        "avg_base_fare",
        "avg_total_charge",
        "avg_take_rate_pct",
        "sla_pct",
        "avg_wait_min",
        "violation_pct",
        fare_stddev().alias("fare_stddev"),
        "wav_requests",
        "wav_matches",
        "shared_requests",
    )


def zone_opportunity(enriched: DataFrame, params: Params) -> DataFrame:
    scored = minmax_scores(
        zone_metrics(enriched, params),
        [
            ("total_trips", "volume_score", False),
            ("avg_base_fare", "fare_score", False),
            ("sla_pct", "sla_gap_score", True),
            ("avg_wait_min", "wait_gap_score", False),
        ],
    )
    scored = scored.withColumn(
        "opportunity_score",
        weighted_sum(["volume_score", "fare_score", "sla_gap_score", "wait_gap_score"], params.opportunity_weights),
    )
    (strong, strong_l), (mon, mon_l), defended_l = ENTRY_RECOMMENDATION
    unmet_l, suppressed_l, served_l = WAV_STATUS
    score = c("opportunity_score")
    # Rank over zones (grouped rows), NULL scores last.
    rank = F.rank().over(Window.orderBy(score.desc_nulls_last()))
    out = scored.select(
        section(params, "zone_opportunity"),
        "borough",
        "zone",
        "total_trips",
        "avg_base_fare",
        "avg_total_charge",
        "avg_take_rate_pct",
        "sla_pct",
        "avg_wait_min",
        "violation_pct",
        "volume_score",
        "fare_score",
        "sla_gap_score",
        "wait_gap_score",
        "opportunity_score",
        rank.alias("opportunity_rank"),
        ladder([(score >= dec(strong), strong_l), (score >= dec(mon), mon_l)], defended_l).alias(
            "entry_recommendation"
        ),
        ladder(
            [
                ((c("wav_requests") > 0) & (c("wav_matches") == 0), unmet_l),
                (c("wav_requests") == 0, suppressed_l),
            ],
            served_l,
        ).alias("wav_status"),
    )
    return out.orderBy(score.desc_nulls_last(), "borough", "zone").limit(params.top_opportunity_zones)


def wav_gap(enriched: DataFrame, params: Params) -> DataFrame:
    suppressed_l, unmet_l, partial_l = WAV_INTERPRETATION
    g = (
        enriched.where(c("pu_borough").isNotNull())
        .groupBy(c("pu_borough").alias("borough"))
        .agg(
            trips().alias("total_trips"),
            flag_count("wav_request").alias("wav_requests"),
            flag_count("wav_match").alias("wav_matches"),
            pct_where("wav_request", 3).alias("wav_request_rate_pct"),
        )
    )
    return g.select(
        section(params, "wav_gap"),
        "*",
        ladder([(c("wav_requests") == 0, suppressed_l), (c("wav_matches") == 0, unmet_l)], partial_l).alias(
            "wav_interpretation"
        ),
    ).orderBy(F.desc("wav_requests"), "borough")
