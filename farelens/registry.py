"""Registered reports: query key -> (binding, report function)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from farelens.operators.cuboid import REPORT_KEYS, build_states, eager_report, report_from_states
from farelens.operators.enrich import enrich
from farelens.params import Params
from farelens.plans import REPORTS
from farelens.sources.bindings import Binding, events_binding, mixed_binding, orders_binding

BINDINGS: dict[str, Callable[[SparkSession, str], Binding]] = {
    "orders": orders_binding,
    "events": events_binding,
    "mixed": mixed_binding,
}


# key -> (binding name, report name); report names index ``REPORTS``.
QUERIES: dict[str, tuple[str, str]] = {
    "p0_enriched_orders": ("orders", "enriched_trips"),
    "p0_enriched_events": ("events", "enriched_trips"),
    "p1_market_position": ("orders", "market_position"),
    "p2a_borough_demand": ("orders", "borough_demand"),
    "p2b_borough_time_demand": ("events", "borough_time_demand"),
    "p3a_top_corridors": ("orders", "top_corridors"),
    "p3b_airport_segment": ("orders", "airport_segment"),
    "p3c_borough_matrix": ("orders", "borough_matrix"),
    "p4_fare_decile_margin": ("orders", "fare_decile_margin"),
    "p4_fare_decile_margin_events": ("events", "fare_decile_margin"),
    "w3_fare_decile_orders": ("orders", "fare_deciles_report"),
    "w3_fare_decile_events": ("events", "fare_deciles_report"),
    "p5a_price_decomposition": ("orders", "price_decomposition"),
    "p5b_borough_fee_burden": ("orders", "borough_fee_burden"),
    "p5c_airport_fee_structure": ("orders", "airport_fee_structure"),
    "p6a_pay_compliance_platform": ("orders", "pay_compliance_platform"),
    "p6b_pay_compliance_borough": ("orders", "pay_compliance_borough"),
    "p6c_pay_compliance_time": ("events", "pay_compliance_time"),
    "p6d_pay_compliance_distance": ("orders", "pay_compliance_distance"),
    "p6d_pay_compliance_distance_events": ("events", "pay_compliance_distance"),
    "p7a_congestion_by_borough": ("orders", "congestion_by_borough"),
    "p7b_congestion_by_distance": ("orders", "congestion_by_distance"),
    "p7b_congestion_by_distance_events": ("events", "congestion_by_distance"),
    "p7c_cbd_zone_footprint": ("orders", "cbd_zone_footprint"),
    "p8a_daily_revenue_trend": ("events", "daily_revenue_trend"),
    "p8b_peak_vs_trough": ("events", "peak_vs_trough"),
    "p9a_zone_volatility": ("orders", "zone_volatility"),
    "p9b_borough_volatility": ("orders", "borough_volatility"),
    "p9c_late_night_volatility": ("events", "late_night_volatility"),
    "p10a_zone_opportunity": ("orders", "zone_opportunity"),
    "p10b_wav_gap": ("orders", "wav_gap"),
    "p11a_growth_quality": ("events", "growth_quality"),
    "p11b_platform_quality": ("events", "platform_quality"),
    "p2a_borough_demand_mixed": ("mixed", "borough_demand"),
    "p2b_borough_time_demand_mixed": ("mixed", "borough_time_demand"),
    "p3a_top_corridors_mixed": ("mixed", "top_corridors"),
    "p3c_borough_matrix_mixed": ("mixed", "borough_matrix"),
    "p4_fare_decile_margin_mixed": ("mixed", "fare_decile_margin"),
    "p6b_pay_compliance_borough_mixed": ("mixed", "pay_compliance_borough"),
    "p7a_congestion_by_borough_mixed": ("mixed", "congestion_by_borough"),
    "p7c_cbd_zone_footprint_mixed": ("mixed", "cbd_zone_footprint"),
    "p9a_zone_volatility_mixed": ("mixed", "zone_volatility"),
    "p10a_zone_opportunity_mixed": ("mixed", "zone_opportunity"),
    "p10b_wav_gap_mixed": ("mixed", "wav_gap"),
    "p11a_growth_quality_mixed": ("mixed", "growth_quality"),
    "p11b_platform_quality_mixed": ("mixed", "platform_quality"),
}
#: Reports that are also answered from the base cuboid (operators/cuboid.py): query key -> key of the direct report.
CUBOID_QUERIES: dict[str, str] = {
    f"cuboid_{key}": key
    for key in (
        "p1_market_position",
        "p2a_borough_demand",
        "p3a_top_corridors",
        "p5a_price_decomposition",
        "p6d_pay_compliance_distance_events",
        "p7c_cbd_zone_footprint",
        "p8a_daily_revenue_trend",
        "p9a_zone_volatility",
        "p10a_zone_opportunity",
        "p11a_growth_quality",
    )
}
QUERIES |= {key: QUERIES[direct] for key, direct in CUBOID_QUERIES.items()}
if unknown := {r for _, r in QUERIES.values()} - {*REPORTS, "enriched_trips"}:
    raise LookupError(f"registered reports that do not exist: {sorted(unknown)}")


def enriched_for(spark: SparkSession, binding: str, sf_dir: str) -> tuple[DataFrame, Params]:
    b = BINDINGS[binding](spark, sf_dir)
    return enrich(b.trips, b.zones, b.params), b.params


def run_query(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    binding, report = QUERIES[name]
    if name in CUBOID_QUERIES:
        b = BINDINGS[binding](spark, sf_dir)
        states = build_states(enrich(b.trips, b.zones, b.params), b.params)
        return report_from_states(REPORTS[report], states, b.zones, b.params)
    if report in REPORT_KEYS:  # grouped by zone name: aggregate by id below the lookup
        b = BINDINGS[binding](spark, sf_dir)
        return eager_report(REPORTS[report], enrich(b.trips, b.zones, b.params), b.zones, b.params)
    enriched, params = enriched_for(spark, binding, sf_dir)
    if report == "enriched_trips":
        return enriched
    return REPORTS[report](enriched, params)
