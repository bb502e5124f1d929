"""Report ladders and edge rules on hand-written trips (FIXTURES.md section 2)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from conftest import trip, trips_df

from farelens.operators.enrich import enrich
from farelens.params import Params
from farelens.plans.demand import borough_time_demand
from farelens.plans.holiday import daily_revenue_trend, peak_vs_trough
from farelens.plans.market import market_position
from farelens.plans.opportunity import wav_gap, zone_opportunity
from farelens.plans.quality import growth_quality, platform_quality
from farelens.sources.trips import normalise_flags

P = Params()


def enriched(spark, zones, rows, params=P):
    return enrich(normalise_flags(trips_df(spark, rows)), zones, params)


def test_service_status_cutoffs(spark, zones):
    rows = [
        trip(1, hour=7, wait=100), trip(2, hour=7, wait=400),  # 50 % -> AT RISK
        trip(3, hour=11, wait=400),  # 0 % -> UNDERSERVED
        trip(4, hour=17, wait=10),  # 100 % -> ADEQUATE
    ]
    out = {r["time_of_day"]: r["service_status"] for r in borough_time_demand(enriched(spark, zones, rows), P).collect()}
    assert out == {"AM Rush": "AT RISK", "Midday": "UNDERSERVED", "PM Rush": "ADEQUATE"}


def test_market_share_and_counts(spark, zones):
    rows = [trip(i) for i in range(3)] + [trip(10 + i, hvfhs_license_num="HV0005") for i in range(1)]
    out = {r["company_name"]: r for r in market_position(enriched(spark, zones, rows), P).collect()}
    assert out["Uber"]["total_trips"] == 3 and out["Lyft"]["total_trips"] == 1
    assert out["Uber"]["market_share_pct"] == Decimal("75.00")
    assert out["Uber"]["avg_take_rate_pct"] == Decimal("25.00")


def test_daily_labels_ties_and_gaps(spark, zones):
    base = dt.datetime(2025, 12, 22, 12)
    rows = []
    fares = {22: 30, 23: 0, 24: 50, 25: 50, 27: 10}  # 26 missing; 24 and 25 tie for the peak
    i = 0
    for day, fare in fares.items():
        ts = base.replace(day=day)
        if fare == 0:
            rows.append(trip(i, pickup_datetime=ts, request_datetime=ts, base_passenger_fare=Decimal("0.00")))
        else:
            rows.append(trip(i, pickup_datetime=ts, request_datetime=ts, base_passenger_fare=Decimal(fare)))
        i += 1
    e = enriched(spark, zones, rows)
    trend = {r["trip_date"].day: r for r in daily_revenue_trend(e, P).collect()}
    assert trend[24]["day_label"] == "PEAK DAY" and trend[25]["day_label"] == "PEAK DAY"  # rank wins over 25 Dec
    assert trend[24]["dod_change_pct"] is None  # previous day revenue 0
    assert trend[27]["prev_day_revenue"] == Decimal("50")  # row-based lag skips the gap
    assert trend[22]["day_label"] is None and trend[23]["revenue_rank"] == 5
    assert trend[27]["cumulative_revenue"] == Decimal("140")
    # rolling 7 rows: (30+0+50+50+10)/5 = 28
    assert trend[27]["rolling_7day_avg"] == Decimal("28")
    pt = peak_vs_trough(e, P).collect()[0]
    assert pt["peak_date"] == dt.date(2025, 12, 25)  # latest of the tied peaks
    assert pt["trough_date"] == dt.date(2025, 12, 23)
    assert pt["cliff_pct"] == Decimal("-100.0") and pt["peak_to_trough_ratio"] is None


def test_opportunity_single_zone_is_null_scored(spark, zones):
    rows = [trip(i) for i in range(3)]
    out = zone_opportunity(enriched(spark, zones, rows), P.with_(min_trips_opportunity=1)).collect()
    assert len(out) == 1
    r = out[0]
    assert r["volume_score"] is None and r["opportunity_score"] is None
    assert r["entry_recommendation"] == "INCUMBENT DEFENDED" and r["opportunity_rank"] == 1
    assert r["wav_status"] == "WAV SUPPRESSED"


def test_wav_interpretation_order(spark, zones):
    rows = [
        trip(1, PULocationID=1, wav_request_flag="y"),  # lower-case counts after normalisation
        trip(2, PULocationID=1, wav_request_flag="Y", wav_match_flag="Y"),
        trip(3, PULocationID=2, wav_request_flag="Y"),
        trip(4, PULocationID=3),
    ]
    out = {r["borough"]: r for r in wav_gap(enriched(spark, zones, rows), P).collect()}
    assert out["Manhattan"]["wav_requests"] == 2 and out["Manhattan"]["wav_interpretation"] == "PARTIALLY SERVED"
    assert out["Brooklyn"]["wav_interpretation"] == "REQUESTS UNMET -- fulfillment failure"
    assert out["Unknown"]["wav_interpretation"].startswith("SUPPRESSED DEMAND")
    assert out["Brooklyn"]["wav_request_rate_pct"] == Decimal("100.000")


def test_quality_scores_and_summary(spark, zones):
    rows = [trip(i, base_passenger_fare=Decimal(20 + i % 3), wait=60) for i in range(4)]
    p = P.with_(min_trips_segment=1)
    e = enriched(spark, zones, rows)
    seg = growth_quality(e, p).collect()
    assert len(seg) == 1
    s = seg[0]
    # take rate >= 20 and no negative trips -> 25; SLA 100 %, wait 1.00 -> 25;
    # no violations -> 25; CV < 30 -> 25
    assert (s["margin_score"], s["service_score"], s["compliance_score"], s["stability_score"]) == (25, 25, 25, 25)
    assert s["growth_quality_score"] == 100 and s["strategic_verdict"] == "SUSTAINABLE"
    summary = platform_quality(e, p).collect()[0]
    assert summary["avg_quality_score"] == Decimal("100.0") and summary["sustainable_segments"] == 1
