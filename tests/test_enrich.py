"""Filters F1-F4 and row-level enrichment E1-E17 on hand-written trips."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from conftest import trip, trips_df

from farelens.operators.enrich import enrich
from farelens.params import Params
from farelens.sources.zones import DuplicateZoneError

P = Params()


def run(spark, zones, rows, params=P):
    df = enrich(trips_df(spark, rows), zones, params)
    return {r["trip_id"]: r for r in df.collect()}


def test_wait_filter_bounds(spark, zones):
    rows = [trip(1, wait=-1), trip(2, wait=0), trip(3, wait=7200), trip(4, wait=7201), trip(5, wait=-0.5)]
    out = run(spark, zones, rows)
    # -0.5 s truncates to 0 and passes; -1 and 7201 are dropped.
    assert sorted(out) == [2, 3, 5]


@pytest.mark.parametrize(
    "override",
    [
        {"trip_miles": Decimal("0.000")},
        {"trip_time": 0},
        {"pickup_datetime": None},
        {"dropoff_datetime": None},
        {"request_datetime": None},
        {"base_passenger_fare": None},
        {"driver_pay": None},
        {"hvfhs_license_num": "HV0004"},
        {"hvfhs_license_num": None},
    ],
)
def test_rows_dropped(spark, zones, override):
    assert run(spark, zones, [trip(1, **override)]) == {}


def test_sla_truncates_seconds(spark, zones):
    out = run(spark, zones, [trip(1, wait=300), trip(2, wait=300.9), trip(3, wait=301)])
    assert [out[i]["sla_5min_met"] for i in (1, 2, 3)] == [1, 1, 0]
    assert out[3]["request_to_pickup_min"] == Decimal("5.02")


@pytest.mark.parametrize(
    "hour,bucket",
    [(0, "Late Night"), (5, "Late Night"), (6, "AM Rush"), (9, "AM Rush"), (10, "Midday"), (15, "Midday"),
     (16, "PM Rush"), (19, "PM Rush"), (20, "Evening"), (22, "Evening"), (23, "Late Night")],
)
def test_time_buckets(spark, zones, hour, bucket):
    out = run(spark, zones, [trip(1, hour=hour)])
    assert out[1]["time_of_day"] == bucket


def test_geography_left_joins(spark, zones):
    out = run(spark, zones, [trip(1, PULocationID=99), trip(2, PULocationID=None), trip(3, PULocationID=3), trip(4, DOLocationID=4)])
    assert len(out) == 4  # left joins never drop trips
    assert out[1]["pu_borough"] is None and out[2]["pu_borough"] is None
    assert out[3]["pu_borough"] == "Unknown"
    assert out[4]["do_borough"] is None and out[4]["pu_zone"] == "Midtown Center"


def test_fees_null_to_zero_and_totals(spark, zones):
    out = run(
        spark,
        zones,
        [trip(1, bcf=None, sales_tax=None, congestion_surcharge=None, cbd_congestion_fee=None), trip(2, tips=3.25, tolls=6.94)],
    )
    r1, r2 = out[1], out[2]
    assert r1["tolls"] == Decimal("0.00") and r1["passenger_total_charge"] == Decimal("20.00")
    assert r1["total_congestion_fees"] == Decimal("0.00")
    assert r2["passenger_total_charge"] == Decimal("20.00") + Decimal("0.55") + Decimal("1.78") + Decimal(
        "2.75"
    ) + Decimal("1.50") + Decimal("3.25") + Decimal("6.94")
    assert r2["total_congestion_fees"] == Decimal("4.25")


def test_airport_flag_uses_raw_fee(spark, zones):
    out = run(spark, zones, [trip(1, airport_fee=None), trip(2, airport_fee=0), trip(3, airport_fee=2.50)])
    assert [out[i]["is_airport_trip"] for i in (1, 2, 3)] == [0, 0, 1]
    assert out[1]["airport_fee"] == Decimal("0.00")


def test_take_rate_guard(spark, zones):
    out = run(
        spark,
        zones,
        [trip(1, base_passenger_fare=-5, driver_pay=12), trip(2, base_passenger_fare=0, driver_pay=12), trip(3, base_passenger_fare=10, driver_pay=12)],
    )
    assert out[1]["take_rate_pct"] is None and out[2]["take_rate_pct"] is None
    assert out[3]["take_rate_pct"] == Decimal("-20.00")
    assert out[3]["platform_spread"] == Decimal("-2.00")


def test_rounding_half_away_from_zero(spark, zones):
    # spread / fare * 100 = 1/8 * 100 = 12.5 exactly at 1 dp; at 2 dp check ties:
    # fare 16.00, pay 15.99 -> 0.0625 % -> 0.06; fare 8.00 pay 7.999 n/a (cents) so use per-mile:
    # fare 10.05 / 2.000 miles = 5.025 -> 5.03 ; fare -> negative spread tie
    out = run(
        spark,
        zones,
        [trip(1, base_passenger_fare=10.05, trip_miles=Decimal("2.000")), trip(2, base_passenger_fare=8.00, driver_pay=8.01)],
    )
    assert out[1]["fare_per_mile"] == Decimal("5.03")
    # -0.01 / 8.00 * 100 = -0.125 -> -0.13 (half away from zero)
    assert out[2]["take_rate_pct"] == Decimal("-0.13")


def test_pay_floor_boundaries(spark, zones):
    # 3 miles * 0.82 + 960 s / 60 * 0.57 = 2.46 + 9.12 = 11.58
    out = run(
        spark,
        zones,
        [trip(1, driver_pay=11.57), trip(2, driver_pay=11.58), trip(3, driver_pay=11.59)],
    )
    assert [out[i]["below_tlc_minimum"] for i in (1, 2, 3)] == [1, 0, 0]


def test_pay_floor_rounds_exact_seconds(spark, zones):
    # 10 s -> 10/60*0.57 = 0.095 exactly; 1.000 mile -> 0.82; floor = ROUND(0.915, 2) = 0.92
    out = run(
        spark,
        zones,
        [trip(1, trip_time=10, trip_miles=Decimal("1.000"), driver_pay=0.91), trip(2, trip_time=10, trip_miles=Decimal("1.000"), driver_pay=0.92)],
    )
    assert out[1]["below_tlc_minimum"] == 1 and out[2]["below_tlc_minimum"] == 0


def test_derived_minutes_and_hourly(spark, zones):
    out = run(spark, zones, [trip(1, trip_time=138, driver_pay=7.77)])
    assert out[1]["trip_min"] == Decimal("2.30")
    # 7.77 / 138 * 3600 = 202.695... -> 202.70
    assert out[1]["driver_pay_per_hour"] == Decimal("202.70")


def test_company_labels_and_trip_date(spark, zones):
    out = run(spark, zones, [trip(1), trip(2, hvfhs_license_num="HV0005")])
    assert out[1]["company_name"] == "Uber" and out[2]["company_name"] == "Lyft"
    assert out[1]["trip_date"] == dt.date(2025, 12, 10)


def test_duplicate_zone_raises(spark):
    from farelens.sources.contract import ZONES_SCHEMA

    dup = spark.createDataFrame([(1, "A", "x", "y"), (1, "B", "z", "w")], ZONES_SCHEMA)
    with pytest.raises(DuplicateZoneError):
        enrich(trips_df(spark, [trip(1)]), dup, P)


def test_enriched_columns_in_order(spark, zones):
    from farelens.sources.contract import ENRICHED_COLUMNS

    df = enrich(trips_df(spark, [trip(1)]), zones, P)
    assert tuple(df.columns) == ENRICHED_COLUMNS
    assert len(ENRICHED_COLUMNS) == 43
