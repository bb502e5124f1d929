"""Reports over the state table equal the direct reports; states merge in any order."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import SF001, trip, trips_df
from pyspark.sql import functions as F

from farelens.operators.cuboid import KEYS, REPORT_KEYS, build_states, eager_report, merge_states, report_from_states
from farelens.operators.enrich import enrich
from farelens.params import Params
from farelens.plans import REPORTS
from farelens.registry import BINDINGS, enriched_for

PER_TRIP = {"fare_decile_margin", "fare_deciles_report"}


@pytest.fixture(scope="module", params=["orders", "events"])
def bound(request, spark, tmp_path_factory):
    """(enriched, states of two halves merged, zones, params) of one binding, with the states written."""
    enriched, params = enriched_for(spark, request.param, SF001)
    path = str(tmp_path_factory.mktemp(request.param) / "trips")
    enriched.write.parquet(path)
    trips = spark.read.parquet(path)
    halves = [build_states(trips.where(F.pmod(F.xxhash64("pickup_datetime", "driver_pay"), F.lit(2)) == k), params) for k in (0, 1)]
    states = merge_states(halves[1].unionByName(halves[0]))
    states.write.parquet(path + "-states")
    return trips, spark.read.parquet(path + "-states"), BINDINGS[request.param](spark, SF001).zones, params


@pytest.mark.parametrize("name", sorted(set(REPORTS) - PER_TRIP))
def test_report_over_states_equals_the_direct_report(bound, name):
    trips, states, zones, params = bound
    direct = REPORTS[name](trips, params)
    derived = report_from_states(REPORTS[name], states, zones, params)
    assert derived.columns == direct.columns
    assert [tuple(r) for r in derived.collect()] == [tuple(r) for r in direct.collect()]


def test_states_are_one_row_per_key_and_hold_every_trip(bound):
    trips, states, _, _ = bound
    assert states.groupBy(*KEYS).count().where("count > 1").isEmpty()
    assert states.agg(F.sum("n")).first()[0] == trips.count()


def test_nulls_and_edges_survive_the_states(spark, zones):
    rng = random.Random(4)
    params = Params().with_(min_trips_corridor=1, min_trips_zone_volatility=1, min_trips_opportunity=1, min_trips_segment=1)
    rows = []
    for i in range(300):
        at = dt.datetime(2025, 12, rng.randint(1, 31), rng.randint(0, 23), 5)
        rows.append(
            trip(
                i, pickup_datetime=at, request_datetime=at - dt.timedelta(seconds=rng.choice([0, 299, 301, 900])),
                hvfhs_license_num=rng.choice(["HV0003", "HV0005"]), PULocationID=rng.choice([1, 2, 3, 4, 99, None]),
                DOLocationID=rng.choice([1, 2, 3, 4, 99, None]), trip_miles=rng.choice([0.5, 1, 1.5, 2, 5, 9.999, 12]),
                base_passenger_fare=rng.choice([-5, 0, 10.01, 55]), driver_pay=rng.choice([1, 9.5, 70]),
                airport_fee=rng.choice([None, 0, 2.5]), cbd_congestion_fee=rng.choice([None, 0, 1.5]),
                wav_request_flag=rng.choice("YN"), wav_match_flag=rng.choice("YN"), tips=rng.choice([None, 3]),
            )
        )
    trips = enrich(trips_df(spark, rows), zones, params).cache()
    states = build_states(trips, params).cache()
    for name in sorted(set(REPORTS) - PER_TRIP):
        direct = [tuple(r) for r in REPORTS[name](trips, params).collect()]
        assert [tuple(r) for r in report_from_states(REPORTS[name], states, zones, params).collect()] == direct, name


@pytest.mark.parametrize("name", sorted(REPORT_KEYS))
def test_eager_aggregation_equals_the_direct_report(spark, bound, name):
    """Sums by location id below the zone lookup, by name above it."""
    trips, _, zones, params = bound
    zones = spark.createDataFrame(zones.collect(), zones.schema)
    eager = eager_report(REPORTS[name], trips, zones, params)
    assert [tuple(r) for r in eager.collect()] == [tuple(r) for r in REPORTS[name](trips, params).collect()]
    _no_join_below_the_first_aggregate(eager)


def _no_join_below_the_first_aggregate(df):
    text = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    deepest = max(line.index("Aggregate") for line in text if "Aggregate" in line and "LocationID" in line and "count(1)" in line)
    joins = [line.index("Join") for line in text if "Join" in line]
    assert joins and max(joins) < deepest


def test_zone_lookup_meets_states_only(spark, bound):
    """No join below the aggregation of trips: J1 and J2 come after it."""
    trips, _, zones, params = bound
    zones = spark.createDataFrame(zones.collect(), zones.schema)
    _no_join_below_the_first_aggregate(report_from_states(REPORTS["borough_demand"], build_states(trips, params), zones, params))
