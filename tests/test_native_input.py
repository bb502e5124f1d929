"""Native trip extracts are read by name, whatever their column order and money type."""

from __future__ import annotations

import pytest
from conftest import trip, trips_df
from pyspark.sql import functions as F

from farelens.operators.enrich import enrich
from farelens.params import Params
from farelens.plans import REPORTS
from farelens.sources.trips import MissingColumnError, read_trips, read_zones
from farelens.sources.zones import DuplicateZoneError, prepare_zones

P = Params()
MONEY = ("trip_miles", "base_passenger_fare", "driver_pay", "tips", "tolls")


@pytest.fixture(scope="module")
def contract(spark):
    return trips_df(spark, [trip(i, base_passenger_fare=10 + i, trip_miles=1 + i / 8, hour=i % 24) for i in range(40)])


def _variants(contract):
    native = contract.drop("trip_id")
    yield native
    yield native.select(*reversed(native.columns), F.lit("x").alias("extra"))
    yield native.withColumns({c: F.col(c).cast("double") for c in MONEY})


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_reports_equal_those_on_the_contract_table(spark, zones, contract, tmp_path, fmt):
    want = {r: sorted(map(str, REPORTS[r](enrich(contract, zones, P), P).collect())) for r in ("market_position", "borough_demand")}
    for k, df in enumerate(_variants(contract)):
        path = str(tmp_path / f"{fmt}{k}")
        writer = df.write.option("header", "true")
        writer.csv(path) if fmt == "csv" else writer.parquet(path)
        trips = read_trips(spark, path, fmt)
        assert trips.select("trip_id").distinct().count() == 40
        for r, rows in want.items():
            assert sorted(map(str, REPORTS[r](enrich(trips, zones, P), P).collect())) == rows


def test_ids_are_stable_and_missing_columns_raise(spark, contract, tmp_path):
    path = str(tmp_path / "t")
    contract.drop("trip_id").write.parquet(path)
    ids = [sorted(r[0] for r in read_trips(spark, path).select("trip_id").collect()) for _ in range(2)]
    assert ids[0] == ids[1]
    contract.drop("driver_pay").write.parquet(str(tmp_path / "m"))
    with pytest.raises(MissingColumnError, match="driver_pay"):
        read_trips(spark, str(tmp_path / "m"))


def test_zones_by_name_and_checked_each_time(spark, zones, tmp_path):
    path = str(tmp_path / "z")
    zones.select(*reversed(zones.columns)).write.option("header", "true").csv(path)
    read = read_zones(spark, path)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, zones.select(read.columns).collect()))
    prepare_zones(read, 100)
    zones.limit(1).select(*reversed(zones.columns)).write.mode("append").option("header", "true").csv(path)
    with pytest.raises(DuplicateZoneError):
        prepare_zones(read_zones(spark, path), 100)
