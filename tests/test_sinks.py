"""Publishing the enriched relation and exporting results."""

from __future__ import annotations

import os

import pytest
from conftest import trip, trips_df
from pyspark.sql import functions as F

from farelens.operators.daily_state import peak_vs_trough as day_peaks
from farelens.operators.daily_state import publish_days
from farelens.operators.daily_state import trend as day_trend
from farelens.operators.enrich import enrich
from farelens.params import Params
from farelens.plans.holiday import daily_revenue_trend, peak_vs_trough
from farelens.plans.market import market_position
from farelens.sources import manifest
from farelens.sources.contract import ENRICHED_COLUMNS, TRIPS_SCHEMA
from farelens.sources.sinks import export, publish_enriched, publish_view, read_enriched
from farelens.sources.trips import read_trips, read_trips_checked, reject_counts

P = Params()


def test_publish_roundtrip_and_export(spark, zones, tmp_path):
    import datetime as dt

    rows = [trip(i, pickup_datetime=dt.datetime(2025, 12, 1 + i % 3, 9), request_datetime=dt.datetime(2025, 12, 1 + i % 3, 8, 58)) for i in range(12)]
    e = enrich(trips_df(spark, rows), zones, P)
    path = str(tmp_path / "enriched")
    publish_enriched(e, path)
    (load,) = os.listdir(f"{path}/data")
    assert sorted(d for d in os.listdir(f"{path}/data/{load}") if d.startswith("trip_date=")) == [
        "trip_date=2025-12-01", "trip_date=2025-12-02", "trip_date=2025-12-03"
    ]
    back = read_enriched(spark, path)
    assert tuple(back.columns) == ENRICHED_COLUMNS
    assert sorted(tuple(r) for r in market_position(back, P).collect()) == sorted(
        tuple(r) for r in market_position(e, P).collect()
    )
    flat = str(tmp_path / "flat")
    publish_enriched(e, flat, partition_by=None)
    assert read_enriched(spark, flat).count() == 12
    out = str(tmp_path / "p1.csv")
    export(market_position(back, P), out)
    assert any(f.endswith(".csv") for f in os.listdir(out))
    publish_view(back)
    assert spark.sql("SELECT COUNT(*) FROM v_trips_enriched").first()[0] == 12


def test_read_trips_csv_normalises_flags(spark, zones, tmp_path):
    path = str(tmp_path / "trips_csv")
    trips_df(spark, [trip(1, wav_request_flag="y")]).write.option("header", "true").csv(path)
    t = read_trips(spark, path, fmt="csv")
    assert t.first()["wav_request_flag"] == "Y"


def test_publish_replaces_the_relation_and_leaves_the_session_alone(spark, zones, tmp_path):
    import datetime as dt

    def days(n, per):
        at = [dt.datetime(2025, 12, 1 + i % n, 9) for i in range(n * per)]
        return enrich(trips_df(spark, [trip(i, pickup_datetime=t, request_datetime=t - dt.timedelta(minutes=2)) for i, t in enumerate(at)]), zones, P)

    path, before = str(tmp_path / "p"), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    publish_enriched(days(3, 4), path)
    publish_enriched(days(2, 3), path)
    assert read_enriched(spark, path).count() == 6
    publish_enriched(days(1, 5), path, replace_dates_only=True)
    assert read_enriched(spark, path).count() == 8
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_export_keeps_partitions(spark, tmp_path):
    out = str(tmp_path / "wide")
    export(spark.range(0, 4000, numPartitions=4), out, fmt="parquet")
    assert len([f for f in os.listdir(out) if f.endswith(".parquet")]) == 4


def _days(spark, zones, spec, pay=15.0):
    """Enriched trips: spec is (day, trips) pairs."""
    import datetime as dt

    at = [dt.datetime(2025, 12, day, 9, k % 60) for day, n in spec for k in range(n)]
    rows = [trip(i, pickup_datetime=t, request_datetime=t - dt.timedelta(minutes=2), driver_pay=pay, hvfhs_license_num=("HV0003", "HV0005")[i % 2]) for i, t in enumerate(at)]
    return enrich(trips_df(spark, rows), zones, P)


def test_failed_publish_leaves_the_old_relation(spark, zones, tmp_path):
    path = str(tmp_path / "p")
    publish_enriched(_days(spark, zones, [(1, 3), (2, 4)]), path)

    def fail(batches):
        yield next(iter(batches))
        raise RuntimeError("lost half way")

    good = _days(spark, zones, [(3, 2000)])
    with pytest.raises(Exception, match="lost half way"):
        publish_enriched(good.mapInArrow(fail, good.schema), path)
    assert read_enriched(spark, path).count() == 7
    publish_enriched(good, path)
    assert read_enriched(spark, path).count() == 2000


def test_readers_see_old_or_new_and_vacuum_keeps_what_is_named(spark, zones, tmp_path):
    path = str(tmp_path / "p")
    with pytest.raises(manifest.NothingPublishedError):
        read_enriched(spark, path)
    publish_enriched(_days(spark, zones, [(1, 3), (2, 4)]), path)
    reader = read_enriched(spark, path)  # planned before the next publications, read after them
    publish_enriched(_days(spark, zones, [(2, 1), (5, 6)]), path, replace_dates_only=True)
    publish_enriched(_days(spark, zones, [(6, 2)]), path, replace_dates_only=True, covers=["2025-12-01"])
    assert reader.count() == 7
    by_day = {str(r.trip_date): r["count"] for r in read_enriched(spark, path).groupBy("trip_date").count().collect()}
    assert by_day == {"2025-12-02": 1, "2025-12-05": 6, "2025-12-06": 2}
    assert len(os.listdir(f"{path}/data")) == 3
    assert len(manifest.vacuum(spark, path, keep=1)) == 1  # the first load has no date left
    assert read_enriched(spark, path).count() == 9


def test_a_manifest_number_is_taken_once_and_half_written_ones_do_not_count(spark, zones, tmp_path):
    path = str(tmp_path / "p")
    publish_enriched(_days(spark, zones, [(1, 3)]), path)
    with open(f"{path}/manifest/000000000002.json", "w") as f:
        f.write('{"version": 2, "lo')
    assert read_enriched(spark, path).count() == 3
    with pytest.raises(manifest.ConcurrentPublishError):
        publish_enriched(_days(spark, zones, [(1, 5)]), path)
    assert read_enriched(spark, path).count() == 3


def test_publish_evaluates_its_input_once(spark, zones, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    e = _days(spark, zones, [(1, 300), (2, 40)])
    publish_enriched(e.mapInArrow(look, e.schema), str(tmp_path / "p"))
    assert seen.value == 340


def test_day_states_equal_the_batch_after_late_and_repeated_loads(spark, zones, tmp_path):
    path = str(tmp_path / "days")
    final = {1: (5, 15.0), 2: (7, 9.0), 3: (4, 15.0), 9: (6, 21.5)}
    publish_days(_days(spark, zones, [(9, 6)], 21.5), path)
    publish_days(_days(spark, zones, [(2, 3), (4, 2)], 11.0), path)  # day 2 in part, day 4 by mistake
    publish_days(_days(spark, zones, [(1, 5), (3, 4)]), path)  # late
    for _ in range(2):  # corrected, and delivered twice
        publish_days(_days(spark, zones, [(2, 7)], 9.0), path, covers=["2025-12-04"])
    batch = None
    for day, (n, pay) in final.items():
        part = _days(spark, zones, [(day, n)], pay)
        batch = part if batch is None else batch.unionByName(part)
    rows = lambda df: [tuple(r) for r in df.collect()]
    assert rows(day_trend(spark, path, P)) == rows(daily_revenue_trend(batch, P))
    assert rows(day_peaks(spark, path, P)) == rows(peak_vs_trough(batch, P))
    plan = day_trend(spark, path, P)._jdf.queryExecution().executedPlan().toString()
    assert "PULocationID" not in plan  # states, not trips


def test_rejects_and_trips_are_all_rows_read(spark, tmp_path):
    columns = [f.name for f in TRIPS_SCHEMA.fields if f.name != "trip_id"]
    good = {c: "" for c in columns} | {"hvfhs_license_num": "HV0003", "trip_miles": "3.5", "trip_time": "600", "driver_pay": "9.999", "wav_request_flag": "y"}
    lines = [good, good | {"driver_pay": "nine"}, good | {"driver_pay": "x", "trip_time": "1.5h", "PULocationID": "12"}, good | {"request_datetime": "yesterday"}, good | {"tips": "1e30"}]
    text = [",".join(columns), *[",".join(r[c] for c in columns) for r in lines], ",".join(columns[:0] + ["HV0003", "", ""])]
    path = tmp_path / "extract.csv"
    path.write_text("\n".join(text) + "\n")
    trips, rejects = read_trips_checked(spark, str(path), fmt="csv")
    got = rejects.collect()
    assert trips.count() + len(got) == len(text) - 1 == 6
    assert trips.count() == 1 and trips.first().wav_request_flag == "Y" and str(trips.first().driver_pay) == "10.00"
    assert sorted(tuple(r.reasons) for r in got) == [
        ("driver_pay is no decimal(12,2)",),
        ("line does not have the header's columns",),
        ("request_datetime is no timestamp_ntz",),
        ("tips is no decimal(12,2)",),
        ("trip_time is no bigint", "driver_pay is no decimal(12,2)"),
    ]
    assert any('"driver_pay":"nine"' in r.row for r in got)
    counts = {r.reason: r.rows for r in reject_counts(rejects).collect()}
    assert counts["driver_pay is no decimal(12,2)"] == 2 and sum(counts.values()) == 6


def test_rejects_of_typed_columns(spark, tmp_path):
    path = str(tmp_path / "typed")
    ok = trips_df(spark, [trip(1), trip(2)])
    wide = ok.withColumn("tips", F.when(F.col("trip_id") == 1, F.lit(float("nan"))).otherwise(F.lit(1.25)))
    wide.write.parquet(path)
    trips, rejects = read_trips_checked(spark, path)
    assert [r.trip_id for r in trips.collect()] == [2] and [r.reasons for r in rejects.collect()] == [["tips is no decimal(12,2)"]]


def test_export_of_a_sorted_result_is_in_order_over_its_files(spark, tmp_path):
    out = str(tmp_path / "sorted")
    rows = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5003).alias("k"))
    export(rows.repartitionByRange(4, "k").sortWithinPartitions("k"), out)
    names = sorted(f for f in os.listdir(out) if f.endswith(".csv"))
    got = [int(line) for n in names for line in open(f"{out}/{n}").read().split()[1:]]
    assert len(names) == 4 and got == sorted(got) and len(got) == 5000
