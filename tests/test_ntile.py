"""The scalable NTILE equals Spark's built-in ntile (same order, same tie-break)."""

from __future__ import annotations

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from farelens.operators.ntile import assign_tiles, cut_ranges, tile_of, tile_sums
from farelens.sources.scratch import saved


def _check(spark, rows, tiles, rows_per_task=2_000_000):
    df = spark.createDataFrame(rows, "p string, x decimal(12,2), id long")
    ours = assign_tiles(df, tiles, "p", "x", "id", "t", rows_per_task=rows_per_task).select("p", "id", "t")
    ref = df.select("p", "id", F.ntile(tiles).over(Window.partitionBy("p").orderBy("x", "id")).alias("t"))
    a = sorted(tuple(r) for r in ours.collect())
    b = sorted(tuple(r) for r in ref.collect())
    assert a == b


def test_small_partitions_and_ties(spark):
    rng = random.Random(3)
    rows = []
    for p, n, distinct in [("a", 7, 7), ("b", 10, 3), ("c", 23, 5), ("d", 1, 1), ("e", 3, 1)]:
        for i in range(n):
            rows.append((p, Decimal(rng.randint(0, distinct - 1)) + Decimal("0.25"), i * 13 % 97))
    _check(spark, rows, 10)


def test_many_rows_heavy_ties(spark):
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        p = "big" if i % 3 else "small"
        # a third of the big partition shares one fare: straddles several tiles
        x = Decimal("12.50") if (p == "big" and i % 2 == 0) else Decimal(rng.randint(-500, 20000)) / 100
        rows.append((p, x, rng.randint(0, 10**9) * 10 + (i % 10)))
    _check(spark, rows, 10)
    _check(spark, rows, 4)


def test_hot_straddling_group_split_into_ranges(spark):
    """A fare shared by a third of the rows is ranked in many small ranges."""
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        x = Decimal("9.99") if i % 3 == 0 else Decimal(rng.randint(0, 5000)) / 100
        rows.append(("p", x, rng.randint(0, 10**6)))  # duplicate ids within the hot fare are fine
    rows = [(p, x, i * 1000 + k % 1000) for i, (p, x, k) in enumerate(rows)]
    _check(spark, rows, 10, rows_per_task=37)


@pytest.mark.parametrize("rows_per_task", [5, 20, 2_000_000])
def test_null_partition_order_and_tiebreak(spark, rows_per_task):
    """NULLs sort first and no row is lost, however the ranges are cut."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        p = None if i % 5 == 0 else "pq"[i % 2]
        x = None if i % 3 == 0 else Decimal(rng.randint(0, 3))
        rows.append((p, x, None if i % 41 == 0 else i))
    df = spark.createDataFrame(rows, "p string, x decimal(12,2), id long").withColumn("v", F.lit(1).cast("long"))
    key = ["p", "x", "id"]
    ref = df.select(*key, F.ntile(7).over(Window.partitionBy("p").orderBy("x", "id")).alias("t"))
    ours = assign_tiles(df, 7, "p", "x", "id", "t", rows_per_task=rows_per_task).select(*key, "t")
    assert Counter(map(tuple, ours.collect())) == Counter(map(tuple, ref.collect()))

    sums = tile_sums(df, 7, "p", "x", "id", {"v": F.col("v")}, "t", rows_per_task=rows_per_task)
    want = ref.groupBy("p", "t").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    got = sums.select("p", "t", "_rows", "x_min", "x_max")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_outliers_nulls_and_ties_in_the_tiebreak_leave_ranges_balanced(spark):
    """Ranges follow sampled quantiles of the whole key, so one far id, NULL ids or equal ids make no large range."""
    rows = [("p", Decimal(1), k) for k in range(6000)] + [("p", Decimal(1), 10**15)] * 3
    rows += [("p", Decimal(1), None)] * 9000 + [("p", Decimal(1), 77)] * 5000
    df = spark.createDataFrame(rows, "p string, x decimal(12,2), id long").repartition(4).withColumn("_row", F.monotonically_increasing_id())
    ranged = cut_ranges(saved(df, "rows"), ["p", "x", "id", "_row"], len(rows), 1000)
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 2 * 1000


def test_hot_group_with_null_and_equal_ids(spark):
    rng = random.Random(13)
    rows = [("p", Decimal(5), None if i % 2 else rng.choice([1, 2, 10**14])) for i in range(2000)]
    rows += [("p", Decimal(i % 50), i) for i in range(2500)]
    df = spark.createDataFrame(rows, "p string, x decimal(12,2), id long").withColumn("v", F.lit(1).cast("long"))
    key = ["p", "x", "id"]
    ref = df.select(*key, F.ntile(10).over(Window.partitionBy("p").orderBy("x", "id")).alias("t"))
    ours = assign_tiles(df, 10, "p", "x", "id", "t", rows_per_task=100).select(*key, "t")
    assert Counter(map(tuple, ours.collect())) == Counter(map(tuple, ref.collect()))


def test_input_is_evaluated_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("ab"[i % 2], Decimal(i % 37), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "p string, x decimal(12,2), id long")
    watched = df.mapInArrow(look, df.schema)
    for run in (
        lambda: tile_sums(watched, 10, "p", "x", "id", {"v": F.col("id")}, "t", rows_per_task=10).collect(),
        lambda: assign_tiles(watched, 10, "p", "x", "id", "t", rows_per_task=10).collect(),
    ):
        before = seen.value
        run()
        assert seen.value - before == len(rows)


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 25])
def test_tile_of_every_rank(spark, n):
    df = spark.range(1, n + 1).withColumn("n", F.lit(n).cast("long"))
    ref = df.select("id", F.ntile(10).over(Window.orderBy("id")).alias("t"))
    ours = df.select("id", tile_of(F.col("id"), F.col("n"), 10).alias("t"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, ref.collect()))
