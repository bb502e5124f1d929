"""Scalable exact NTILE.

``NTILE(n) OVER (PARTITION BY p ORDER BY x, tiebreak)`` as a window sends
every row of a partition value to one task; with a handful of platforms
that is a handful of tasks for the whole trip table.  This operator gives
the same tiles without that:

1. The input is evaluated once: the columns needed, with a row number, are
   written to the shared folder, and every later step reads that table.
2. Histogram of (p, x) with the sums asked for: a partial + final
   aggregation whose size is the number of distinct x values, not rows.
3. Exact start rank of every (p, x) group by prefix sums over the
   histogram, in two levels (whole units of x, then x within a unit), so
   no window holds more than one unit's distinct values or the unit list.
4. The tile of a rank is plain arithmetic on the rank and the size of p,
   so a group whose first and last rank share a tile is done.
5. The other groups straddle a boundary, at most tiles - 1 per p.  Their
   rows are cut into ranges at sampled quantiles of the whole key (p, x,
   tie-break, row number), as many as their rows / ``rows_per_task``.  The
   row number makes every key unique, so outliers, ties or NULLs in the
   tie-break cannot unbalance the ranges, and one fare shared by a third
   of all trips is ranked by many tasks.  Exact counts per range give each
   range's offset.

Nothing is collected; the boundaries are a table of one row per p, which
is broadcast only when its counted rows are within ``BROADCAST_ROWS``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farelens.sources.scratch import saved

#: Partition values whose boundaries are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 10_000


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join in which NULL keys meet, keeping the left side's keys."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, on).drop(*[f"_r_{k}" for k in keys])


def _prefix_before(count: Column, window: Window) -> Column:
    return F.coalesce(
        F.sum(count).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")
    )


def group_ranks(hist: DataFrame, partition: str, order: str) -> DataFrame:
    """``hist`` (p, x, _cnt, ...) plus the 1-based ``_start`` rank of each group and the size ``_n`` of p."""
    hist = hist.withColumn("_unit", F.floor(F.col(order)))
    units = hist.groupBy(partition, "_unit").agg(F.sum("_cnt").alias("_ucnt"))
    u_win = Window.partitionBy(partition).orderBy("_unit")
    units = units.select(
        partition,
        "_unit",
        _prefix_before(F.col("_ucnt"), u_win).alias("_before_unit"),
        F.sum("_ucnt").over(Window.partitionBy(partition)).alias("_n"),
    )
    x_win = Window.partitionBy(partition, "_unit").orderBy(order)
    hist = hist.withColumn("_before_x", _prefix_before(F.col("_cnt"), x_win))
    ranked = _join(hist, units, [partition, "_unit"])
    return ranked.withColumn("_start", F.col("_before_unit") + F.col("_before_x") + 1).drop("_unit", "_before_unit", "_before_x")


def tile_of(rank: Column, n: Column, tiles: int) -> Column:
    """NTILE's tile of a 1-based rank among n rows: the first n mod tiles tiles hold one row more."""
    t = F.lit(tiles).cast("long")
    size, more = F.call_function("div", n, t), n % t
    large = more * (size + 1)
    first = F.call_function("div", rank - 1, size + 1)
    rest = more + F.call_function("div", rank - 1 - large, F.nullif(size, F.lit(0)))
    return (F.when(rank <= large, first).otherwise(rest) + 1).cast("int")


def _last_rank(tiles: int, k: int) -> Column:
    """The last rank of tile k among ``_n`` rows."""
    size, more = F.call_function("div", F.col("_n"), F.lit(tiles).cast("long")), F.col("_n") % tiles
    return size * k + F.least(F.lit(k).cast("long"), more)


def tile_bounds(ranks: DataFrame, partition: str, order: str, tiles: int) -> DataFrame:
    """One row per p: for boundary k its group's x (``_x{k}``), the boundary's position in that group
    (``_j{k}``) and whether the group goes on behind it (``_s{k}``)."""
    aggs = []
    for k in range(1, tiles):
        end = _last_rank(tiles, k)
        here = (end >= F.col("_start")) & (end < F.col("_start") + F.col("_cnt"))
        at = end - F.col("_start") + 1
        aggs += [
            F.max(F.when(here, F.col(order))).alias(f"_x{k}"),
            F.max(F.when(here, at)).alias(f"_j{k}"),
            F.max(F.when(here, at < F.col("_cnt"))).alias(f"_s{k}"),
        ]
    return ranks.groupBy(partition).agg(*aggs)


def _with_bounds(df: DataFrame, bounds: DataFrame, partition: str, n_bounds: int) -> DataFrame:
    return _join(df, F.broadcast(bounds) if n_bounds <= BROADCAST_ROWS else bounds, [partition])


def _past(x: Column, k: int) -> Column:
    """x lies past boundary k by its value alone; NULL sorts first."""
    bound = F.col(f"_x{k}")
    return x.isNotNull() & (bound.isNull() | F.coalesce(x > bound, F.lit(False)))


def _straddles(x: Column, tiles: int) -> Column:
    """x is a value that goes on behind one of its partition value's boundaries."""
    out = F.lit(False)
    for k in range(1, tiles):
        out = out | (F.col(f"_s{k}") & x.eqNullSafe(F.col(f"_x{k}")))
    return out


def _tile_by_bounds(x: Column, pos: Column | None, tiles: int) -> Column:
    """1 + the boundaries a row lies past; ``pos`` is its position among the rows of its x, where that matters."""
    out = F.lit(1)
    for k in range(1, tiles):
        past = _past(x, k)
        if pos is not None:
            past = past | (x.eqNullSafe(F.col(f"_x{k}")) & (pos > F.col(f"_j{k}")))
        out = out + F.when(past, 1).otherwise(0)
    return out.cast("int")


def cut_ranges(rows: DataFrame, key: Sequence[str], n_rows: int, rows_per_task: int) -> DataFrame:
    """``rows`` plus ``_range``, written: consecutive ranges of ``key`` (unique per row) at sampled quantiles."""
    # A fifth more ranges than the target needs keeps the largest, sampled as they are, well under twice the target.
    n = max(1, -(-n_rows * 6 // (5 * rows_per_task)))
    if n == 1:
        return saved(rows.withColumn("_range", F.lit(0)), "ntile-ranges")
    return saved(rows.repartitionByRange(n, *key).withColumn("_range", F.spark_partition_id()), "ntile-ranges")


def rank_in_groups(
    rows: DataFrame, partition: str, order: str, tiebreak: Sequence[str], n_rows: int, rows_per_task: int
) -> DataFrame:
    """1-based position ``_pos`` of each row inside its (partition, order) group by ``tiebreak`` and ``_row``."""
    group = [partition, order]
    ranged = cut_ranges(rows, [*group, *tiebreak, "_row"], n_rows, rows_per_task)
    sizes = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_rcnt"))
    before = _prefix_before(F.col("_rcnt"), Window.partitionBy(*group).orderBy("_range")).alias("_before")
    placed = _join(ranged, sizes.select(*group, "_range", before), [*group, "_range"])
    pos = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*tiebreak, "_row")) + F.col("_before")
    return placed.withColumn("_pos", pos).drop("_before", "_range")


def _prepare(
    df: DataFrame, partition: str, order: str, tiles: int, sums: dict[str, Column]
) -> tuple[DataFrame, DataFrame, DataFrame, int, int]:
    """(rows written once, group ranks, boundaries, partition values, rows of straddling groups)."""
    rows = saved(df.withColumn("_row", F.monotonically_increasing_id()), "ntile-rows")
    hist = rows.groupBy(partition, order).agg(F.count(F.lit(1)).alias("_cnt"), *[F.sum(e).alias(n) for n, e in sums.items()])
    ranks = group_ranks(saved(hist, "ntile-histogram"), partition, order)
    ranks = ranks.withColumn("_tile", tile_of(F.col("_start"), F.col("_n"), tiles))
    last = tile_of(F.col("_start") + F.col("_cnt") - 1, F.col("_n"), tiles)
    ranks = saved(ranks.withColumn("_split", F.col("_tile") != last), "ntile-ranks")
    bounds = saved(tile_bounds(ranks, partition, order, tiles), "ntile-bounds")
    n_split = ranks.where("_split").agg(F.coalesce(F.sum("_cnt"), F.lit(0))).first()[0]
    return rows, ranks, bounds, bounds.count(), n_split


def assign_tiles(
    df: DataFrame,
    tiles: int,
    partition: str,
    order: str,
    tiebreak: str | Sequence[str],
    out: str,
    rows_per_task: int = 2_000_000,
) -> DataFrame:
    """``df`` plus ``out`` = NTILE(tiles) over (partition, order by order, tiebreak); df is evaluated once, by this call."""
    tb = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    rows, _, bounds, n_bounds, n_split = _prepare(df, partition, order, tiles, {})
    x = F.col(order)
    placed = _with_bounds(rows, bounds, partition, n_bounds)
    outside = placed.where(~_straddles(x, tiles)).select(*df.columns, _tile_by_bounds(x, None, tiles).alias(out))
    inside = rank_in_groups(placed.where(_straddles(x, tiles)).select(rows.columns), partition, order, tb, n_split, rows_per_task)
    inside = _with_bounds(inside, bounds, partition, n_bounds)
    return outside.unionByName(inside.select(*df.columns, _tile_by_bounds(x, F.col("_pos"), tiles).alias(out)))


def tile_sums(
    df: DataFrame,
    tiles: int,
    partition: str,
    order: str,
    tiebreak: str | Sequence[str],
    sums: dict[str, Column],
    out: str,
    rows_per_task: int = 2_000_000,
) -> DataFrame:
    """Per (partition, tile): row count ``_rows``, min/max of ``order`` and SUM of each ``sums`` expression.

    Same tiles as ``assign_tiles`` without tiling every row: the (p, x)
    histogram carries the sums, whole groups take their tile from their
    first rank, and only rows of straddled x values are ranked and summed
    row by row.  df is evaluated once, by this call.
    """
    tb = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak)
    names, x = list(sums), F.col(order)
    keep = list(dict.fromkeys([partition, order, *tb]))
    narrow = df.select(*keep, *[e.alias(n) for n, e in sums.items()])
    rows, ranks, bounds, n_bounds, n_split = _prepare(narrow, partition, order, tiles, {n: F.col(n) for n in names})
    whole = ranks.where("NOT _split").select(
        partition, F.col("_tile").alias(out), F.col("_cnt").alias("_rows"), x.alias("_min"), x.alias("_max"), *names
    )
    split = _with_bounds(rows, bounds, partition, n_bounds).where(_straddles(x, tiles)).select(rows.columns)
    ranked = _with_bounds(rank_in_groups(split, partition, order, tb, n_split, rows_per_task), bounds, partition, n_bounds)
    pieces = ranked.groupBy(partition, _tile_by_bounds(x, F.col("_pos"), tiles).alias(out)).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(x).alias("_min"), F.max(x).alias("_max"), *[F.sum(n).alias(n) for n in names]
    )
    return (
        whole.unionByName(pieces)
        .groupBy(partition, out)
        .agg(
            F.sum("_rows").alias("_rows"),
            F.min("_min").alias(f"{order}_min"),
            F.max("_max").alias(f"{order}_max"),
            *[F.sum(n).alias(n) for n in names],
        )
    )
