"""Operator 7: embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length one, where cosine >= 0.9 is a distance of at
most epsilon, and turned to principal axes fitted on a bounded sample (the
fit only steers the order, never a result).  They are sorted by their grid
cells (width epsilon) on the leading axes and cut into consecutive intervals:
partitions, and blocks within them.  Pairs of intervals are joined
recursively, partitions first and then their blocks, and a pair whose
bounding boxes are more than epsilon apart is skipped.  Remaining block pairs
are compared in full by matrix products, in double precision near the
threshold.

A block pair emits per vector its number of links and one link to the
smallest vector of its local component, never all pairs, so a large cluster
costs rows in proportion to its size.  Equal vectors are compared once.

Defined results: vectors that are null, zero, or hold null or non-finite
components have no links and are their own component; so has a vector whose
length differs from the others' (compared among its own length only).  Every
row comes back; rows that repeat an id and its vector count as one vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._store import embeddings, saved, shuffle_width

COSINE = 0.9
#: Vectors the axes are fitted on at most; leading axes that make the grid; vectors a block.
SAMPLE, AXES, BLOCK_ROWS = 4096, 6, 2048
#: Single-precision products this near the threshold are computed again in double precision.
MARGIN = 1e-4


def valid(column: str) -> F.Column:
    """Vector has components, all finite, and is not zero."""
    c = F.col(column)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def fit_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Principal axes (columns, largest first) of at most SAMPLE unit vectors, chosen by hash."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").collect()
    x = np.array([r.embedding for r in rows], np.float64).reshape(-1, dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(dim))[1][:, ::-1].copy()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_BLOCKS = "part int, block long, ids binary, copies binary, vectors binary, low array<double>, high array<double>"


def _blocks(vectors: DataFrame, dim: int, eps: float) -> DataFrame:
    """Epsilon grid order cut into blocks of consecutive vectors, each with its bounding box on the axes."""
    axes = fit_axes(vectors, dim)[:, : min(AXES, dim)]
    cells = [f"c{k}" for k in range(axes.shape[1])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.floor(_unit(_matrix(b.column("embedding"), dim)) @ axes / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, at.T.copy())], names=[*b.schema.names, *cells])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def block(table: pa.Table) -> pa.RecordBatch:
            x = _matrix(table.column("embedding").combine_chunks(), dim)
            at = _unit(x) @ axes
            return pa.record_batch(
                [
                    pa.array([part], pa.int32()), pa.array([part * (1 << 32) + seq], pa.int64()),
                    [table.column("id").to_numpy().tobytes()], [table.column("n").to_numpy().tobytes()], [x.tobytes()],
                    pa.array([at.min(axis=0).tolist()]), pa.array([at.max(axis=0).tolist()]),
                ],
                names=["part", "block", "ids", "copies", "vectors", "low", "high"],
            )

        for b in batches:
            held.append(b.select(["id", "n", "embedding"]))
            rows += b.num_rows
            while rows >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, BLOCK_ROWS))
                seq += 1
                held, rows = table.slice(BLOCK_ROWS).to_batches(), rows - BLOCK_ROWS
        if rows:
            yield block(pa.Table.from_batches(held))

    placed = vectors.mapInArrow(place, "id long, n long, embedding array<double>, " + ", ".join(f"{c} int" for c in cells))
    n = max(1, -(-vectors.count() // (4 * BLOCK_ROWS)))
    ordered = placed.repartitionByRange(n, *cells, "id").sortWithinPartitions(*cells, "id")
    return saved(ordered.mapInArrow(cut, _BLOCKS), "grid-blocks")


def _near(a: str, b: str, eps: float) -> F.Column:
    """Whether two bounding boxes are at most eps apart (with room for rounding)."""
    gap = F.expr(
        f"aggregate(zip_with(zip_with({a}low, {b}high, (l, h) -> l - h), zip_with({b}low, {a}high, (l, h) -> l - h), "
        "(x, y) -> greatest(x, y, double(0))), double(0), (s, g) -> s + g * g)"
    )
    return gap <= eps * eps * (1 + 1e-9) + 1e-12


def _interval_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b) with a <= b: block pairs that may hold a link, by recursion from the partitions' boxes."""
    boxes = blocks.select("part", "block", "low", "high")
    k = range(AXES)
    size = F.size(F.first("low"))
    low = F.slice(F.array(*[F.min(F.get("low", F.lit(i))) for i in k]), F.lit(1), size)
    high = F.slice(F.array(*[F.max(F.get("high", F.lit(i))) for i in k]), F.lit(1), size)
    parts = boxes.groupBy("part").agg(low.alias("low"), high.alias("high"))
    # Intervals meet where their cells on the first axis do, or are next to each other.
    cell = lambda c, d: F.floor(F.get(c, F.lit(0)) / eps).cast("int") + d
    x = parts.select(*[F.col(c).alias(f"x{c}") for c in parts.columns], F.explode(F.sequence(cell("low", -1), cell("high", 1))).alias("c"))
    y = parts.select(*[F.col(c).alias(f"y{c}") for c in parts.columns], F.explode(F.sequence(cell("low", 0), cell("high", 0))).alias("c"))
    top = x.join(y, "c").where((F.col("xpart") <= F.col("ypart")) & _near("x", "y", eps)).select("xpart", "ypart").distinct()
    x = boxes.select(*[F.col(c).alias(f"x{c}") for c in boxes.columns])
    y = boxes.select(*[F.col(c).alias(f"y{c}") for c in boxes.columns])
    leaf = top.join(x, "xpart").join(y, "ypart").where((F.col("xblock") <= F.col("yblock")) & _near("x", "y", eps))
    return leaf.select(F.col("xblock").alias("a"), F.col("yblock").alias("b"))


def local_links(x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of unit rows with x[i] . y[j] >= cosine."""
    i, j = np.nonzero(x.astype(np.float32) @ y.astype(np.float32).T >= np.float32(cosine - MARGIN))
    exact = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 100_000]], y[j[k : k + 100_000]]) for k in range(0, len(i), 100_000)] or [np.zeros(0)])
    return i[exact >= cosine], j[exact >= cosine]


def _compare(dim: int, cosine: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine = None, None
        for b in batches:
            for r in b.to_pylist():
                ids, copies = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["copies"], np.int64)
                x = _unit(np.frombuffer(r["vectors"], np.float64).reshape(-1, dim))
                if r["other"] is None:  # the owner comes first
                    own, mine = r["owner"], (ids, copies, x)
                    continue
                if own != r["owner"]:
                    raise ValueError("a block pair without its owner")
                same = r["other"] == own
                i, j = local_links(mine[2], x, cosine)
                if same:
                    i, j = i[i != j], j[i != j]
                if not len(i):
                    continue
                nodes = mine[0] if same else np.concatenate((mine[0], ids))
                weight = mine[1] if same else np.concatenate((mine[1], copies))
                j = j if same else j + len(mine[0])
                # For one block each link is there both ways already.
                count = np.bincount(i, weights=weight[j], minlength=len(nodes))
                if not same:
                    count += np.bincount(j, weights=weight[i], minlength=len(nodes))
                label = nodes.copy()
                while True:  # smallest reachable node within this pair of blocks
                    was = label.copy()
                    np.minimum.at(label, i, label[j])
                    np.minimum.at(label, j, label[i])
                    if (was == label).all():
                        break
                k = np.flatnonzero(count)
                yield pa.record_batch([nodes[k], count[k].astype(np.int64), label[k]], names=["id", "links", "to"])

    return compare


def _links(vectors: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(id, links, to) parts for distinct vectors (id, n, embedding) of one length."""
    eps = float(np.sqrt(2 - 2 * cosine))
    blocks = _blocks(vectors, dim, eps)
    pairs = _interval_pairs(blocks, eps)
    # Each pair is compared at one of its blocks; parity shares them out evenly.
    even = (F.xxhash64("a", "b") % 2) == 0
    owner, other = F.when(even, F.col("a")).otherwise(F.col("b")), F.when(even, F.col("b")).otherwise(F.col("a"))
    pairs = saved(pairs.select(owner.alias("owner"), other.alias("block")), "grid-pairs")
    data = blocks.select("block", "ids", "copies", "vectors")
    others = pairs.join(data, "block").select("owner", F.col("block").alias("other"), "ids", "copies", "vectors")
    owners = pairs.select(F.col("owner").alias("block")).distinct().join(data, "block")
    owners = owners.select(F.col("block").alias("owner"), F.lit(None).cast("long").alias("other"), "ids", "copies", "vectors")
    n = max(shuffle_width(vectors.sparkSession), 1)
    dealt = owners.unionByName(others).repartition(n, "owner").sortWithinPartitions("owner", F.col("other").asc_nulls_first())
    return dealt.mapInArrow(_compare(dim, cosine), "id long, links long, to long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vectors (vec_id, embedding): vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    good = rows.where(valid("embedding") & F.col("vec_id").isNotNull())
    distinct = saved(good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("n")).select("id", "n", "embedding"), "vectors")
    spark = vectors.sparkSession
    dims = [r.d for r in distinct.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]  # lengths in the table
    found = spark.createDataFrame([], "id long, links long, to long")
    for d in dims:
        found = found.unionByName(_links(distinct.where(F.size("embedding") == d), d, cosine))
    found = saved(found, "vector-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    per = distinct.join(counts, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    per = per.select(
        F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("c")
    )
    done = good.join(per, good.embedding == per.e).select("vec_id", "n_links", F.col("c").alias("component_id"))
    bad = rows.where(~valid("embedding") | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(bad).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(embeddings(spark, sf_dir))
