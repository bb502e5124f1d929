"""Operator 9: approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: rotations learned on a bounded sample (iterative
quantization from several starts), one bit per rotated axis.  For the largest
inner product each indexed vector first gains one axis that lifts it to the
table's largest norm, and queries a zero there, so that angles order as inner
products do.  Codes are split into 16-bit substrings, and every index block
has a table from substring value to its codes for each.  By the pigeonhole
principle a code within Hamming radius r of the query is within r // m of it
in some substring (one less after the first r % m + 1), so probing those
values retrieves every code within the radius; these are reranked by their
inner products in double precision.

The radius is learned too: the distance that covers RECALL of the true
neighbours within the sample.  A query that finds fewer than k codes is
searched again over all codes.  Queries (vec_id divisible by 20) meet all
rows block by block: a task builds the tables of one index block and probes
them for a few thousand queries, a batch at a time; a block keeps its k best
per query, and Spark merges them.

Defined results: invalid vectors (null, zero, null or non-finite components)
and null ids take no part; vectors of another length than the query's are
not compared with it; ties go to the smaller vec_id.  A vec_id on several
rows is one candidate and one query: rows that repeat change nothing, and of
different vectors the pair with the largest product counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import embeddings, saved
from .vector_dedup import valid

K = 20
#: Rows the rotations and the radius are fitted on at most.
SAMPLE = 4096
BITS, STARTS, ROUNDS, RECALL = 256, 4, 8, 0.985
#: Rows of an index block, queries that meet it in one task (its tables are built once for them), queries compared at once.
INDEX_ROWS, QUERY_ROWS, BATCH = 8192, 4096, 128


def _lift(x: np.ndarray, top: float | None) -> np.ndarray:
    """Unit vectors with the extra axis; top is the table's largest norm, None for queries."""
    extra = np.zeros(len(x)) if top is None else np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0))
    y = np.column_stack((x, extra))
    return y / np.linalg.norm(y, axis=1, keepdims=True)


class Coder:
    """Learned rotations and radius."""

    def __init__(self, sample: np.ndarray, top: float):
        self.top, dim = top, sample.shape[1]
        x = _lift(sample, top)
        rng = np.random.default_rng(0)
        self.mean = x.mean(axis=0)
        centred = x - self.mean
        parts = []
        for _ in range(max(STARTS, -(-BITS // (dim + 1)))):
            turn = np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0]
            for _ in range(ROUNDS):  # signs for the rotation, then the rotation for the signs
                u, _, v = np.linalg.svd(np.sign(centred @ turn).T @ centred)
                turn = (u @ v).T
            parts.append(turn)
        self.turn = np.hstack(parts)[:, :BITS]
        self.bits = BITS
        q, codes = self.code(sample, query=True), self.code(sample, query=False)
        near, ask = [], range(0, len(sample), max(1, len(sample) // 256))
        score = sample[list(ask)] @ sample.T
        for a, s in zip(ask, score, strict=True):
            s[a] = -np.inf
            best = np.argsort(-s)[: min(K, len(s) - 1)]
            near.append(np.bitwise_count(codes[best] ^ q[a]).sum(axis=1, dtype=int))
        near = np.concatenate(near) if near else np.zeros(0)
        self.radius = int(np.quantile(near, RECALL)) if len(near) else self.bits

    def code(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(rows, substrings) of 16 bits."""
        bits = (_lift(x, None if query else self.top) - (0 if query else self.mean)) @ self.turn > 0
        return np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.uint16)


class Block:
    """Tables from substring value to codes for one block of the index."""

    def __init__(self, codes: np.ndarray):
        #: Per substring its distinct values, and for each code the number of its value.
        self.tables = [np.unique(codes[:, j], return_inverse=True) for j in range(codes.shape[1])]
        self.rows = len(codes)

    def within(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """(queries, rows): whether a code is within ``radius`` of a query's.

        Each table is probed once for the batch: its values near enough to a
        query's substring lead to their codes, whose distances add up on the way.
        """
        m = len(self.tables)
        hit = np.zeros((len(queries), self.rows), bool)
        total = np.zeros((len(queries), self.rows), np.uint16)
        for j, (values, value_of) in enumerate(self.tables):
            apart = np.take(np.bitwise_count(queries[:, j, None] ^ values[None, :]), value_of, axis=1)
            total += apart
            p = radius // m - (j > radius % m)
            if p >= 0:
                hit |= apart <= p
        return hit & (total <= radius)


def _best(ids: np.ndarray, x: np.ndarray, rows: np.ndarray, vec: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of ``rows``, each id once, ties to the smaller id.

    slack is more than rounding can change in a product.
    """
    rough = x[rows] @ vec
    if len(rows) > 4 * k:  # exact scores only for rows that can be among the k best ids
        # The threshold counts ids, since one id may have several rows.
        order = np.argsort(-rough, kind="stable")
        n = 4 * k
        while n < len(order) and len(np.unique(ids[rows[order[:n]]])) < k:
            n *= 4
        seen = np.sort(np.unique(ids[rows[order[:n]]], return_index=True)[1])
        if len(seen) >= k:
            least = rough[order[seen[k - 1]]]
            rows = rows[rough >= least - slack]
    score = (x[rows] * vec).sum(axis=1)
    order = np.lexsort((ids[rows], -score))
    first = np.sort(np.unique(ids[rows[order]], return_index=True)[1])[:k]
    return ids[rows[order[first]]], score[order[first]]


def _search(queries: DataFrame, index: DataFrame, coder: Coder, dim: int, radius: int, n_index: int, n_query: int, k: int) -> DataFrame:
    """k best of every (query, index block): query_id, vec_id, score."""
    ib, qb = max(1, -(-n_index // INDEX_ROWS)), max(1, -(-n_query // QUERY_ROWS))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "embedding", F.expr(f"int(pmod(xxhash64(vec_id), {qb}))").alias("q"), spread(ib).alias("i"))
    right = index.select("vec_id", "embedding", F.expr(f"int(pmod(xxhash64(vec_id), {ib}))").alias("i"), spread(qb).alias("q"))

    def matrix(t: pa.Table) -> np.ndarray:
        return np.asarray(t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if a.num_rows and b.num_rows:
            ids, x = b.column("vec_id").to_numpy(), matrix(b)
            block = Block(coder.code(x, query=False))
            qids, q = a.column("vec_id").to_numpy(), matrix(a)
            codes = coder.code(q, query=True)
            for at in range(0, len(q), BATCH):
                near = block.within(codes[at : at + BATCH], radius)
                near &= qids[at : at + BATCH, None] != ids[None, :]
                for r, hit in enumerate(near, at):
                    found, score = _best(ids, x, np.flatnonzero(hit), q[r], k, 1e-9 * coder.top * coder.top)
                    for o, v in zip(out, (np.full(len(found), qids[r]), found, score), strict=True):
                        o.append(v)
        return pa.table({c: np.concatenate(o) for c, o in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return left.groupBy("i", "q").cogroup(right.groupBy("i", "q")).applyInArrow(both, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the queries among vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    # Single-precision vectors travel as they are; products are in double precision.
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType())
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if single else "array<double>"))
    rows = rows.where(valid("embedding") & F.col("vec_id").isNotNull())
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    about = rows.groupBy(F.size("embedding").alias("d")).agg(F.max(norm).alias("top"), F.count("*").alias("n"), F.count_if(F.col("vec_id") % 20 == 0).alias("q")).collect()
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for a in about:  # one pass per vector length
        index = rows.where(F.size("embedding") == a.d)
        queries = index.where("vec_id % 20 = 0")
        sample = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
        coder = Coder(np.unique(np.array([r.embedding for r in sample], np.float64).reshape(-1, a.d), axis=0), a.top)
        first = saved(_search(queries, index, coder, a.d, coder.radius, a.n, a.q, k), "neighbours")
        # Fewer than k found: all codes are within the widest radius.
        few = first.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= min(k, a.n - 1)).select(F.col("query_id").alias("vec_id"))
        short = saved(queries.join(few, "vec_id", "left_anti"), "short")
        n_short = short.count()
        if n_short:
            again = _search(short, index, coder, a.d, coder.bits, a.n, n_short, k)
            first = first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
        found = found.unionByName(first)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # a query id may have several rows
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(embeddings(spark, sf_dir))
