"""Operator 12: product codes of vectors, every part assigned by equal-average search.

Components become integers (``floor(4096 * x)``), vectors are cut into equal
consecutive parts, and each part position has a codebook of integer entries,
so every distance, sum and tie is exact.  A codebook is ordered by its
entries' component sums.  For two parts of d components the squared gap of
their sums is at most d times their squared distance; the search for a part
therefore starts at its own sum, expands outward to the entry of the next
smallest gap, and stops when the squared gap over d strictly exceeds the best
distance found.  Entries at an equal distance are all seen, and the lowest
index wins.

A round is one pass: tasks assign their vectors and emit the sums and counts
of each entry, which Spark adds up; only the new codebooks (parts x entries x
width integers, whatever the number of rows) come to the driver.

Defined results: vectors that are null or hold null or non-finite components
are left out, a zero vector is not.  Repeated rows each count.  First entries
come from the smallest distinct ids (of several vectors of one id the smallest
by components); null ids are coded, but give no first entry; with fewer ids
there are fewer entries; with none there are no codes.  The dimension is that
of the smallest id's vector, other lengths are left out, and a dimension that
the parts do not divide is an error.  Components of any finite size are exact;
an error beyond a LONG is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import embeddings, saved

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
_LIMB = 32
_LONG = 1 << 63


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), int64 where all fit with room for the sums of a search, else Python integers."""
    scaled = np.floor(x * SCALE)
    top = float(np.abs(scaled).max()) if scaled.size else 0.0
    if top * 4 * max(x.shape[-1], 1) < 1 << 30:
        return scaled.astype(np.int64)
    whole = [int(v // 1) if abs(v) < 1 << 51 else int(u) * SCALE for u, v in zip(x.reshape(-1).tolist(), scaled.reshape(-1).tolist(), strict=True)]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(x.shape)


class PartSearch:
    """Nearest entries of one part position's codebook, which is kept in order of the component sums."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.sums, self.entries = sums[self.order], entries[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index of the nearest entry, squared distance to it) of every row of x, and the distances computed."""
        entries, sums, order = self.entries, self.sums, self.order
        if x.dtype != entries.dtype:
            x, entries, sums = x.astype(object), entries.astype(object), sums.astype(object)
        (n, width), k = x.shape, len(order)
        own = x.sum(axis=1)
        high = np.searchsorted(sums, own)
        low = high - 1
        best, index = np.zeros(n, x.dtype), np.full(n, -1)
        rows, seen = np.arange(n), 0
        while len(rows):
            a, z, s = low[rows], high[rows], own[rows]
            below, above = s - sums[np.maximum(a, 0)], sums[np.minimum(z, k - 1)] - s
            down = (a >= 0) & ((z >= k) | (below <= above))
            gap = np.where(down, below, above)
            go = ((a >= 0) | (z < k)) & ((index[rows] < 0) | (gap * gap <= best[rows] * width)).astype(bool)
            rows, down = rows[go], down[go]
            at = np.where(down, low[rows], high[rows])
            apart = x[rows] - entries[at]
            far = (apart * apart).sum(axis=1)
            better = (index[rows] < 0) | (far < best[rows]) | ((far == best[rows]) & (order[at] < index[rows]))
            won = rows[better.astype(bool)]
            best[won], index[won] = far[better.astype(bool)], order[at[better.astype(bool)]]
            low[rows[down]] -= 1
            high[rows[~down]] += 1
            seen += len(rows)
        return index, best, seen


class Codebooks:
    """The entries of every part position: integers[part][entry][component]."""

    def __init__(self, entries: list[list[list[int]]]):
        self.entries = entries
        self.width = len(entries[0][0])
        big = max(abs(v) for part in entries for e in part for v in e) if self.width else 0
        kind = np.int64 if big * 4 * max(self.width, 1) < 1 << 30 else object
        self._search = [PartSearch(np.array(part, kind).reshape(len(part), self.width)) for part in entries]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances) of integer vectors, a column a part."""
        found = [s.nearest(x[:, p * self.width : (p + 1) * self.width]) for p, s in enumerate(self._search)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The floats that codes stand for: the middle of each integer's step."""
        books = [np.array(part, np.float64).reshape(-1, self.width) for part in self.entries]
        return np.concatenate([(b[codes[:, p]] + 0.5) / SCALE for p, b in enumerate(books)], axis=1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for e in part for v in e).encode()).hexdigest()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return integers(np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim))


def kept_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, embedding) of the rows that take part, and their dimension (0: there is none)."""
    c = F.col("embedding")
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = saved(vectors.where(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long"), "label", "embedding"), "code-vectors")
    first = rows.where("vec_id is not null").agg(F.min(F.struct("vec_id", F.size("embedding").alias("dim"))).alias("first")).first().first
    dim = first.dim if first else 0
    return rows.where(F.size("embedding") == dim), dim


def _smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    kind = None
    for b in batches:
        kind = b.schema
        ids = b.column("vec_id").to_numpy(zero_copy_only=False)
        near = np.flatnonzero(ids <= np.unique(ids)[:ENTRIES][-1]) if len(ids) else []
        some = b.take(pa.array(near, pa.int64()))
        for i, v in zip(some.column("vec_id").to_pylist(), some.column("embedding").to_pylist(), strict=True):
            held[i] = min(held.get(i, v), v)
        held = {i: held[i] for i in sorted(held)[:ENTRIES]}
    if held:
        yield pa.record_batch([pa.array(list(held), kind.field("vec_id").type), pa.array(list(held.values()), kind.field("embedding").type)], schema=kind)


def first_entries(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES) -> Codebooks:
    """The parts of the smallest distinct ids' vectors; a task hands on its own smallest only."""
    some = rows.where("vec_id is not null").select("vec_id", "embedding")
    few = some.mapInArrow(_smallest, some.schema).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    first = few.orderBy("vec_id").limit(entries).collect()
    x = integers(np.array([r.embedding for r in first], np.float64).reshape(-1, dim)).tolist()
    w = dim // parts
    return Codebooks([[v[p * w : (p + 1) * w] for v in x] for p in range(parts)])


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """A total as numbers of a LONG's size: total = sum of value << (32 * limb)."""
    limb = 0
    while not -_LONG <= total < _LONG:
        yield limb, total & ((1 << _LIMB) - 1)
        total >>= _LIMB
        limb += 1
    yield limb, total


def _next_entries(rows: DataFrame, books: Codebooks, dim: int) -> Codebooks:
    """Codebooks with each used entry replaced by the floor of the mean of its parts."""
    width, names = books.width, ["part", "entry", "pos", "limb", "value", "n"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            x = _matrix(b.column("embedding"), dim)
            codes, _ = books.assign(x)
            for p in range(codes.shape[1]):
                part = x[:, p * width : (p + 1) * width]
                for e in np.unique(codes[:, p]).tolist():
                    own = part[codes[:, p] == e]
                    held = total.setdefault((p, e), [[0] * width, 0])
                    held[0] = [a + int(v) for a, v in zip(held[0], own.sum(axis=0).tolist(), strict=True)]
                    held[1] += len(own)
        out = [(p, e, pos, limb, v, n if limb == 0 else 0) for (p, e), (s, n) in total.items() for pos, t in enumerate(s) for limb, v in _limbs(t)]
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    found = rows.select("embedding").mapInArrow(sums, ", ".join(f"{c} long" for c in names))
    total = F.sum(F.col("value").cast("decimal(38,0)")).alias("total")
    new: dict[tuple[int, int, int], list[int]] = {}
    for r in found.groupBy(*names[:4]).agg(total, F.sum("n").alias("n")).collect():  # parts x entries x width rows
        held = new.setdefault((r.part, r.entry, r.pos), [0, 0])
        held[0] += int(Decimal(r.total)) << (_LIMB * r.limb)
        held[1] += r.n

    def value(p: int, e: int, pos: int, old: int) -> int:
        got = new.get((p, e, pos))
        return got[0] // got[1] if got else old

    return Codebooks([[[value(p, e, pos, v) for pos, v in enumerate(entry)] for e, entry in enumerate(part)] for p, part in enumerate(books.entries)])


def fit(rows: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of kept vectors after all rounds, over all rows."""
    if dim % parts:
        raise ValueError(f"{parts} equal parts do not cut {dim} components")
    books = first_entries(rows, dim, parts, entries)
    for _ in range(rounds):
        books = _next_entries(rows, books, dim)
    return books


def encode(rows: DataFrame, books: Codebooks, dim: int) -> DataFrame:
    """(vec_id, label, code, error): one byte a part, and the squared distances summed over the parts."""
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, far = books.assign(_matrix(b.column("embedding"), dim))
            error = [int(e) if e < _LONG else None for e in far.sum(axis=1).tolist()]
            cols = [b.column("vec_id"), b.column("label"), [c.tobytes() for c in codes.astype(np.uint8)], pa.array(error, pa.int64())]
            yield pa.record_batch(cols, names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id long, label {kind}, code binary, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, embedding) that codes stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            yield pa.record_batch([b.column("vec_id"), pa.array(list(books.vectors(at)), pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")


def compress(vectors: DataFrame) -> tuple[DataFrame, Codebooks | None]:
    """Codes (vec_id, label, code, error) of all kept vectors, written, and their codebooks (None: no vector has an id)."""
    rows, dim = kept_vectors(vectors)
    if not dim:
        return rows.limit(0).select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), None
    books = fit(rows, dim)
    return saved(encode(rows, books, dim), "codes"), books


def code_report(vectors: DataFrame) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Errors are summed by label first; the sums, one row a label, join back by label and a salt, so that a label that
    holds many rows is spread over SALTS keys if Spark shuffles that join.
    """
    codes, books = compress(vectors)
    sums = saved(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    salted = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    on = F.col("label").eqNullSafe(F.col("of")) & (F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)) == F.col("salt"))
    digest = F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256")
    return codes.join(salted, on).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest)


#: Keys that the rows of one label are spread over when their sums join back.
SALTS = 32


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(embeddings(spark, sf_dir))


def _oracle() -> str:
    """DuckDB statement of the same rows: plain nearest entries, one chain of CTEs a round."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
    SELECT rid, p, min(struct_pack(d := list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS m
    FROM parts JOIN c{r} USING (p) GROUP BY rid, p)""")
        if r < ROUNDS:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
    SELECT c{r}.p, c{r}.e, coalesce(n.y, c{r}.y) AS y FROM c{r} LEFT JOIN (
        SELECT p, e, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY k) AS y FROM (
            SELECT p, e, k, CAST(sum(x[k]) AS BIGINT) AS s, count(*) AS n
            FROM (SELECT p, m.e AS e, x, unnest(range(1, len(x) + 1)) AS k FROM a{r} JOIN parts USING (rid, p)) GROUP BY p, e, k)
        GROUP BY p, e) n ON n.p = c{r}.p AND n.e = c{r}.e)""")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (
    SELECT rid, vec_id, CAST(t.p AS BIGINT) AS p, q[t.p * len(q) // {PARTS} + 1 : (t.p + 1) * len(q) // {PARTS}] AS x FROM kept, range({PARTS}) t(p)),
c0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS y FROM parts
    WHERE vec_id IN (SELECT DISTINCT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
{", ".join(steps)},
coded AS (
    SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) FROM c{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
"""


ORACLE = _oracle()
