"""Windows by their minimiser: the common ground of the two exact repeat finders.

A window is ``length`` consecutive units (bytes or words) of one document.
Its minimiser is the leftmost gram of smallest hash inside it, so equal
windows have equal minimisers at equal offsets, wherever they stand.
Consecutive windows that share a minimiser form a segment.  Two windows can
only be equal if their segments have the same minimiser gram, so repeats are
found among segments of one gram, and a segment whose gram occurs once in the
corpus needs no further look.

``repeats`` carries only hashes and positions between tasks until the few
segments remain whose gram is shared but whose content differs; their units
travel once, one representative for each distinct content, and the caller
sorts their windows exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import U
from ._store import saved, shuffle_width

#: Units of a document that are looked at together; longer documents are cut, with overlap.
CHUNK_UNITS = 1 << 21
#: Distinct segments of one gram that one task sorts; more are split by content and compared across the parts.
PART_SEGMENTS = 4000
#: Content of segments that a task sorts at once, in bytes.
SORT_BYTES = 1 << 21


def segments(gram: np.ndarray, first: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser) of every segment of the documents units[first[i]:first[i+1]].

    gram[p] is the 64-bit hash of the k units from p on (any value where they cross a document's end).
    """
    none = np.zeros(0, np.int64)
    n = len(gram)
    if n < length:
        return none, none, none
    w = length - k + 1  # grams in a window
    key = (gram & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    blocks = -(-n // w)
    padded = np.full(blocks * w, ~U(0))
    padded[:n] = key
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    last = n - length + 1
    least = (np.minimum(back[:last], ahead[w - 1 : w - 1 + last]) & U(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(first)
    whole = np.ones(last, bool)  # windows that end inside their document
    for a, z in zip(np.maximum(first[1:] - length + 1, first[:-1])[sizes > 0].tolist(), first[1:][sizes > 0].tolist(), strict=True):
        whole[a:z] = False
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none, none
    of = least[at]
    new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1))))
    return at[new], np.diff(np.append(new, len(at))), of[new]


def pack_loc(start: np.ndarray, windows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A segment's place in one long: first window, number of windows, minimiser's offset from the first window."""
    return (start.astype(np.int64) << 24) | (windows.astype(np.int64) << 12) | offset


def unpack_loc(loc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return loc >> 24, (loc >> 12) & 0xFFF, loc & 0xFFF


SEGMENTS = "gram long, content long, doc_id long, dk int, loc long"
FOUND = "gram long, content long, first int, windows int"
#: A window on its way to the other parts of its gram: fingerprint, and its place in its segment.
MEET = np.dtype([("f1", "<i8"), ("f2", "<i8"), ("content", "<i8"), ("first", "<i4")])


def repeats(
    rows: DataFrame,
    find: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    cut: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    sort: Callable[[list[dict]], Iterator[tuple]],
    order: Callable[[DataFrame, int], DataFrame],
    name: str,
) -> DataFrame:
    """(doc_id, dk, start, windows): runs of windows whose content starts anywhere else too.

    rows: (doc_id, dk, text).  find: their segments.  cut: rows with ``parts`` (their representatives) -> gram,
    content, part, parts, lead, off, body.  order: deals those out to ``n`` sorted partitions.  sort: see ``_sorted``.
    """
    spark = rows.sparkSession
    seg = saved(rows.mapInArrow(find, SEGMENTS), f"{name}-segments")
    grams = seg.groupBy("gram").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
    # Written before the join, so that both of its sides are plain shuffles and a hot gram's partition can be split.
    grams = saved(grams.where("n > 1").select("gram", (F.col("low") != F.col("high")).alias("mixed")), f"{name}-grams")
    shared = saved(seg.join(grams, "gram"), f"{name}-shared")
    start, windows = F.expr("int(shiftright(loc, 24))"), F.expr("int(shiftright(loc, 12) & 4095)")
    same = shared.where("not mixed").select("doc_id", "dk", start.alias("start"), windows.alias("windows"))

    mixed = shared.where("mixed")
    one = mixed.groupBy("gram", "content").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "dk", "loc")).alias("at"))
    one = saved(one.select("gram", "content", "n", "at.*"), f"{name}-distinct")
    split = one.groupBy("gram").agg(F.expr(f"int(ceil(count(*) / {PART_SEGMENTS}))").alias("parts"))
    asked = one.join(split, "gram").groupBy("doc_id", "dk").agg(F.collect_list(F.struct("gram", "content", "loc", "parts")).alias("parts"))
    asked = asked.withColumnRenamed("doc_id", "id").withColumnRenamed("dk", "k")
    bodies = rows.join(asked, rows.doc_id.eqNullSafe(asked.id) & (rows.dk == asked.k)).select("text", "parts")
    # Rows that repeat a document would repeat its representatives.
    bodies = saved(bodies.mapInArrow(cut, "gram long, content long, part int, parts int, lead binary, off int, body binary"), f"{name}-bodies")
    total = bodies.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    tasks = max(shuffle_width(spark), int(total // (4 * SORT_BYTES)) + 1)
    done = saved(order(bodies, tasks).mapInArrow(lambda it: _sorted(it, sort), f"{FOUND}, part int, bucket int, packed binary"), f"{name}-sorted")

    inside = done.where("part is null").select("gram", "content", "first", "windows")
    # Across the parts of a split gram: a window alone in its part is compared with those of the other parts.
    open_ = done.where("part is not null").select("gram", "bucket", "packed")
    across = open_.repartition(tasks, "gram", "bucket").sortWithinPartitions("gram", "bucket").mapInArrow(_across, FOUND)
    copies = one.where("n > 1").select("gram", "content", F.lit(0).alias("first"), windows.alias("windows"))
    found = copies.unionByName(inside).unionByName(across)
    hits = mixed.join(found, ["gram", "content"]).select(
        "doc_id", "dk", (start + F.col("first")).alias("start"), found.windows.alias("windows")
    )
    return same.unionByName(hits)


def _sorted(batches: Iterator[pa.RecordBatch], sort: Callable) -> Iterator[pa.RecordBatch]:
    """Runs ``sort`` over whole (gram, part) groups of a sorted partition, about SORT_BYTES at a time.

    sort(rows) gives for each window, by row and place: row, window, equal windows in these rows, two fingerprint words.
    """
    names = ["gram", "content", "first", "windows", "part", "bucket", "packed"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def flush(rows: list[dict]) -> pa.RecordBatch:
        row, window, members, f1, f2 = sort(rows)
        gram, content, part, parts = (np.array([r[c] for r in rows], np.int64) for c in ("gram", "content", "part", "parts"))
        repeated = members > 1
        r, n, new = _runs(row[repeated], window[repeated])
        w = window[repeated][new]
        found = [gram[r], content[r], w, n, *[pa.nulls(len(r), t) for t in kinds[4:]]]
        # Of split grams, one of each kind of window goes to meet the other parts, packed by (gram, part, bucket).
        k = np.flatnonzero((parts > 1)[row])
        kind = np.stack((gram[row[k]], part[row[k]], f1[k], f2[k]), axis=1)
        k = k[np.unique(kind, axis=0, return_index=True)[1]] if len(k) else k
        bucket = (f1[k].view(U) % parts[row[k]].astype(U)).astype(np.int64)
        order = np.lexsort((bucket, part[row[k]], gram[row[k]]))
        k, bucket = k[order], bucket[order]
        of = row[k]
        packed = np.empty(len(k), MEET)
        packed["f1"], packed["f2"], packed["content"], packed["first"] = f1[k], f2[k], content[of], window[k]
        edge = np.ones(len(k), bool)
        edge[1:] = (gram[of][1:] != gram[of][:-1]) | (part[of][1:] != part[of][:-1]) | (bucket[1:] != bucket[:-1])
        at = np.flatnonzero(edge)
        body = [packed[i:j].tobytes() for i, j in zip(at.tolist(), [*at[1:].tolist(), len(k)], strict=True)] if len(at) else []
        m = len(at)
        nothing = [pa.nulls(m, t) for t in kinds[1:4]]
        meet = [gram[of[at]], *nothing, part[of[at]], bucket[at], body]
        return pa.record_batch([pa.concat_arrays([pa.array(x, t), pa.array(y, t)]) for x, y, t in zip(found, meet, kinds, strict=True)], names=names)

    held: list[dict] = []
    size, last = 0, None
    for b in batches:
        for r in b.to_pylist():
            key = (r["gram"], r["part"])
            if key != last and size >= SORT_BYTES:
                yield flush(held)
                held, size = [], 0
            last = key
            held.append(r)
            size += len(r["body"])
    if held:
        yield flush(held)


def _runs(row: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, windows, index of the first) of each run of consecutive windows of one row, in ascending order."""
    if not len(row):
        return row, np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1))))
    return row[new], np.diff(np.append(new, len(row))), new


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOUND rows of the windows that stand in several parts; input is sorted by (gram, bucket).

    A part sends each kind of window once, so a fingerprint that occurs twice in a bucket is in two parts.  A gram
    has as many buckets as parts, so a bucket holds about the windows of one part.
    """

    def meet(gram: int, held: list[bytes]) -> pa.RecordBatch:
        all_ = np.frombuffer(b"".join(held), MEET)
        order = np.lexsort((all_["f2"], all_["f1"]))
        f = all_[order]
        equal = (f["f1"][1:] == f["f1"][:-1]) & (f["f2"][1:] == f["f2"][:-1])
        twice = np.zeros(len(f), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        f = f[twice]
        f = f[np.lexsort((f["first"], f["content"]))]
        content, n, new = _runs(f["content"], f["first"].astype(np.int64))
        columns = [np.full(len(n), gram), content, pa.array(f["first"][new], pa.int32()), pa.array(n, pa.int32())]
        return pa.record_batch(columns, names=["gram", "content", "first", "windows"])

    held: list[bytes] = []
    last = None
    for b in batches:
        for gram, bucket, packed in zip(*(b.column(c).to_pylist() for c in ("gram", "bucket", "packed")), strict=True):
            if (gram, bucket) != last and held:
                yield meet(last[0], held)
                held = []
            last = (gram, bucket)
            held.append(packed)
    if held:
        yield meet(last[0], held)


def runs_by_document(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """rows with ``runs``, the (start, windows) of each; null where a document has none."""
    per = runs.groupBy("doc_id", "dk").agg(F.collect_set(F.struct("start", "windows")).alias("runs"))
    per = per.withColumnRenamed("doc_id", "id").withColumnRenamed("dk", "k")
    return rows.join(per, rows.doc_id.eqNullSafe(per.id) & (rows.dk == per.k), "left").drop("id", "k")


def covered(runs: list[dict] | None, length: int, n: int) -> list[tuple[int, int]]:
    """Maximal covered intervals of n units from runs of repeated windows."""
    out: list[tuple[int, int]] = []
    for a, z in sorted((r["start"], min(r["start"] + r["windows"] - 1 + length, n)) for r in runs or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out

