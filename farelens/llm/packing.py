"""Operator 4: packing by cutting-stock column generation.

A document of n ids gives n // 2048 full pieces and a remainder.  Remainders
fall into 256 length classes of 8 ids; their histogram (256 numbers whatever
the input) is all the driver sees.  A linear program over cutting patterns
(how many pieces of each class share a sequence) is solved by column
generation: a revised simplex holds the basis, and an unbounded knapsack by
dynamic programming over the 256 capacity units prices the next column.
Pattern counts are rounded down and what is left is packed first-fit by
decreasing class.  Sequences with the most room are then dissolved as long as
the others' room takes their pieces, cut where needed.

The plan says, for a class and a rank within it, which sequence and slot a
piece gets; ranks come from a window over (class, hash slice), so a class that
holds a third of all documents is still ranked in parallel.

Defined results: null or empty text is one piece with only the end id; rows
that repeat a document are packed once each; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._batches import slices, text_buffer
from ._store import documents, id_and_text, saved, shuffle_width
from ._words import CALL_BYTES, encoder

LENGTH = 2048
UNIT = 8
CAP = LENGTH // UNIT
#: Simplex steps at most; the basis is a valid plan at every step.
STEPS = 4000
#: Slots of fragments come after the slots of whole pieces.
FRAGMENT_SLOT = 1 << 20


def _knapsack(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Best multiset of classes within CAP units: count per class."""
    best, pick = np.zeros(CAP + 1), np.full(CAP + 1, -1)
    for c in range(1, CAP + 1):
        fits = int(np.searchsorted(weight, c, side="right"))
        best[c] = best[c - 1]
        if fits:
            got = best[c - weight[:fits]] + value[:fits]
            k = int(got.argmax())
            if got[k] > best[c] + 1e-12:
                best[c], pick[c] = got[k], k
    out, c = np.zeros(len(weight), np.int64), CAP
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[pick[c]] += 1
            c -= weight[pick[c]]
    return out


def patterns(weight: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as rows, sequences of each) that hold ``count`` pieces of each class exactly, by rounding the program's optimum."""
    m = len(weight)
    base = np.diag(CAP // weight).astype(np.float64)  # columns are patterns
    inverse, x = np.diag(1 / (CAP // weight)).astype(np.float64), count / (CAP // weight)
    area = weight @ count / CAP
    for _ in range(STEPS):
        if x.sum() <= np.ceil(area - 1e-9) + 0.5:  # no whole plan needs fewer sequences than the area asks for
            break
        dual = inverse.sum(axis=0)
        column = _knapsack(np.maximum(dual, 0), weight).astype(np.float64)
        if dual @ column <= 1 + 1e-9:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-10, x / np.where(step > 1e-10, step, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out] = ratio[out]
        base[:, out] = column
        inverse[out] /= step[out]
        others = np.arange(m) != out
        inverse[others] -= step[others, None] * inverse[out]
    times = np.floor(np.maximum(x, 0) + 1e-7).astype(np.int64)
    rows = base.T.astype(np.int64)
    # Rounding noise must not hand out more pieces than there are.
    while (over := np.flatnonzero(times @ rows > count)).size:
        times[np.flatnonzero((rows[:, over[0]] > 0) & (times > 0))[0]] -= 1
    left = count - times @ rows
    more: list[np.ndarray] = []
    runs: list[int] = []
    while left.any():  # first fit by decreasing class; the same row is repeated while pieces last
        row, room = np.zeros(m, np.int64), CAP
        for k in range(m - 1, -1, -1):
            row[k] = min(left[k], room // weight[k])
            room -= row[k] * weight[k]
        used = row > 0
        n = int((left[used] // row[used]).min())
        more.append(row)
        runs.append(n)
        left = left - n * row
    rows, times = np.vstack([rows, *more]), np.concatenate([times, np.array(runs, np.int64)])
    return rows[times > 0], times[times > 0]


class Plan:
    """Where the piece of a class and rank goes.  All arrays are bounded by classes x patterns."""

    def __init__(self, hist: dict[int, int]):
        weight = np.array(sorted(hist), np.int64)
        count = np.array([hist[w] for w in weight], np.int64)
        self.weight = weight
        if not len(weight):
            self.sequences = 0
            self.donors = np.zeros(0, np.int64)
            return
        rows, times = patterns(weight, count)
        room = CAP - rows @ weight
        order = np.argsort(room, kind="stable")
        rows, times, room = rows[order], times[order], room[order]
        # Dissolve sequences from the roomiest on, while the room of the rest takes what they hold.
        gap, held = int((times * room).sum()), 0
        keep = times.copy()
        for p in range(len(times) - 1, -1, -1):
            fill = CAP - int(room[p])
            n = min(int(times[p]), (gap - held) // CAP)  # each gives up its room and asks for its fill
            keep[p] -= n
            gap, held = gap - n * int(room[p]), held + n * fill
            if n < times[p]:
                break
        gone = times - keep
        self.rows, self.times = rows, keep
        self.first_sequence = np.cumsum(keep) - keep
        self.sequences = int(keep.sum())
        given = keep[:, None] * rows
        self.upto = np.cumsum(given, axis=0)  # ranks of a class that the patterns up to p take
        self.before_slot = np.cumsum(rows, axis=1) - rows
        self.donors = gone @ rows  # pieces of each class that are cut into other sequences' room: the last ranks
        self.donor_base = np.cumsum(self.donors * weight) - self.donors * weight
        self.room = room
        self.gap_base = np.cumsum(keep * room)

    def place(self, cls: int, rank: int, length: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, slot) of the parts of a piece of ``length`` ids."""
        k = int(np.searchsorted(self.weight, cls))
        whole = int(self.upto[-1, k])
        if rank < whole:
            p = int(np.searchsorted(self.upto[:, k], rank, side="right"))
            row = int(self.rows[p, k])
            at, slot = divmod(rank - (int(self.upto[p - 1, k]) if p else 0), row)
            return [(0, length, int(self.first_sequence[p]) + at, int(self.before_slot[p, k]) + slot)]
        unit = int(self.donor_base[k]) + (rank - whole) * cls  # position in the stream of rooms
        out, start = [], 0
        while start < length:
            p = int(np.searchsorted(self.gap_base, unit, side="right"))
            at, into = divmod(unit - (int(self.gap_base[p - 1]) if p else 0), int(self.room[p]))
            units = int(self.room[p]) - into
            n = min(units * UNIT, length - start)
            out.append((start, n, int(self.first_sequence[p]) + at, FRAGMENT_SLOT + into))
            start, unit = start + n, unit + units
        return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"))


def _encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[tuple]:
    enc = encoder(tokenizer)
    for b in batches:
        offsets, _ = text_buffer(b.column("text"))
        for i, j in slices(offsets, CALL_BYTES):
            flat, lens = enc.encode(b.column("text").slice(i, j - i).fill_null(""), end_id)
            yield b, i, j, flat, lens


def _lengths(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """A row per piece before packing: doc_id, dk, doc_tokens, start, length, crc."""
    names = ["doc_id", "dk", "doc_tokens", "start", "length", "crc"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, j, flat, lens in _encoded(batches, tokenizer, end_id):
            n = -(-lens // LENGTH)
            of = np.repeat(np.arange(len(lens)), n)
            start = (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * LENGTH
            size = np.minimum(lens[of] - start, LENGTH)
            at = (np.cumsum(lens) - lens)[of] + start
            crc = [_crc(flat[a : a + s]) for a, s in zip(at.tolist(), size.tolist(), strict=True)]
            cols = [b.column(c).slice(i, j - i).take(pa.array(of)) for c in ("doc_id", "dk")]
            yield pa.record_batch([*cols, lens[of].astype(np.int64), start, size, pa.array(crc, pa.int64())], names=names)

    schema = "doc_id long, dk int, doc_tokens long, start long, length long, crc long"
    return id_and_text(docs).mapInArrow(pieces, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = saved(_lengths(docs, tokenizer, end_id), "pieces").withColumn("cls", F.expr(f"int(ceil(length / {UNIT}))"))
    full = F.col("length") == LENGTH
    pieces = pieces.withColumn("cls", F.when(full, CAP + 1).otherwise(F.col("cls")))
    hist = {r.cls: r.n for r in pieces.groupBy("cls").agg(F.count("*").alias("n")).collect()}  # 257 numbers at most
    fulls = hist.pop(CAP + 1, 0)
    plan = Plan(hist)

    # Rank within the class: rank in a hash slice plus the sizes of the slices before it.
    cut = 4 * shuffle_width(spark)
    pieces = pieces.withColumn("cut", F.pmod(F.xxhash64("doc_id", "dk", "start"), F.lit(cut)))
    sizes = pieces.groupBy("cls", "cut").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("cls").orderBy("cut")) - F.col("n")
    sizes = sizes.select("cls", "cut", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("cls", "cut").orderBy("doc_id", "dk", "start")) - 1
    ranked = pieces.withColumn("rank", rank).join(sizes, ["cls", "cut"]).withColumn("rank", F.col("rank") + F.col("before"))

    names = ["doc_id", "dk", "doc_tokens", "start", "length", "crc", "sequence_id", "slot"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                key = (r["doc_id"], r["dk"], r["doc_tokens"])
                if r["cls"] > CAP:
                    out.append((*key, r["start"], r["length"], r["crc"], plan.sequences + r["rank"], 0))
                    continue
                parts = plan.place(r["cls"], r["rank"], r["length"])
                for start, n, seq, slot in parts:
                    out.append((*key, r["start"] + start, n, r["crc"] if len(parts) == 1 else None, seq, slot))
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)]
            yield pa.record_batch(cols, names=names)

    schema = "doc_id long, dk int, doc_tokens long, start long, length long, crc long, sequence_id long, slot long"
    placed = ranked.drop("before", "cut").mapInArrow(assign, schema)
    if plan.donors.any():
        placed = saved(placed, "placed")
        placed = placed.where("crc is not null").unionByName(_crc_of_cut(docs, placed.where("crc is null"), tokenizer, end_id))
    ahead = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(
        "doc_id", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", F.coalesce(ahead, F.lit(0)).alias("offset")
    )


def _crc_of_cut(docs: DataFrame, cut: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """The checksums of pieces whose bounds are known only after packing: their documents are encoded once more."""
    inner = ["start", "length", "doc_tokens", "sequence_id", "slot"]
    asked = cut.groupBy("doc_id", "dk").agg(F.collect_list(F.struct(*inner)).alias("parts"))  # parts of one document
    asked = saved(asked, "cut")  # its size is then known when the join is planned: texts are shuffled only if it is large
    texts = id_and_text(docs)
    both = texts.join(asked, texts.doc_id.eqNullSafe(asked.doc_id) & (texts.dk == asked.dk)).select(texts.doc_id, texts.dk, "text", "parts")
    both = both.dropDuplicates(["doc_id", "dk"])  # after the join: only the texts that are cut are compared
    names = ["doc_id", "dk", "doc_tokens", "start", "length", "crc", "sequence_id", "slot"]

    def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, j, flat, lens in _encoded(batches, tokenizer, end_id):
            base, rows = np.cumsum(lens) - lens, []
            part = b.slice(i, j - i)
            for at, doc, dk, parts in zip(base, part["doc_id"].to_pylist(), part["dk"].to_pylist(), part["parts"].to_pylist(), strict=True):
                for p in parts:
                    a = at + p["start"]
                    rows.append((doc, dk, p["doc_tokens"], p["start"], p["length"], _crc(flat[a : a + p["length"]]), p["sequence_id"], p["slot"]))
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)

    return both.mapInArrow(crcs, "doc_id long, dk int, doc_tokens long, start long, length long, crc long, sequence_id long, slot long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 1)
