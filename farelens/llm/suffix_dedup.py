"""Operator 1: exact repeated substrings by a suffix array in range-partitioned buckets.

A byte goes if it lies in a 400-byte string that starts anywhere else too.
The suffixes that can matter are found first: every 400-byte window is
represented by its minimiser (``_anchors``), and windows whose minimiser gram
or segment content occurs once in the corpus, or whose segments are all
equal, are settled by counting.  The suffixes that remain are range-partitioned
by their leading bytes at the minimiser, with splitters that Spark samples
(``repartitionByRange``), and each bucket sorts its suffixes by multikey
quicksort: suffixes are parted by the 8-byte character at the current depth,
groups of one are done, and a group is done when its members agree up to
depth 400.  Leading bytes with more suffixes than a task should hold are split
over several buckets, whose suffixes are compared across the boundaries by
128-bit fingerprints.

Text is UTF-8 bytes and windows never cross documents.  Defined results: null
text is empty; texts under 400 bytes lose nothing; rows that repeat a document
are repeats of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _anchors
from ._batches import BYTE, U, lighten, mix, slices, text_buffer, with_texts
from ._store import as_struct, documents, id_and_text

WINDOW = 400
#: 64 bytes: 2**_DOUBLINGS.
GRAM, _DOUBLINGS = 64, 6
#: Leading bytes that range-partition the suffixes.
LEAD = 24


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 64 bytes from each place on, by doubling."""
    h, span = BYTE[data], 1
    for k in range(_DOUBLINGS):
        factor = U((0x9E3779B97F4A7C15 * (2 * k + 3)) & 0xFFFFFFFFFFFFFFFF | 1)
        nxt = h * factor
        nxt[:-span] += h[span:] if len(h) > span else U(0)
        h, span = nxt, 2 * span
    return mix(h)


def _find(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    lighten()
    names = ["gram", "content", "doc_id", "dk", "loc"]
    for b in batches:
        offsets, data = text_buffer(b.column("text"))
        for i, j in slices(offsets):
            limit = _anchors.CHUNK_UNITS
            base, end = int(offsets[i]), int(offsets[j])
            a = base
            while a < end:
                z = end if j - i > 1 else min(end, a + limit)
                part = data[a:z]
                bounds = np.clip(offsets[i : j + 1], a, z) - a
                if len(part) > GRAM:
                    grams = _gram_hashes(part)
                    start, windows, at = _anchors.segments(grams, bounds, length, GRAM)
                    if len(start):
                        doc = np.searchsorted(bounds, start, side="right") - 1
                        view = memoryview(np.ascontiguousarray(part))
                        ends = (start + windows - 1 + length).tolist()
                        content = np.array([xxhash.xxh3_64_intdigest(view[s:e]) for s, e in zip(start.tolist(), ends, strict=True)], U)
                        loc = _anchors.pack_loc(a + start - offsets[i : j + 1][doc], windows, at - start)
                        ids = [b.column(c).take(pa.array(i + doc)) for c in ("doc_id", "dk")]
                        yield pa.record_batch([grams[at].view(np.int64), content.view(np.int64), *ids, loc], names=names)
                if z == end:
                    break
                a = z - length + 1


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    names = ["gram", "content", "part", "parts", "lead", "off", "body"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
    for b in batches:
        rows: list[tuple] = []
        for text, parts in zip(b.column("text").to_pylist(), b.column("parts").to_pylist(), strict=True):
            data = text.encode()
            for p in parts:
                start, windows, off = p["loc"] >> 24, (p["loc"] >> 12) & 0xFFF, p["loc"] & 0xFFF
                body = data[start : start + windows - 1 + length]
                rows.append((p["gram"], p["content"], p["content"] % p["parts"], p["parts"], body[off : off + LEAD], off, body))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)


def _to_ranges(bodies: DataFrame, n: int) -> DataFrame:
    return bodies.repartitionByRange(n, "lead", "gram", "part").sortWithinPartitions("lead", "gram", "part", "content")


def equal_suffixes(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Class of each suffix data[at:] up to ``depth`` bytes (a multiple of 8), by multikey quicksort; -1: no equal."""
    padded = np.append(data, np.zeros(8, np.uint8))
    chars = np.zeros(len(data), np.uint64)  # the 8 bytes from each place on, as one character
    for k in range(8):
        chars = (chars << U(8)) | padded[k : k + len(data)]
    label = np.full(len(at), -1, np.int64)
    order, group, done, d = np.arange(len(at)), np.zeros(len(at), np.int64), 0, 0
    while len(order):
        key = chars[at[order] + d]
        s = np.lexsort((key, group))
        order, group, key = order[s], group[s], key[s]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        d += 8
        if d < depth and d in (32, 64, 128, 256):  # groups that agree to the end are done without parting them further
            lead = at[order[np.flatnonzero(new)]]
            agree = np.ones(len(order), bool)
            for e in range(d, depth, 8):
                k = np.flatnonzero(agree)
                agree[k] = chars[at[order[k]] + e] == chars[lead[group[k]] + e]
            full = np.bincount(group, weights=agree) == size
        else:
            full = np.full(len(size), d >= depth)
        end = full & (size > 1)
        hit = end[group]
        label[order[hit]] = done + group[hit]
        done += len(size)
        on = (size > 1)[group] & ~hit
        order, group = order[on], group[on]
    return label


def _sort_windows(rows: list[dict], length: int) -> tuple:
    bodies = [r["body"] for r in rows]
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    joined = b"".join(bodies)
    count = sizes - length + 1
    row = np.repeat(np.arange(len(rows)), count)
    window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(sizes) - sizes)[row] + window
    label = equal_suffixes(np.frombuffer(joined, np.uint8), at, length)
    # Copies of one representative (a repeated input row) are not another place: count distinct (content, window).
    content = np.array([r["content"] for r in rows], np.int64)[row]
    members = np.ones(len(row), np.int64)
    k = np.flatnonzero(label >= 0)
    if len(k):
        keep = np.unique(np.stack((label[k], content[k], window[k])), axis=1)
        members[k] = np.bincount(keep[0])[label[k]]
    if any(r["parts"] > 1 for r in rows):
        prints = b"".join(xxhash.xxh3_128_digest(joined[p : p + length]) for p in at.tolist())
        f = np.frombuffer(prints, np.int64).reshape(-1, 2)
    else:
        f = np.zeros((len(row), 2), np.int64)
    return row, window, members, f[:, 0], f[:, 1]


def repeated_windows(rows: DataFrame, length: int = WINDOW) -> DataFrame:
    """(doc_id, dk, start, windows) of rows (doc_id, dk, text): strings of ``length`` bytes that start anywhere else too."""
    if length % 8 or not 2 * GRAM <= length < 4096:
        raise ValueError(f"a window is a multiple of 8 bytes from {2 * GRAM} to 4088")
    find, cut, sort = (partial(f, length=length) for f in (_find, _cut, _sort_windows))
    return _anchors.repeats(rows, find, cut, sort, _to_ranges, "suffixes")


def kept_bytes(text: str | None, runs: list[dict] | None, length: int = WINDOW) -> tuple[bytes, bytes, list[tuple[int, int]]]:
    """(all bytes, bytes that stay, removed spans) of a text."""
    data = (text or "").encode()
    gone = _anchors.covered(runs, length, len(data))
    kept, at = [], 0
    for a, z in gone:
        kept.append(data[at:a])
        at = z
    kept.append(data[at:])
    return data, b"".join(kept), gone


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = id_and_text(docs)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, spans, digest = [], [], [], []
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                data, kept, gone = kept_bytes(text, runs)
                n.append(len(data))
                removed.append(len(data) - len(kept))
                spans.append(len(gone))
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.record_batch([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(digest, pa.string())], names=names)

    both = _anchors.runs_by_document(rows, repeated_windows(rows)).select("doc_id", "text", "runs")
    return both.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """docs without the bytes of ``text`` that repeated strings of ``length`` bytes cover, and n_chars to match.

    A cut inside a character takes the rest of that character too.  Columns of any name pass through.
    """
    runs = repeated_windows(id_and_text(docs), length).groupBy("doc_id", "dk").agg(F.collect_set(F.struct("start", "windows")).alias("runs"))
    whole = docs.select(as_struct(docs))
    on = F.col("doc.doc_id").eqNullSafe(F.col("found.doc_id")) & (F.hash("doc.text") == F.col("found.dk"))
    both = whole.join(runs.select(F.struct("doc_id", "dk", "runs").alias("found")), on, "left").select("doc", F.col("found.runs").alias("runs"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = pa.RecordBatch.from_struct_array(b.column("doc"))
            texts = doc.column("text").to_pylist()
            for i, r in enumerate(b.column("runs").to_pylist()):
                if r:
                    texts[i] = kept_bytes(texts[i], r, length)[1].decode("utf-8", "ignore")
            yield with_texts(doc, texts)

    return both.mapInArrow(strip, docs.schema)


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
