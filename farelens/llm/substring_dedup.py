"""Operator 10: exact repeated word sequences by super-k-mer partitioning.

A window is 35 consecutive words.  Consecutive windows with the same
minimiser (the 6-word gram of smallest hash in the window) are one
super-k-mer.  Super-k-mers are first counted by minimiser and content hash;
those whose minimiser is shared by differing contents travel as one packed
string (their words) to the minimiser's bucket, where the windows are
numbered by sorting: words by their text, then runs of 2, 4, ... 32 words by
the pair of halves, and 35 words by two overlapping runs of 32.  Equal numbers
are equal windows, so the counts are exact.  A minimiser with many distinct
super-k-mers is split by content, and windows are compared across its parts.

A super-k-mer whose content occurs twice is settled by its 128-bit content
hash (minimiser and content) without travelling.

Defined results: null text has no words; a text shorter than a window keeps
all its words; rows that repeat a document count as repeats of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _anchors
from ._batches import BASE, BASE_INV, U, mix, powers, slices, text_buffer, word_hashes
from ._store import documents, id_and_text

WINDOW = 35
GRAM = 6


def _gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(words), U)
    n = len(words) - k + 1
    if n > 0:
        total = np.zeros(n, U)
        for j in range(k):
            total = total * U(BASE) + words[j : j + n]
        out[:n] = mix(total)
    return out


def content_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end], by prefix sums of a polynomial."""
    upto = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(BASE, len(values)), out=upto[1:])
    back = powers(BASE_INV, len(values) + 1)
    return mix((upto[end] - upto[start]) * back[start] + (end - start).astype(U)).view(np.int64)


def _pieces(first: np.ndarray, length: int, limit: int) -> Iterator[tuple[int, int]]:
    """Unit ranges of one long document, overlapping by a window less one unit."""
    a, z = int(first[0]), int(first[-1])
    while True:
        yield a, min(z, a + limit)
        if a + limit >= z:
            return
        a += limit - length + 1


def find_segments(length: int, gram: int):
    names = ["gram", "content", "doc_id", "dk", "loc"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffer(b.column("text"))
            for i, j in slices(offsets):
                base = int(offsets[i])
                _, _, words, first = word_hashes(data[base : offsets[j]], offsets[i : j + 1] - base)
                words = mix(words)
                ranges = [(0, len(words))] if j - i > 1 else _pieces(first, length, _anchors.CHUNK_UNITS)
                for a, z in ranges:
                    part, bounds = words[a:z], np.clip(first, a, z) - a
                    grams = _gram_hashes(part, gram)
                    start, windows, at = _anchors.segments(grams, bounds, length, gram)
                    if not len(start):
                        continue
                    doc = np.searchsorted(bounds, start, side="right") - 1
                    content = content_hash(part, start, start + windows - 1 + length)
                    loc = _anchors.pack_loc(start - first[doc] + a, windows, at - start)
                    ids = [b.column(c).take(pa.array(i + doc)) for c in ("doc_id", "dk")]
                    yield pa.record_batch([grams[at].view(np.int64), content, *ids, loc], names=names)

    return find


def _split_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+: bytes.split() parts at exactly those bytes."""
    return text.split()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["gram", "content", "part", "parts", "lead", "off", "body"]
    for b in batches:
        rows: list[tuple] = []
        for text, parts in zip(b.column("text").to_pylist(), b.column("parts").to_pylist(), strict=True):
            words = _split_words(text.encode())
            for p in parts:
                start, windows, off = p["loc"] >> 24, (p["loc"] >> 12) & 0xFFF, p["loc"] & 0xFFF
                body = b" ".join(words[start : start + windows - 1 + WINDOW])
                rows.append((p["gram"], p["content"], p["content"] % p["parts"], p["parts"], b"", off, body))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)


def _to_buckets(bodies: DataFrame, n: int) -> DataFrame:
    return bodies.repartition(n, "gram", "part").sortWithinPartitions("gram", "part", "content")


def _rank_pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dense numbers of the pairs, by sorting."""
    return np.unique(left * (int(right.max(initial=0)) + 1) + right, return_inverse=True)[1].astype(np.int64)


def _sort_windows(rows: list[dict]) -> tuple:
    lists = [_split_words(r["body"]) for r in rows]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    number: dict[bytes, int] = {}
    rank = np.array([number.setdefault(w, len(number)) for x in lists for w in x], np.int64)
    ranks, span = [rank], 1
    while 2 * span <= WINDOW:  # rank of the 2 * span words from each place on; places near the end are not used
        shifted = np.append(rank[span:], np.zeros(span, np.int64))
        rank = _rank_pairs(rank, shifted)
        ranks.append(rank)
        span *= 2
    more = WINDOW - span
    whole = _rank_pairs(rank, np.append(rank[more:], np.zeros(more, np.int64))) if more else rank
    count = sizes - WINDOW + 1
    row = np.repeat(np.arange(len(rows)), count)
    window = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(sizes) - sizes)[row] + window
    label = whole[at]
    # Copies of one representative (a repeated input row) are not another place: count distinct (content, window).
    content = np.array([r["content"] for r in rows], np.int64)[row]
    keep = np.unique(np.stack((label, content, window)), axis=1) if len(label) else np.zeros((3, 0), np.int64)
    members = np.bincount(keep[0], minlength=int(whole.max(initial=0)) + 1)[label]
    if any(r["parts"] > 1 for r in rows):
        prints = [hashlib.blake2b(b" ".join(lists[r][w : w + WINDOW]), digest_size=16).digest() for r, w in zip(row.tolist(), window.tolist(), strict=True)]
        f = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
    else:
        f = np.zeros((len(row), 2), np.int64)
    return row, window, members, f[:, 0], f[:, 1]


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(doc_id, dk, start, windows) of rows (doc_id, dk, text): windows whose words start anywhere else too."""
    return _anchors.repeats(rows, find_segments(WINDOW, GRAM), _cut, _sort_windows, _to_buckets, "words")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, n_words, kept_text (words joined by one space), removed (spans of words, start to stop)."""
    rows = id_and_text(docs)
    names = ["doc_id", "n_words", "kept_text", "removed"]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, texts, removed = [], [], []
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                words = _split_words((text or "").encode())
                gone = _anchors.covered(runs, WINDOW, len(words))
                kept, at = [], 0
                for a, z in gone:
                    kept += words[at:a]
                    at = z
                kept += words[at:]
                n_words.append(len(words))
                texts.append(b" ".join(kept).decode())
                removed.append([{"start": a, "stop": z} for a, z in gone])
            cols = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(texts, pa.string()), pa.array(removed, spans)]
            yield pa.record_batch(cols, names=names)

    both = _anchors.runs_by_document(rows, repeated_windows(rows)).select("doc_id", "text", "runs")
    return both.mapInArrow(finish, "doc_id long, n_words long, kept_text string, removed array<struct<start:long,stop:long>>")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, of the kept texts and removed spans."""
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return strip_repeats(docs).select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
