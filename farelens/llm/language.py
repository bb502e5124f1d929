"""Operator 2: language identification by multinomial naive Bayes.

Features are counts of character 3- and 4-grams of the lower-cased text (with
a space at both ends), hashed to ``BUCKETS`` bins.  Training counts grams per
language over every training text, in Spark tasks that each emit one count
block a language and slice of bins; the blocks are summed by key.  The log
probability matrix (bins x languages) is broadcast: its size is BUCKETS times
the number of languages and does not grow with the rows.  Scoring takes a
batch as a sparse document-by-bin matrix and multiplies in numpy.

Defined results: a null text or one without a letter is ``und`` with score 0;
texts are scored whole; no training rows means every text is ``und``; ties go
to the language first in alphabetical order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._batches import lighten, slices, text_buffer
from ._store import documents

BUCKETS = 1 << 16
#: Bins of a count block that tasks emit and Spark sums.
BLOCK_BINS = 1 << 13
#: Additive smoothing of the counts, in grams.
ALPHA = 0.1
#: Bytes of text whose grams are held at once: they take some two hundred times as much.
SLICE_BYTES = 1 << 18
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")


def gram_bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bin) of every 3- and 4-gram of the texts, in text order within each size."""
    joined = [f" {t.lower()} " for t in texts]
    sizes = np.fromiter(map(len, joined), np.int64, len(joined))
    points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    h = points * np.uint32(0x9E3779B1)
    h3 = (h[:-2] * np.uint32(31) + h[1:-1]) * np.uint32(0x85EBCA6B) + h[2:]
    h4 = (h3[:-1] * np.uint32(0xC2B2AE35)) ^ h[3:]
    same3, same4 = of[:-2] == of[2:], of[:-3] == of[3:]
    mixed = np.concatenate((h3[same3], (h4 * np.uint32(0x27D4EB2F))[same4]))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return np.concatenate((of[:-2][same3], of[:-3][same4])), (mixed >> np.uint32(16)).astype(np.int32)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[str]]]:
    offsets, _ = text_buffer(batch.column("text"))
    for i, j in slices(offsets, SLICE_BYTES):
        yield i, j, batch.column("text").slice(i, j - i).fill_null("").to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lighten()
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for b in batches:
        langs = b.column("lang").to_pylist()
        for i, _, texts in _texts(b):
            for lang in sorted(set(langs[i : i + len(texts)])):
                mine = [t for t, x in zip(texts, langs[i:], strict=False) if x == lang]
                total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total += np.bincount(gram_bins(mine)[1], minlength=BUCKETS)
                docs[lang] = docs.get(lang, 0) + len(mine)
    for lang, total in counts.items():
        for k in range(0, BUCKETS, BLOCK_BINS):
            part = total[k : k + BLOCK_BINS]
            yield pa.record_batch([[lang], [k], [part.tobytes()], [docs[lang]]], names=["lang", "k", "counts", "docs"])


def _sum_blocks(key: tuple, table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(BLOCK_BINS, np.int64), 0
    for b in table:
        for x, d in zip(b.column("counts"), b.column("docs").to_pylist(), strict=True):
            total += np.frombuffer(x.as_py(), np.int64)
            docs += d
    yield pa.record_batch([[key[0].as_py()], [key[1].as_py()], [total.tobytes()], [docs]], names=["lang", "k", "counts", "docs"])


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log matrix) from (text, lang); the last row of the matrix is the log prior."""
    schema = "lang string, k long, counts binary, docs long"
    parts = rows.where("text is not null and lang is not null").select("lang", "text").mapInArrow(_count, schema)
    blocks = parts.groupBy("lang", "k").applyInArrow(_sum_blocks, schema).collect()  # bins x languages numbers
    langs = sorted({r.lang for r in blocks})
    counts, docs = np.zeros((BUCKETS, len(langs))), np.zeros(len(langs))
    for r in blocks:
        at = langs.index(r.lang)
        counts[r.k : r.k + BLOCK_BINS, at] = np.frombuffer(r.counts, np.int64)
        docs[at] = r.docs
    smooth = counts + ALPHA
    logs = np.log(smooth) - np.log(smooth.sum(axis=0))
    return langs, np.vstack((logs, np.log(docs / max(docs.sum(), 1))[None, :])).astype(np.float32)


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs plus the predicted language and its posterior, in columns named by ``into``, replacing columns so named."""
    docs = docs.drop(*into)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(logs)
    names = np.array([*langs, UND], dtype=object)
    extra = pa.schema([(into[0], pa.string()), (into[1], pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        matrix = model.value
        for b in batches:
            best, post = np.full(b.num_rows, len(langs)), np.zeros(b.num_rows)
            for i, j, texts in _texts(b):
                rows = [k for k, t in enumerate(texts) if langs and _LETTER.search(t)]
                if not rows:
                    continue
                of, bins = gram_bins([texts[k] for k in rows])
                cell, n = np.unique(of.astype(np.int64) * BUCKETS + bins, return_counts=True)  # sparse: (text, bin) -> count
                row, col = np.divmod(cell, BUCKETS)
                total = np.tile(matrix[-1].astype(np.float64), (len(rows), 1))
                first = np.searchsorted(row, np.arange(len(rows)))
                has = np.diff(np.append(first, len(row))) > 0
                if has.any():
                    total[has] += np.add.reduceat(matrix[col] * n[:, None], first[has], axis=0)
                top = total.argmax(axis=1)
                at = i + np.array(rows)
                best[at] = top
                post[at] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            pred = [pa.array(names[best], pa.string()), pa.array(post)]
            yield pa.RecordBatch.from_arrays([*b.columns, *pred], schema=pa.schema([*b.schema, *extra]))

    out = T.StructType([*docs.schema.fields, T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())])
    return docs.mapInArrow(score, out)


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out("doc_id")).select("text", "lang"))
    rows = docs.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "text")
    return predict(rows, *model).drop("text")
