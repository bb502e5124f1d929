"""Operator 5: secret scans over an incremental ledger of content-addressed blobs.

Every historical version of every path is a row (path, text); its blob id is
the SHA-256 of the text.  The ledger is a Parquet table of (blob,
rule_version, findings).  A scan takes the distinct blobs, drops the (blob,
rule_version) pairs the ledger has, scans one text of each remaining blob,
appends the findings, and joins the ledger back to all paths.  A second scan
of the same versions reads no text beyond hashing it.

Rules are those of the contract; a match that is too short is dropped after
leftmost non-overlapping matching.  Spans count code points.

Defined results: null text is the empty blob; rows that repeat a path or a
text each get their own result row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._batches import with_texts
from ._store import as_struct, documents, new_path

RULE_VERSION = "base-1"
#: The contract's rules, in its order.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex")
#: What a text must hold, lower-cased, for the first rule to match anywhere.
_HINTS = ("passw", "secret", "token", "api")
_HEX_TABLE = bytes(0x68 if chr(i) in "0123456789abcdef" else 0x20 for i in range(256))
_HEX_RUN = b"h" * 24


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base spans, by start and then kind as listed."""
    spans = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_HEX_TABLE):
        spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], a, z) for a, k, z in sorted(spans)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [find(t or "") for t in b.column("text").to_pylist()]
        spans = [",".join(f"{k}:{a}:{z}" for k, a, z in f) for f in found]
        counts = [pa.array([sum(k == kind for k, _, _ in f) for f in found], pa.int64()) for kind in KINDS]
        digest = [hashlib.sha256(s.encode()).hexdigest() for s in spans]
        cols = [b.column("blob"), *counts, pa.array(digest, pa.string()), pa.array(spans, pa.string())]
        yield pa.record_batch(cols, names=["blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


_FINDINGS = "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_LEDGER = _FINDINGS + ", rule_version string"


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def blob_id(text: str = "text") -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


def scan(versions: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """versions (doc_id, text) plus the findings of each row's blob; ``ledger`` gains the blobs not yet scanned.

    One row of each unseen blob is chosen by its smallest (doc_id, row hash), which is a join key that spreads
    evenly however many copies a blob has; texts travel once, to that join.
    """
    spark = versions.sparkSession
    rows = versions.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), blob_id().alias("blob"))
    known = _ledger(spark, ledger).where(F.col("rule_version") == rule_version)
    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("blob"))
    unseen = rows.groupBy("blob").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("id")).join(known.select("blob"), "blob", "left_anti")
    one = rows.select(key.alias("key"), "text").join(unseen.select(F.struct("id", "blob").alias("key")), "key")
    # Rows that repeat both doc_id and text would be scanned twice; the ledger keeps one row a blob.
    fresh = one.select(F.col("key.blob").alias("blob"), "text").mapInArrow(_scan, _FINDINGS).dropDuplicates(["blob"])
    fresh.withColumn("rule_version", F.lit(rule_version)).write.mode("append").parquet(ledger)
    seen = _ledger(spark, ledger).where(F.col("rule_version") == rule_version).drop("rule_version")
    return rows.select("doc_id", "blob").join(seen, "blob")


def mask(docs: DataFrame, ledger: str) -> DataFrame:
    """docs with each secret of ``text`` replaced by a mark of its kind (overlapping spans by one), and n_chars to match.

    Columns of any name pass through.
    """
    found = scan(docs.select("doc_id", "text"), ledger).where("spans != ''").distinct()

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = pa.RecordBatch.from_struct_array(b.column("doc"))
            texts = doc.column("text").to_pylist()
            for i, spans in enumerate(b.column("spans").to_pylist()):
                if not spans:
                    continue
                out, at = [], 0
                for kind, a, z in (x.split(":") for x in spans.split(",")):
                    if int(z) <= at:
                        continue
                    if int(a) >= at:
                        out += [texts[i][at : int(a)], f"<{kind}>"]
                    at = int(z)
                texts[i] = "".join(out) + texts[i][at:]
            yield with_texts(doc, texts)

    whole = docs.select(as_struct(docs), blob_id().alias("own")).join(
        found.select(F.struct("doc_id", "blob").alias("key"), "spans"),
        F.col("doc.doc_id").eqNullSafe(F.col("key.doc_id")) & (F.col("own") == F.col("key.blob")), "left",
    )
    return whole.select("doc", "spans").mapInArrow(replace, docs.schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), new_path(spark, "secret-ledger")).drop("blob")
