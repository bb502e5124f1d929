"""The pipeline's stages: (spark, docs, sf_dir) -> DataFrame, over all rows of ``docs``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, ngram_join, packing, secrets, suffix_dedup
from ._store import new_path, small_batches

#: Bytes of a repeated string that the pipeline removes: a passage of over 50 words has at least about 270 here, so one that
#: stands in several documents is covered whole, while a line or sentence in common stays.
REPEAT_BYTES = 200
#: Below this posterior a prediction counts as a rejection.
MIN_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those it rejects (no letter, or no language ahead) go.

    The prediction is written into ``lang`` where the table has none.  Columns of any name pass through.
    """
    small_batches(spark)
    model = language.train(docs.where(~language.held_out("doc_id")).select("text", "lang"))
    pred, score = (f"{n}_{uuid.uuid4().hex}" for n in ("lang", "score"))  # beside columns of any name, without a second copy of them
    kept = language.predict(docs, *model, into=(pred, score)).where((F.col(pred) != language.UND) & (F.col(score) >= MIN_SCORE))
    return kept.select(*[F.coalesce("lang", pred).alias("lang") if n == "lang" else F.col(f"`{n}`") for n in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return ngram_join.keep_one(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of REPEAT_BYTES that stand anywhere else too; emptied ones keep their row."""
    small_batches(spark)
    return suffix_dedup.strip_repeats(docs, REPEAT_BYTES)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark of its kind."""
    small_batches(spark)
    return secrets.mask(docs, new_path(spark, "secret-ledger"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    small_batches(spark)
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [
    ("language_id", language_stage),
    ("ngram_join", near_duplicate_stage),
    ("suffix_dedup", suffix_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]
