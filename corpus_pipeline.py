"""The corpus pipeline: documents through five stages, each a whole-table operator.

``run(spark, sf_dir)`` applies STAGES in order; every stage's rows are written
to the shared folder as Parquet and reread as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from farelens.llm._store import documents, saved
from farelens.llm.stages import STAGES

#: No SQL here: the Bayes model, the sorts over suffixes and the tokenizer have no SQL form; tests/llm compares brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else saved(out, f"stage{k}-{name}")
    return docs
