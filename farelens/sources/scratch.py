"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from farelens.session import ensure_checkpoint_dir


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: what follows never evaluates ``df`` again, lost executors included."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
