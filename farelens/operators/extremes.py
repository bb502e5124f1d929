"""Peak and trough of a series per group, with deterministic tie rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def peak_and_trough(series: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Per ``group``: max/min of ``value`` and the ``key`` where they occur.

    Ties: the peak takes the latest key among equal maxima, the trough the
    earliest among equal minima (the MAX/MIN over the tied keys of the
    correlated-subquery form).  ``max_by``/``min_by`` on (value, key) does
    it in one aggregation pass instead of a self-join.
    """
    return series.groupBy(group).agg(
        F.max_by(F.col(key), F.struct(F.col(value), F.col(key))).alias(f"peak_{key}"),
        F.max(value).alias(f"peak_{value}"),
        F.min_by(F.col(key), F.struct(F.col(value), F.col(key))).alias(f"trough_{key}"),
        F.min(value).alias(f"trough_{value}"),
    )
