"""Sinks: publish the enriched relation, export report results.

``publish_enriched`` is the scalable form of the shared view: the cleaned,
enriched trips are written once as Parquet partitioned by ``trip_date``,
so every report scans only the columns it reads and a date filter prunes
whole directories.  Publications are loads under a manifest
(``sources/manifest.py``): readers see the old relation or the new one, and
a failed write loses nothing.  ``export`` writes a report result (CSV with a
header for dashboards, or Parquet).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from farelens.sources import manifest
from farelens.sources.contract import ENRICHED_COLUMNS


def publish_enriched(
    enriched: DataFrame,
    path: str,
    max_records_per_file: int = 5_000_000,
    partition_by: str | None = "trip_date",
    replace_dates_only: bool = False,
    covers: Iterable[str] = (),
) -> None:
    """Publish the enriched relation as Parquet, one directory per trip date.

    Rows are rebalanced by date: adaptive execution measures the shuffled
    dates, joins small ones in a task and splits a hot one over several, so
    the input is evaluated once (no sampling pass) and the file count stays
    near dates + tasks instead of dates x tasks.  ``max_records_per_file``
    caps file size.  The publication replaces the whole relation;
    ``replace_dates_only`` replaces just the dates present and those that
    ``covers`` names.

    ``partition_by=None`` keeps the date clustering without directories:
    for sparse histories (a few hundred trips a day over years) one
    directory per date would mean thousands of tiny files, while Parquet
    min/max statistics on the clustered rows still let date filters skip
    row groups.
    """
    rows = enriched.select(*ENRICHED_COLUMNS).hint("rebalance", "trip_date").sortWithinPartitions("trip_date", "pickup_datetime")

    def write(folder: str) -> None:
        writer = rows.write.option("maxRecordsPerFile", max_records_per_file)
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(folder)

    manifest.publish(enriched.sparkSession, path, write, partition_by, replace_dates_only, covers)


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    """The published relation, columns in contract order."""
    return manifest.read(spark, path).select(*ENRICHED_COLUMNS)


def publish_view(enriched: DataFrame, name: str = "v_trips_enriched") -> None:
    """Register the relation under a name for SQL users (replacing the old one)."""
    enriched.createOrReplaceTempView(name)


def export(result: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write one result, a file for each of its partitions (a sorted report is small and has few)."""
    writer = result.write.mode(mode)
    if fmt == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.format(fmt).save(path)
