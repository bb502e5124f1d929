"""Readers for native trip extracts and the zone lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farelens.sources.contract import FLAG_COLUMNS, TRIPS_SCHEMA, ZONES_SCHEMA


#: Columns of the checked read that no extract should have itself.
CORRUPT, REASONS = "_corrupt_line", "_reject_reasons"


class MissingColumnError(ValueError):
    """The extract lacks a column of the trip contract."""


def _contract_fields(raw: DataFrame, path: str) -> list:
    have = {c.lower() for c in raw.columns}
    wanted = [f for f in TRIPS_SCHEMA.fields if f.name != "trip_id" or "trip_id" in have]
    missing = [f.name for f in wanted if f.name.lower() not in have]
    if missing:
        raise MissingColumnError(f"{path} lacks {', '.join(missing)}")
    return wanted


def _with_id(trips: DataFrame) -> DataFrame:
    if "trip_id" not in trips.columns:
        trips = trips.select(F.xxhash64(*trips.columns).alias("trip_id"), "*")
    return normalise_flags(trips)


def read_trips(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Scan a trip extract (Parquet, or CSV with a header) by column name.

    Column order and extra columns do not matter; a missing column raises.
    Values are cast to the contract, so money may be DOUBLE or DECIMAL.
    ``trip_id`` is the tie-break key: extracts without one get a hash of all
    contract columns, so a re-read gives the same ids and exact duplicate
    rows, which no report can tell apart, share one.  Flags are upper-cased
    so 'y' counts as 'Y'.  A value that cannot be cast ends the job under
    ANSI mode; ``read_trips_checked`` sets such rows aside.
    """
    raw = _by_name(spark, path, fmt, options)
    return _with_id(raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in _contract_fields(raw, path)]))


def read_trips_checked(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> tuple[DataFrame, DataFrame]:
    """(trips, rejects) of an extract: every row read is in exactly one of them.

    A row is rejected when a contract value is present but cannot be cast,
    or, in CSV, when the line does not have the header's columns.  Rejects:
    ``reasons``, one text each, and ``row``, the values as read, as JSON.
    Missing values are no reason: NULLs stay with the trips, where the
    cleaning filters (F1) decide.
    """
    raw = _by_name(spark, path, fmt, options)
    wanted = _contract_fields(raw, path)
    reasons = []
    if fmt == "csv":
        lines = T.StructType([*[T.StructField(n, T.StringType()) for n in raw.columns], T.StructField(CORRUPT, T.StringType())])
        read = spark.read.options(header="true", enforceSchema="false", columnNameOfCorruptRecord=CORRUPT, **options)
        raw = read.schema(lines).csv(path)
        reasons.append(F.when(F.col(CORRUPT).isNotNull(), F.lit("line does not have the header's columns")))
    for f in wanted:
        bad = F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
        reasons.append(F.when(bad, F.lit(f"{f.name} is no {f.dataType.simpleString()}")))
    marked = raw.withColumn(REASONS, F.array_compact(F.array(*reasons)))
    trips = marked.where(F.size(REASONS) == 0).select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted])
    row = F.to_json(F.struct(*[F.col(f"`{n}`") for n in raw.columns]))
    rejects = marked.where(F.size(REASONS) > 0).select(F.col(REASONS).alias("reasons"), row.alias("row"))
    return _with_id(trips), rejects


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Rejected rows by reason; a row with several reasons counts under each."""
    return rejects.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def _by_name(spark: SparkSession, path: str, fmt: str, options: dict) -> DataFrame:
    if fmt == "csv":
        # Files whose header differs from the first file's are refused rather than read by position.
        return spark.read.options(header="true", enforceSchema="false", **options).csv(path)
    return spark.read.options(**options).format(fmt).load(path)


def normalise_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.upper(F.col(c)) for c in FLAG_COLUMNS if c in df.columns})


def read_zones(spark: SparkSession, path: str, fmt: str = "csv", **options) -> DataFrame:
    """The zone lookup, by column name."""
    raw = _by_name(spark, path, fmt, options)
    have = {c.lower() for c in raw.columns}
    missing = [f.name for f in ZONES_SCHEMA.fields if f.name.lower() not in have]
    if missing:
        raise MissingColumnError(f"{path} lacks {', '.join(missing)}")
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ZONES_SCHEMA.fields])
