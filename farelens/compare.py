"""Shape report outputs for value-by-value comparison with another engine.

DECIMAL -> DOUBLE (exact values give identical doubles), small ints ->
BIGINT, DATE -> 'YYYY-MM-DD', TIMESTAMP_NTZ -> epoch microseconds, and a
struct key is flattened into its fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_EPOCH = "1970-01-01 00:00:00"


def _epoch_micros(ntz) -> "F.Column":
    """Wall-clock microseconds since 1970 of a TIMESTAMP_NTZ, whatever the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), ntz)


def for_compare(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, T.DecimalType):
            cols.append(c.cast("double").alias(f.name))
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            cols.append(c.cast("long").alias(f.name))
        elif isinstance(t, T.DateType):
            cols.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        elif isinstance(t, T.TimestampNTZType):
            cols.append(_epoch_micros(c).alias(f.name))
        elif isinstance(t, T.StructType):
            for sub in t.fields:
                inner = F.col(f"`{f.name}`.`{sub.name}`")
                if isinstance(sub.dataType, T.TimestampNTZType):
                    inner = _epoch_micros(inner)
                elif isinstance(sub.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
                    inner = inner.cast("long")
                cols.append(inner.alias(sub.name))
        else:
            cols.append(c)
    return df.select(*cols)
