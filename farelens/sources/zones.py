"""The zone dimension (role-played as pickup and drop-off geography)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DuplicateZoneError(ValueError):
    """The lookup has two rows for one LocationID; joins would multiply trips."""


#: Bytes of lookup text that may be broadcast, besides the row limit of the parameters.
MAX_BROADCAST_BYTES = 64 << 20


def prepare_zones(zones: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """Validate the lookup and shape it for the two left joins.

    * One small job checks that ``LocationID`` is unique (a duplicate would
      silently multiply trips in the left joins) and measures rows and bytes;
      it runs on every call, since the files behind a lookup may change.
    * The result is grouped by ``LocationID`` so Catalyst knows the key is
      unique and drops a lookup join whose columns a report never reads.
    * It is broadcast only when the measured rows and bytes are within
      ``max_broadcast_rows`` and ``MAX_BROADCAST_BYTES``; otherwise Spark plans a shuffle join.
    """
    text = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("Borough", "Zone", "service_zone")), F.lit(0))
    stats = zones.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("LocationID").alias("keys"),
        F.count("LocationID").alias("non_null"),
        F.coalesce(F.sum(text.cast("long")), F.lit(0)).alias("bytes"),
    ).first()
    if stats["rows"] != stats["keys"] or stats["non_null"] != stats["rows"]:
        raise DuplicateZoneError(f"zone lookup has {stats['rows']} rows for {stats['keys']} distinct non-null LocationIDs")
    unique = zones.groupBy("LocationID").agg(
        F.first("Borough").alias("Borough"),
        F.first("Zone").alias("Zone"),
        F.first("service_zone").alias("service_zone"),
    )
    small = stats["rows"] <= max_broadcast_rows and stats["bytes"] <= MAX_BROADCAST_BYTES
    return F.broadcast(unique) if small else unique
