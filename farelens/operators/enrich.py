"""Clean and enrich raw trips against the zone dimension.

A pure projection plus two left joins to a small, validated dimension, so
it runs as one map-only stage after the scan: no shuffle, filters on raw
columns pushed into the Parquet reader, unused columns pruned.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farelens.functions.exact import from_units, lround, rate_scale, to_units
from farelens.functions.ladders import ladder
from farelens.params import Params
from farelens.sources.contract import ENRICHED_COLUMNS, FEE_COLUMNS
from farelens.sources.zones import prepare_zones


def wait_seconds(request: Column, pickup: Column) -> Column:
    """Whole seconds from request to pickup, truncated toward zero."""
    return F.timestamp_diff("SECOND", request, pickup)


def company_name(code: Column, params: Params) -> Column:
    return ladder(((code == F.lit(c), label) for c, label in params.platforms), params.other_platform)


def hour_bucket(hour: Column, params: Params) -> Column:
    return ladder(
        ((hour.between(lo, hi), label) for label, lo, hi in params.time_buckets),
        params.default_time_bucket,
    )


def time_of_day(ts: Column, params: Params) -> Column:
    return hour_bucket(F.hour(ts), params)


def legal_minimum_floor_cents(miles_m: Column, secs: Column, params: Params) -> Column:
    """ROUND(miles * per_mile + secs / 60 * per_minute, 2) in cents, exact.

    With rates held as integers of 10^-k dollars (rm, rt), the floor in
    cents is (60 * miles_m * rm + 1000 * secs * rt) / (600 * 10^k).
    """
    k = rate_scale(params.pay_per_mile, params.pay_per_minute)
    rm = int(Decimal(params.pay_per_mile).scaleb(k))
    rt = int(Decimal(params.pay_per_minute).scaleb(k))
    return lround(miles_m * (60 * rm) + secs * (1000 * rt), 600 * 10**k)


def clean_filter(trips: DataFrame, params: Params) -> DataFrame:
    """F1-F4 on raw columns (the comparisons reach the Parquet scan)."""
    t = F.col
    return trips.where(
        t("pickup_datetime").isNotNull()
        & t("dropoff_datetime").isNotNull()
        & t("request_datetime").isNotNull()
        & t("base_passenger_fare").isNotNull()
        & t("driver_pay").isNotNull()
        & (t("trip_miles") > 0)
        & (t("trip_time") > 0)
        & t("hvfhs_license_num").isin(*params.platform_codes)
        & wait_seconds(t("request_datetime"), t("pickup_datetime")).between(0, params.max_wait_seconds)
    )


def with_zone_names(df: DataFrame, zones: DataFrame) -> DataFrame:
    """Pickup and drop-off geography of PULocationID and DOLocationID, from a prepared lookup."""
    pu = zones.select(
        F.col("LocationID").alias("_pu_id"),
        F.col("Borough").alias("pu_borough"),
        F.col("Zone").alias("pu_zone"),
        F.col("service_zone").alias("pu_service_zone"),
    )
    do = zones.select(
        F.col("LocationID").alias("_do_id"),
        F.col("Borough").alias("do_borough"),
        F.col("Zone").alias("do_zone"),
        F.col("service_zone").alias("do_service_zone"),
    )
    df = df.join(pu, df.PULocationID == pu._pu_id, "left")
    return df.join(do, df.DOLocationID == do._do_id, "left").drop("_pu_id", "_do_id")


def enrich(trips: DataFrame, zones: DataFrame, params: Params) -> DataFrame:
    """The enriched relation: one row per clean trip, columns as ENRICHED_COLUMNS."""
    t = with_zone_names(clean_filter(trips, params), prepare_zones(zones, params.max_broadcast_rows))

    c = F.col
    # Stage 1: everything per trip as LONG units (cents, 1/1000 mile, seconds).
    units = {
        "_fare_c": to_units(c("base_passenger_fare"), 2),
        "_pay_c": to_units(c("driver_pay"), 2),
        "_miles_m": to_units(c("trip_miles"), 3),
        "_wait_s": wait_seconds(c("request_datetime"), c("pickup_datetime")),
        **{f"_{f}_c": F.coalesce(to_units(c(f), 2), F.lit(0).cast("long")) for f in FEE_COLUMNS},
    }
    t = t.withColumns(units)
    fare, pay, miles, secs, wait = c("_fare_c"), c("_pay_c"), c("_miles_m"), c("trip_time"), c("_wait_s")
    total = fare
    for f in FEE_COLUMNS:
        total = total + c(f"_{f}_c")
    spread = fare - pay

    # Stage 2: rounded per-trip measures, converted once to DECIMAL.
    derived = {
        "company_name": company_name(c("hvfhs_license_num"), params),
        "trip_date": F.to_date(c("pickup_datetime")),
        "time_of_day": time_of_day(c("pickup_datetime"), params),
        "trip_min": from_units(lround(secs * 100, 60), 2, 14),
        "request_to_pickup_min": from_units(lround(wait * 100, 60), 2, 14),
        "sla_5min_met": F.when(wait <= params.sla_seconds, 1).otherwise(0),
        **{f: from_units(c(f"_{f}_c"), 2, 12) for f in FEE_COLUMNS},
        "passenger_total_charge": from_units(total, 2, 14),
        "total_congestion_fees": from_units(c("_congestion_surcharge_c") + c("_cbd_congestion_fee_c"), 2, 13),
        "platform_spread": from_units(spread, 2, 13),
        "take_rate_pct": F.when(fare > 0, from_units(lround(spread * 10000, fare), 2, 16)),
        "fare_per_mile": F.when(miles > 0, from_units(lround(fare * 1000, miles), 2, 16)),
        "driver_pay_per_hour": F.when(secs > 0, from_units(lround(pay * 3600, secs), 2, 16)),
        "below_tlc_minimum": F.when(
            (miles > 0) & (secs > 0),
            F.when(pay < legal_minimum_floor_cents(miles, secs, params), 1).otherwise(0),
        ),
        "is_airport_trip": F.when(c("airport_fee") > 0, 1).otherwise(0),
    }
    # Flags pass through as given; sources normalise their case.
    out = t.withColumns(derived)
    return out.select(*[c(name) for name in ENRICHED_COLUMNS])
