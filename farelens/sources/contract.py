"""Schemas of the raw trip fact, the zone dimension and the enriched relation."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
MILES = T.DecimalType(10, 3)

FEE_COLUMNS = (
    "tolls",
    "bcf",
    "sales_tax",
    "congestion_surcharge",
    "airport_fee",
    "cbd_congestion_fee",
    "tips",
)
FLAG_COLUMNS = (
    "shared_request_flag",
    "shared_match_flag",
    "access_a_ride_flag",
    "wav_request_flag",
    "wav_match_flag",
)

TRIPS_SCHEMA = T.StructType(
    [
        T.StructField("trip_id", T.LongType(), False),
        T.StructField("hvfhs_license_num", T.StringType()),
        T.StructField("request_datetime", T.TimestampNTZType()),
        T.StructField("on_scene_datetime", T.TimestampNTZType()),
        T.StructField("pickup_datetime", T.TimestampNTZType()),
        T.StructField("dropoff_datetime", T.TimestampNTZType()),
        T.StructField("PULocationID", T.IntegerType()),
        T.StructField("DOLocationID", T.IntegerType()),
        T.StructField("trip_miles", MILES),
        T.StructField("trip_time", T.LongType()),
        T.StructField("base_passenger_fare", MONEY),
        T.StructField("driver_pay", MONEY),
        *[T.StructField(c, MONEY) for c in FEE_COLUMNS],
        *[T.StructField(c, T.StringType()) for c in FLAG_COLUMNS],
    ]
)

ZONES_SCHEMA = T.StructType(
    [
        T.StructField("LocationID", T.IntegerType(), False),
        T.StructField("Borough", T.StringType()),
        T.StructField("Zone", T.StringType()),
        T.StructField("service_zone", T.StringType()),
    ]
)

# Output columns of the enriched relation, in order; ``trip_id`` is kept
# last as the deterministic tie-break key.
ENRICHED_COLUMNS = (
    "hvfhs_license_num",
    "company_name",
    "request_datetime",
    "on_scene_datetime",
    "pickup_datetime",
    "dropoff_datetime",
    "trip_date",
    "time_of_day",
    "PULocationID",
    "DOLocationID",
    "pu_borough",
    "pu_zone",
    "pu_service_zone",
    "do_borough",
    "do_zone",
    "do_service_zone",
    "trip_miles",
    "trip_min",
    "request_to_pickup_min",
    "sla_5min_met",
    "base_passenger_fare",
    *FEE_COLUMNS,
    "driver_pay",
    "passenger_total_charge",
    "total_congestion_fees",
    "platform_spread",
    "take_rate_pct",
    "fare_per_mile",
    "driver_pay_per_hour",
    "below_tlc_minimum",
    "is_airport_trip",
    *FLAG_COLUMNS,
    "trip_id",
)
