"""Bindings: map the shared benchmark tables onto the trip contract.

There is no public trip extract in the test data, so two adapters build a
trip fact from the star-schema tables and the same engine runs on it:

* ``orders_binding``: one trip per ``lineitem`` row, joined to its order,
  part, customer (pickup) and supplier (drop-off).  Platform code is
  ``l_returnflag``; times are order date -> ship date, so waits are days
  long and the wait / SLA / pay-rate parameters are scaled accordingly.
* ``events_binding``: one trip per ``events`` row joined to its customer;
  timestamps carry real hours over one month, so it drives the time-of-day
  and daily-trend reports.

Money derived from DOUBLE columns is brought to integer cents by one
integer rule before any operator sees it.  The big joins are left to the
optimizer (sort-merge, or broadcast when AQE measures a side as small);
only the zone dimension is broadcast, behind its row-count check.

* ``mixed_binding``: one trip per ``events`` row again, with fares, pay,
  waits, fees and zones that differ by region and hour, so that at the
  default cut-offs every ladder shows its rungs and every report filter
  has rows to drop (unmatched and missing zones, fares of zero, groups
  below the minimum sizes, zones without a fee).
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelens.functions.exact import cents_of, from_units, idiv, money
from farelens.params import Params
from farelens.sources.contract import MILES

# Fixed values of the bindings (fee amounts in cents, rates in basis points,
# location sets, wait / SLA scaling).  The oracle SQL repeats them.
ORDERS_PLATFORMS = (("A", "Uber"), ("R", "Lyft"))
ORDERS_MAX_WAIT_SECONDS = 2000 * 86400
ORDERS_SLA_SECONDS = 365 * 86400
ORDERS_PAY_PER_MILE = Decimal("900")
ORDERS_PAY_PER_MINUTE = Decimal("2")
ORDERS_SURCHARGE_CENTS = 275  # drop-off zone id % 5 == 1
ORDERS_CBD_CENTS = 150  # pickup zone not in (0, 7, 14) and drop-off zone id % 3 == 0
ORDERS_CBD_EXCLUDED_PICKUP = (0, 7, 14)
ORDERS_AIRPORT_CENTS = 250  # order priority '1-URGENT', else NULL
ORDERS_AIRPORT_PRIORITY = "1-URGENT"
ORDERS_TOLLS_CENTS = 694  # line number 2, else NULL
ORDERS_BCF_PER_MILLE = 25  # 2.5 % of the fare

EVENTS_PLATFORMS = (("purchase", "Uber"), ("signup", "Lyft"))
EVENTS_HOLIDAY_MONTH = 1
EVENTS_SALES_TAX_PER_100K = 8875  # 8.875 % of the fare
EVENTS_BCF_PER_MILLE = 25
EVENTS_TIP_PCT = 15  # event_id % 3 == 0, else NULL
EVENTS_SURCHARGE_CENTS = 275  # pickup zone id % 5 == 1
EVENTS_CBD_CENTS = 150  # pickup zone id % 5 in (1, 2) and hour 6..19
EVENTS_AIRPORT_CENTS = 500  # event_id % 25 in (0, 1); 0.00 when == 2; else NULL


# Mixed binding, by severity 0..4 (region key, one more late at night, 4 at most): wait range in seconds, pay in
# percent of the fare (Lyft four more), one trip in so many that runs two hours (0: none), surcharge in cents by region.
MIXED_WAITS = (400, 480, 560, 700, 1000)
MIXED_STABLE_ZONE_WAIT = (5, 600)  # a zone of steady fares and long waits
MIXED_PAY_PCT = (72, 83, 88, 94, 104)
MIXED_LONG_TRIPS = (0, 0, 100, 0, 20)
MIXED_SURCHARGE_CENTS = (400, 150, 50, 50, 50)
MIXED_CBD_ZONES = 9


@dataclass(frozen=True)
class Binding:
    trips: DataFrame
    zones: DataFrame
    params: Params


# Declared schemas of the benchmark tables (columns the bindings read), so
# a scan needs no schema-inference job.
TABLE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_nationkey INT",
    "supplier": "s_suppkey BIGINT, s_nationkey INT",
    "part": "p_partkey BIGINT, p_size INT, p_retailprice DOUBLE",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
        "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
        "l_returnflag STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def zone_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation x region as the zone lookup: zone = nation, borough = region."""
    nation = _table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = _table(spark, sf_dir, "region", "r_regionkey", "r_name")
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        F.col("n_nationkey").cast("int").alias("LocationID"),
        F.col("r_name").alias("Borough"),
        F.col("n_name").alias("Zone"),
        F.col("r_name").alias("service_zone"),
    )


def _flag(cond) -> F.Column:
    return F.when(cond, F.lit("Y")).otherwise(F.lit("N"))


def orders_binding(spark: SparkSession, sf_dir: str, base: Params | None = None) -> Binding:
    params = (base or Params()).with_(
        platforms=ORDERS_PLATFORMS,
        max_wait_seconds=ORDERS_MAX_WAIT_SECONDS,
        sla_seconds=ORDERS_SLA_SECONDS,
        pay_per_mile=ORDERS_PAY_PER_MILE,
        pay_per_minute=ORDERS_PAY_PER_MINUTE,
    )
    li = _table(
        spark, sf_dir, "lineitem",
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate",
    )
    orders = _table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    part = _table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    cust = _table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    supp = _table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")

    # Orders meet their customer first (an orders-sized join), so the
    # lineitem-sized intermediate is shuffled only on its own join keys
    # (order key, then part key; suppliers are the smallest side).  Sides
    # are broadcast only when AQE measures them under the threshold.
    order_cust = orders.join(cust, orders.o_custkey == cust.c_custkey)
    joined = (
        li.join(order_cust, li.l_orderkey == order_cust.o_orderkey)
        .join(part, li.l_partkey == part.p_partkey)
        .join(supp, li.l_suppkey == supp.s_suppkey)
    )
    joined = joined.select(
        "*",
        cents_of(F.col("l_extendedprice")).alias("_price_c"),
        cents_of(F.col("l_tax")).alias("_tax_pct"),
        cents_of(F.col("l_discount")).alias("_disc_pct"),
    )
    price_c = F.col("_price_c")
    pu = F.col("c_nationkey").cast("int")
    do = F.col("s_nationkey").cast("int")
    trips = joined.select(
        F.struct(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
        ).alias("trip_id"),
        F.col("l_returnflag").alias("hvfhs_license_num"),
        F.col("o_orderdate").alias("request_datetime"),
        F.col("l_shipdate").alias("on_scene_datetime"),
        F.col("l_shipdate").alias("pickup_datetime"),
        F.timestamp_add("DAY", F.lit(1), F.col("l_shipdate")).alias("dropoff_datetime"),
        pu.alias("PULocationID"),
        do.alias("DOLocationID"),
        F.col("l_quantity").cast(MILES).alias("trip_miles"),
        (F.col("p_size").cast("long") * 60).alias("trip_time"),
        money(price_c).alias("base_passenger_fare"),
        F.when(F.col("l_linenumber") == 2, money(F.lit(ORDERS_TOLLS_CENTS))).alias("tolls"),
        money(idiv(price_c * ORDERS_BCF_PER_MILLE + 500, 1000)).alias("bcf"),
        money(idiv(price_c * F.col("_tax_pct") + 50, 100)).alias("sales_tax"),
        F.when(do % 5 == 1, money(F.lit(ORDERS_SURCHARGE_CENTS))).otherwise(money(F.lit(0))).alias("congestion_surcharge"),
        F.when(F.col("o_orderpriority") == ORDERS_AIRPORT_PRIORITY, money(F.lit(ORDERS_AIRPORT_CENTS))).alias("airport_fee"),
        F.when(~pu.isin(*ORDERS_CBD_EXCLUDED_PICKUP) & (do % 3 == 0), money(F.lit(ORDERS_CBD_CENTS)))
        .otherwise(money(F.lit(0)))
        .alias("cbd_congestion_fee"),
        money(idiv(price_c * F.col("_disc_pct") + 50, 100)).alias("tips"),
        money(F.rint(F.col("l_quantity")).cast("long") * cents_of(F.col("p_retailprice"))).alias("driver_pay"),
        _flag(F.col("l_linenumber") == 6).alias("shared_request_flag"),
        F.lit("N").alias("shared_match_flag"),
        F.lit("N").alias("access_a_ride_flag"),
        _flag(F.col("l_linenumber") == 7).alias("wav_request_flag"),
        _flag((F.col("l_linenumber") == 7) & (F.col("o_orderstatus") == "F")).alias("wav_match_flag"),
    )
    return Binding(trips, zone_lookup(spark, sf_dir), params)


def events_binding(spark: SparkSession, sf_dir: str, base: Params | None = None) -> Binding:
    params = (base or Params()).with_(platforms=EVENTS_PLATFORMS, holiday_month=EVENTS_HOLIDAY_MONTH)
    ev = _table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    cust = _table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    joined = ev.join(cust, ev.user_id == cust.c_custkey)

    joined = joined.select(
        "*",
        F.get_json_object("props", "$.k").cast("long").alias("_k"),
        cents_of(F.col("value")).alias("_fare_c"),
    )
    k = F.col("_k")
    eid = F.col("event_id")
    fare_c = F.col("_fare_c")
    pu = F.col("c_nationkey").cast("int")
    trip_time = (eid % 37) * 60 + 120
    trips = joined.select(
        eid.alias("trip_id"),
        F.col("event_type").alias("hvfhs_license_num"),
        F.timestamp_add("SECOND", -k * 10, F.col("ts")).alias("request_datetime"),
        F.col("ts").alias("on_scene_datetime"),
        F.col("ts").alias("pickup_datetime"),
        F.timestamp_add("SECOND", trip_time, F.col("ts")).alias("dropoff_datetime"),
        pu.alias("PULocationID"),
        (eid % 25).cast("int").alias("DOLocationID"),
        from_units((eid % 120) * 100 + 100, 3, 10).alias("trip_miles"),
        trip_time.cast("long").alias("trip_time"),
        money(fare_c).alias("base_passenger_fare"),
        money(F.lit(None).cast("long")).alias("tolls"),
        money(idiv(fare_c * EVENTS_BCF_PER_MILLE + 500, 1000)).alias("bcf"),
        money(idiv(fare_c * EVENTS_SALES_TAX_PER_100K + 50000, 100000)).alias("sales_tax"),
        F.when(pu % 5 == 1, money(F.lit(EVENTS_SURCHARGE_CENTS))).alias("congestion_surcharge"),
        F.when(
            (pu % 5).isin(1, 2) & F.hour("ts").between(6, 19), money(F.lit(EVENTS_CBD_CENTS))
        ).alias("cbd_congestion_fee"),
        F.when((eid % 25).isin(0, 1), money(F.lit(EVENTS_AIRPORT_CENTS)))
        .when(eid % 25 == 2, money(F.lit(0)))
        .alias("airport_fee"),
        F.when(eid % 3 == 0, money(idiv(fare_c * EVENTS_TIP_PCT + 50, 100))).alias("tips"),
        money(idiv(fare_c * 62 + k * 1500 + 50, 100)).alias("driver_pay"),
        _flag(eid % 7 == 0).alias("shared_request_flag"),
        F.lit("N").alias("shared_match_flag"),
        F.lit("N").alias("access_a_ride_flag"),
        _flag(eid % 50 == 0).alias("wav_request_flag"),
        _flag(eid % 100 == 0).alias("wav_match_flag"),
    )
    return Binding(trips, zone_lookup(spark, sf_dir), params)


def mixed_binding(spark: SparkSession, sf_dir: str, base: Params | None = None) -> Binding:
    params = (base or Params()).with_(platforms=EVENTS_PLATFORMS, holiday_month=EVENTS_HOLIDAY_MONTH)
    ev = _table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    cust = _table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    joined = ev.join(cust, ev.user_id == cust.c_custkey)
    eid, n, hour = F.col("event_id"), F.col("c_nationkey").cast("int"), F.hour("ts")

    def by(index: F.Column, values: tuple) -> F.Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index.cast("int") + 1)

    zone = (
        F.when(eid % 50 == 7, 99)
        .when(eid % 50 == 8, F.lit(None).cast("int"))
        .when(n < 20, n % 10)
        .when((n >= 23) & (eid % 4 > 0), n - 20)
        .otherwise(n)
    )
    late = F.when((hour < 6) | (hour >= 23), 1).otherwise(0)
    joined = joined.select("*", zone.alias("_zone"), (n % 5).alias("_region"), F.least(n % 5 + late, F.lit(4)).alias("_sev"))
    z, r, sev = F.col("_zone"), F.col("_region"), F.col("_sev")
    step = eid % 9
    fare = (
        F.when(eid % 97 == 5, 0)
        .when(sev == 0, 2000 + step * 100)
        .when(sev == 1, 1100 + step * 240)
        .when(sev == 2, 800 + step * 500)
        .when(sev == 3, 780 + step * step * 62)
        .otherwise(F.when(eid % 10 == 0, 20000).otherwise(800))
        .cast("long")
    )
    pct = by(sev, MIXED_PAY_PCT) + F.when(F.col("event_type") == "signup", 4).otherwise(0)
    every = by(sev, MIXED_LONG_TRIPS)
    long_trip = (every > 0) & (eid % F.greatest(every, F.lit(1).cast("long")) == 3)
    wait_zone, wait_range = MIXED_STABLE_ZONE_WAIT
    joined = joined.select(
        "*",
        fare.alias("_fare_c"),
        F.when(long_trip, 7200).otherwise(180 + eid % 5 * 60).cast("long").alias("_secs"),
        (eid * 7919 % F.when(z == wait_zone, F.lit(wait_range).cast("long")).otherwise(by(sev, MIXED_WAITS))).alias("_wait"),
        pct.alias("_pct"),
    )
    fare_c, secs = F.col("_fare_c"), F.col("_secs")
    wav = r.isin(0, 1, 3) & (eid % 20 == 0)
    trips = joined.select(
        eid.alias("trip_id"),
        F.col("event_type").alias("hvfhs_license_num"),
        F.timestamp_add("SECOND", -F.col("_wait"), F.col("ts")).alias("request_datetime"),
        F.col("ts").alias("on_scene_datetime"),
        F.col("ts").alias("pickup_datetime"),
        F.timestamp_add("SECOND", secs, F.col("ts")).alias("dropoff_datetime"),
        z.alias("PULocationID"),
        F.when(eid % 10 >= 8, F.lit(None).cast("int")).when(eid % 10 < 3, 0).when(eid % 10 == 3, 1).otherwise((eid % 25).cast("int")).alias("DOLocationID"),
        from_units(F.when((sev == 0) & (eid % 12 == 0), 12000).otherwise(500 + eid % 30 * 100).cast("long"), 3, 10).alias("trip_miles"),
        secs.alias("trip_time"),
        money(fare_c).alias("base_passenger_fare"),
        money(F.lit(None).cast("long")).alias("tolls"),
        money(idiv(fare_c * EVENTS_BCF_PER_MILLE + 500, 1000)).alias("bcf"),
        money(idiv(fare_c * EVENTS_SALES_TAX_PER_100K + 50000, 100000)).alias("sales_tax"),
        money(by(r, MIXED_SURCHARGE_CENTS)).alias("congestion_surcharge"),
        F.when(eid % 25 < 2, money(F.lit(EVENTS_AIRPORT_CENTS))).when(eid % 25 == 2, money(F.lit(0))).alias("airport_fee"),
        F.when(z < MIXED_CBD_ZONES, money(F.lit(EVENTS_CBD_CENTS))).alias("cbd_congestion_fee"),
        F.when(eid % 3 == 0, money(idiv(fare_c * EVENTS_TIP_PCT + 50, 100))).alias("tips"),
        money(F.when(fare_c == 0, F.lit(2000).cast("long")).otherwise(idiv(fare_c * F.col("_pct") + 50, 100))).alias("driver_pay"),
        _flag(eid % 7 == 0).alias("shared_request_flag"),
        F.lit("N").alias("shared_match_flag"),
        F.lit("N").alias("access_a_ride_flag"),
        _flag(wav).alias("wav_request_flag"),
        _flag(wav & (r != 1) & (eid % 40 == 0)).alias("wav_match_flag"),
    )
    return Binding(trips, zone_lookup(spark, sf_dir), params)
