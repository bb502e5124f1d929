"""DuckDB CTEs: the two bindings and the enriched view in integer units.

Columns of ``v`` (one row per clean trip):
  company_name, trip_date, time_of_day, pu_borough, pu_zone, do_borough, do_zone,
  miles_m (1/1000 mile), secs, trip_min_c (1/100 min), wait_min_c (1/100 min), sla,
  fare_c, pay_c, tolls_c0, bcf_c0, tax_c0, surcharge_c0, airport_c0, cbd_c0, tips_c0 (cents),
  total_c, cong_c, spread_c (cents), take_bp (1/100 %), fpm_c, pph_c (cents),
  below, is_airport, the five flags, and the binding's tie-break columns.
"""

from __future__ import annotations


def rdiv(a: str, b: str) -> str:
    """a / b rounded half away from zero to an integer; NULL when b = 0."""
    A = f"CAST(({a}) AS HUGEINT)"
    B = f"CAST(NULLIF(({b}), 0) AS HUGEINT)"
    return f"(sign({A}) * sign({B}) * ((2 * abs({A}) + abs({B})) // (2 * abs({B}))))"


def dbl(x: str, scale: int) -> str:
    """An integer count of 10^-scale units as DOUBLE."""
    if scale == 0:
        return f"CAST(({x}) AS DOUBLE)"
    return f"(CAST(({x}) AS DOUBLE) / {10 ** scale})"


ZONES = """
zones AS (
    SELECT CAST(n.n_nationkey AS INTEGER) AS LocationID,
           r.r_name AS Borough, n.n_name AS Zone, r.r_name AS service_zone
    FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

ORDERS_RAW = """
src AS (
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_extendedprice,
           l.l_returnflag AS code,
           o.o_orderdate AS request_ts, l.l_shipdate AS pickup_ts,
           l.l_shipdate + INTERVAL 1 DAY AS dropoff_ts,
           CAST(c.c_nationkey AS INTEGER) AS pu_id, CAST(s.s_nationkey AS INTEGER) AS do_id,
           CAST(round(l.l_quantity * 1000) AS BIGINT) AS miles_m,
           CAST(p.p_size AS BIGINT) * 60 AS secs,
           CAST(round(l.l_extendedprice * 100) AS BIGINT) AS fare_c,
           CAST(round(l.l_quantity) AS BIGINT) * CAST(round(p.p_retailprice * 100) AS BIGINT) AS pay_c,
           CAST(round(l.l_tax * 100) AS BIGINT) AS tax_pct,
           CAST(round(l.l_discount * 100) AS BIGINT) AS disc_pct,
           o.o_orderpriority, o.o_orderstatus
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN part p ON l.l_partkey = p.p_partkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
),
raw AS (
    SELECT *,
           CASE WHEN l_linenumber = 2 THEN 694 END AS tolls_c,
           (fare_c * 25 + 500) // 1000 AS bcf_c,
           (fare_c * tax_pct + 50) // 100 AS tax_c,
           CASE WHEN do_id % 5 = 1 THEN 275 ELSE 0 END AS surcharge_c,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 250 END AS airport_c,
           CASE WHEN pu_id NOT IN (0, 7, 14) AND do_id % 3 = 0 THEN 150 ELSE 0 END AS cbd_c,
           (fare_c * disc_pct + 50) // 100 AS tips_c,
           CASE WHEN l_linenumber = 6 THEN 'Y' ELSE 'N' END AS shared_request_flag,
           'N' AS shared_match_flag,
           'N' AS access_a_ride_flag,
           CASE WHEN l_linenumber = 7 THEN 'Y' ELSE 'N' END AS wav_request_flag,
           CASE WHEN l_linenumber = 7 AND o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS wav_match_flag
    FROM src
)"""

EVENTS_RAW = """
src AS (
    SELECT e.event_id, e.event_type AS code, e.ts,
           CAST(json_extract(e.props, '$.k') AS BIGINT) AS k,
           CAST(c.c_nationkey AS INTEGER) AS pu_id,
           CAST(e.event_id % 25 AS INTEGER) AS do_id,
           (e.event_id % 120) * 100 + 100 AS miles_m,
           (e.event_id % 37) * 60 + 120 AS secs,
           CAST(round(e.value * 100) AS BIGINT) AS fare_c
    FROM events e JOIN customer c ON e.user_id = c.c_custkey
),
raw AS (
    SELECT *,
           ts - to_seconds(k * 10) AS request_ts,
           ts AS pickup_ts,
           ts + to_seconds(secs) AS dropoff_ts,
           (fare_c * 62 + k * 1500 + 50) // 100 AS pay_c,
           CAST(NULL AS BIGINT) AS tolls_c,
           (fare_c * 25 + 500) // 1000 AS bcf_c,
           (fare_c * 8875 + 50000) // 100000 AS tax_c,
           CASE WHEN pu_id % 5 = 1 THEN 275 END AS surcharge_c,
           CASE WHEN pu_id % 5 IN (1, 2) AND hour(ts) BETWEEN 6 AND 19 THEN 150 END AS cbd_c,
           CASE WHEN event_id % 25 IN (0, 1) THEN 500 WHEN event_id % 25 = 2 THEN 0 END AS airport_c,
           CASE WHEN event_id % 3 = 0 THEN (fare_c * 15 + 50) // 100 END AS tips_c,
           CASE WHEN event_id % 7 = 0 THEN 'Y' ELSE 'N' END AS shared_request_flag,
           'N' AS shared_match_flag,
           'N' AS access_a_ride_flag,
           CASE WHEN event_id % 50 = 0 THEN 'Y' ELSE 'N' END AS wav_request_flag,
           CASE WHEN event_id % 100 = 0 THEN 'Y' ELSE 'N' END AS wav_match_flag
    FROM src
)"""

MIXED_RAW = """
base AS (
    SELECT e.event_id, e.event_type AS code, e.ts, c.c_nationkey AS n, c.c_nationkey % 5 AS region,
           least(c.c_nationkey % 5 + CASE WHEN hour(e.ts) < 6 OR hour(e.ts) >= 23 THEN 1 ELSE 0 END, 4) AS sev,
           CASE WHEN e.event_id % 50 = 7 THEN 99 WHEN e.event_id % 50 = 8 THEN NULL WHEN c.c_nationkey < 20 THEN c.c_nationkey % 10
                WHEN c.c_nationkey >= 23 AND e.event_id % 4 > 0 THEN c.c_nationkey - 20 ELSE c.c_nationkey END AS pu_id
    FROM events e JOIN customer c ON e.user_id = c.c_custkey
),
src AS (
    SELECT *,
           CAST(CASE WHEN event_id % 97 = 5 THEN 0
                WHEN sev = 0 THEN 2000 + event_id % 9 * 100
                WHEN sev = 1 THEN 1100 + event_id % 9 * 240
                WHEN sev = 2 THEN 800 + event_id % 9 * 500
                WHEN sev = 3 THEN 780 + (event_id % 9) * (event_id % 9) * 62
                WHEN event_id % 10 = 0 THEN 20000 ELSE 800 END AS BIGINT) AS fare_c,
           CAST(CASE WHEN (sev = 2 AND event_id % 100 = 3) OR (sev = 4 AND event_id % 20 = 3)
                THEN 7200 ELSE 180 + event_id % 5 * 60 END AS BIGINT) AS secs,
           CAST(event_id * 7919 % CASE WHEN pu_id = 5 THEN 600 WHEN sev = 0 THEN 400 WHEN sev = 1 THEN 480 WHEN sev = 2 THEN 560
                WHEN sev = 3 THEN 700 ELSE 1000 END AS BIGINT) AS wait,
           CASE sev WHEN 0 THEN 72 WHEN 1 THEN 83 WHEN 2 THEN 88 WHEN 3 THEN 94 ELSE 104 END + CASE WHEN code = 'signup' THEN 4 ELSE 0 END AS pct,
           CASE WHEN event_id % 10 >= 8 THEN NULL WHEN event_id % 10 < 3 THEN 0 WHEN event_id % 10 = 3 THEN 1 ELSE event_id % 25 END AS do_id,
           CASE WHEN sev = 0 AND event_id % 12 = 0 THEN 12000 ELSE 500 + event_id % 30 * 100 END AS miles_m
    FROM base
),
raw AS (
    SELECT *,
           ts - to_seconds(wait) AS request_ts,
           ts AS pickup_ts,
           ts + to_seconds(secs) AS dropoff_ts,
           CASE WHEN fare_c = 0 THEN 2000 ELSE (fare_c * pct + 50) // 100 END AS pay_c,
           CAST(NULL AS BIGINT) AS tolls_c,
           (fare_c * 25 + 500) // 1000 AS bcf_c,
           (fare_c * 8875 + 50000) // 100000 AS tax_c,
           CASE region WHEN 0 THEN 400 WHEN 1 THEN 150 ELSE 50 END AS surcharge_c,
           CASE WHEN pu_id < 9 THEN 150 END AS cbd_c,
           CASE WHEN event_id % 25 < 2 THEN 500 WHEN event_id % 25 = 2 THEN 0 END AS airport_c,
           CASE WHEN event_id % 3 = 0 THEN (fare_c * 15 + 50) // 100 END AS tips_c,
           CASE WHEN event_id % 7 = 0 THEN 'Y' ELSE 'N' END AS shared_request_flag,
           'N' AS shared_match_flag,
           'N' AS access_a_ride_flag,
           CASE WHEN region IN (0, 1, 3) AND event_id % 20 = 0 THEN 'Y' ELSE 'N' END AS wav_request_flag,
           CASE WHEN region IN (0, 3) AND event_id % 40 = 0 THEN 'Y' ELSE 'N' END AS wav_match_flag
    FROM src
)"""

# binding -> (raw CTEs, platform codes/labels, max wait s, SLA s, cents per mile,
#             cents per minute, holiday month, tie-break columns)
BINDINGS = {
    "orders": dict(
        raw=ORDERS_RAW,
        platforms=(("A", "Uber"), ("R", "Lyft")),
        max_wait=2000 * 86400,
        sla=365 * 86400,
        rate_mile_c=90000,
        rate_min_c=200,
        holiday_month=12,
        tiebreak=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"),
    ),
    "events": dict(
        raw=EVENTS_RAW,
        platforms=(("purchase", "Uber"), ("signup", "Lyft")),
        max_wait=7200,
        sla=300,
        rate_mile_c=82,
        rate_min_c=57,
        holiday_month=1,
        tiebreak=("event_id",),
    ),
}
BINDINGS["mixed"] = BINDINGS["events"] | {"raw": MIXED_RAW}


def enriched_ctes(binding: str) -> str:
    b = BINDINGS[binding]
    codes = ", ".join(f"'{code}'" for code, _ in b["platforms"])
    company = " ".join(f"WHEN '{code}' THEN '{label}'" for code, label in b["platforms"])
    floor_c = rdiv(f"miles_m * {b['rate_mile_c']} * 60 + secs * {b['rate_min_c']} * 1000", "60000")
    return f"""WITH {ZONES},{b['raw']},
trips AS (
    SELECT *, (epoch_us(pickup_ts) - epoch_us(request_ts)) // 1000000 AS wait_s
    FROM raw
    WHERE pickup_ts IS NOT NULL AND dropoff_ts IS NOT NULL AND request_ts IS NOT NULL
      AND fare_c IS NOT NULL AND pay_c IS NOT NULL
      AND miles_m > 0 AND secs > 0 AND code IN ({codes})
),
v AS (
    SELECT t.*,
           CASE t.code {company} ELSE 'Other' END AS company_name,
           CAST(t.pickup_ts AS DATE) AS trip_date,
           CASE WHEN hour(t.pickup_ts) BETWEEN 6 AND 9 THEN 'AM Rush'
                WHEN hour(t.pickup_ts) BETWEEN 10 AND 15 THEN 'Midday'
                WHEN hour(t.pickup_ts) BETWEEN 16 AND 19 THEN 'PM Rush'
                WHEN hour(t.pickup_ts) BETWEEN 20 AND 22 THEN 'Evening'
                ELSE 'Late Night' END AS time_of_day,
           pu.Borough AS pu_borough, pu.Zone AS pu_zone,
           dz.Borough AS do_borough, dz.Zone AS do_zone,
           (2 * t.secs * 100 + 60) // 120 AS trip_min_c,
           (2 * t.wait_s * 100 + 60) // 120 AS wait_min_c,
           CASE WHEN t.wait_s <= {b['sla']} THEN 1 ELSE 0 END AS sla,
           coalesce(t.tolls_c, 0) AS tolls_c0,
           coalesce(t.bcf_c, 0) AS bcf_c0,
           coalesce(t.tax_c, 0) AS tax_c0,
           coalesce(t.surcharge_c, 0) AS surcharge_c0,
           coalesce(t.airport_c, 0) AS airport_c0,
           coalesce(t.cbd_c, 0) AS cbd_c0,
           coalesce(t.tips_c, 0) AS tips_c0,
           t.fare_c + coalesce(t.tolls_c, 0) + coalesce(t.bcf_c, 0) + coalesce(t.tax_c, 0)
             + coalesce(t.surcharge_c, 0) + coalesce(t.airport_c, 0) + coalesce(t.cbd_c, 0)
             + coalesce(t.tips_c, 0) AS total_c,
           coalesce(t.surcharge_c, 0) + coalesce(t.cbd_c, 0) AS cong_c,
           t.fare_c - t.pay_c AS spread_c,
           CASE WHEN t.fare_c > 0 THEN {rdiv('(t.fare_c - t.pay_c) * 10000', 't.fare_c')} END AS take_bp,
           CASE WHEN t.miles_m > 0 THEN {rdiv('t.fare_c * 1000', 't.miles_m')} END AS fpm_c,
           CASE WHEN t.secs > 0 THEN {rdiv('t.pay_c * 3600', 't.secs')} END AS pph_c,
           CASE WHEN t.miles_m > 0 AND t.secs > 0
                THEN CASE WHEN t.pay_c < {floor_c.replace('miles_m', 't.miles_m').replace('secs', 't.secs')} THEN 1 ELSE 0 END
           END AS below,
           CASE WHEN t.airport_c > 0 THEN 1 ELSE 0 END AS is_airport
    FROM trips t
    LEFT JOIN zones pu ON t.pu_id = pu.LocationID
    LEFT JOIN zones dz ON t.do_id = dz.LocationID
    WHERE t.wait_s BETWEEN 0 AND {b['max_wait']}
)"""


def due_u(binding: str) -> str:
    """Legal minimum due from rounded minutes, in 1/1000 cent."""
    b = BINDINGS[binding]
    return f"(miles_m * {b['rate_mile_c']} + 10 * trip_min_c * {b['rate_min_c']})"
