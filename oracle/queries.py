"""Oracle SQL per registered query key."""

from __future__ import annotations

from oracle.base import BINDINGS, dbl, due_u, enriched_ctes, rdiv


def _avg(col: str, scale_mult: str = "1", count: str | None = None) -> str:
    """Mean of an integer-unit column in the same units, rounded (2 dp of cents etc.)."""
    n = count or f"COUNT({col})"
    return rdiv(f"SUM({col})", f"{scale_mult} * {n}")


def money_avg(col: str) -> str:
    return dbl(_avg(col), 2)


def miles_avg() -> str:
    return dbl(rdiv("SUM(miles_m)", "10 * COUNT(miles_m)"), 2)


def take_rate() -> str:
    return dbl(rdiv("(SUM(fare_c) - SUM(pay_c)) * 10000", "SUM(fare_c)"), 2)


def pct_rows(cond: str, scale: int = 2) -> str:
    return dbl(rdiv(f"SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) * {100 * 10 ** scale}", "COUNT(*)"), scale)


def sla_pct() -> str:
    return dbl(rdiv("SUM(sla) * 10000", "COUNT(sla)"), 2)


def total0(col: str) -> str:
    return dbl(rdiv(f"SUM({col})", "100"), 0)


def share(num_sum: str, den_sum: str = "SUM(total_c)") -> str:
    return dbl(rdiv(f"({num_sum}) * 1000", den_sum), 1)


# --- P0 --------------------------------------------------------------------


def p0(binding: str) -> str:
    tb = BINDINGS[binding]["tiebreak"]
    key = ", ".join(f"epoch_us({k}) AS {k}" if k == "l_shipdate" else k for k in tb) if binding == "orders" else "event_id AS trip_id"
    return f"""{enriched_ctes(binding)}
SELECT code AS hvfhs_license_num, company_name,
       epoch_us(request_ts) AS request_datetime, epoch_us(pickup_ts) AS on_scene_datetime,
       epoch_us(pickup_ts) AS pickup_datetime, epoch_us(dropoff_ts) AS dropoff_datetime,
       CAST(trip_date AS VARCHAR) AS trip_date, time_of_day,
       CAST(pu_id AS BIGINT) AS PULocationID, CAST(do_id AS BIGINT) AS DOLocationID,
       pu_borough, pu_zone, pu_borough AS pu_service_zone,
       do_borough, do_zone, do_borough AS do_service_zone,
       {dbl('miles_m', 3)} AS trip_miles, {dbl('trip_min_c', 2)} AS trip_min,
       {dbl('wait_min_c', 2)} AS request_to_pickup_min, CAST(sla AS BIGINT) AS sla_5min_met,
       {dbl('fare_c', 2)} AS base_passenger_fare, {dbl('tolls_c0', 2)} AS tolls, {dbl('bcf_c0', 2)} AS bcf,
       {dbl('tax_c0', 2)} AS sales_tax, {dbl('surcharge_c0', 2)} AS congestion_surcharge,
       {dbl('airport_c0', 2)} AS airport_fee, {dbl('cbd_c0', 2)} AS cbd_congestion_fee,
       {dbl('tips_c0', 2)} AS tips, {dbl('pay_c', 2)} AS driver_pay,
       {dbl('total_c', 2)} AS passenger_total_charge, {dbl('cong_c', 2)} AS total_congestion_fees,
       {dbl('spread_c', 2)} AS platform_spread, {dbl('take_bp', 2)} AS take_rate_pct,
       {dbl('fpm_c', 2)} AS fare_per_mile, {dbl('pph_c', 2)} AS driver_pay_per_hour,
       CAST(below AS BIGINT) AS below_tlc_minimum, CAST(is_airport AS BIGINT) AS is_airport_trip,
       shared_request_flag, shared_match_flag, access_a_ride_flag, wav_request_flag, wav_match_flag,
       {key}
FROM v"""


# --- P1 --------------------------------------------------------------------


def p1(binding: str) -> str:
    return f"""{enriched_ctes(binding)}
SELECT company_name,
       COUNT(*) AS total_trips,
       {dbl(rdiv('COUNT(*) * 10000', 'SUM(COUNT(*)) OVER ()'), 2)} AS market_share_pct,
       {money_avg('fare_c')} AS avg_base_fare,
       {money_avg('total_c')} AS avg_total_charge,
       {money_avg('pay_c')} AS avg_driver_pay,
       {money_avg('tips_c0')} AS avg_tip,
       {money_avg('pph_c')} AS avg_driver_hourly,
       {take_rate()} AS avg_take_rate_pct,
       {money_avg('spread_c')} AS avg_platform_spread,
       {pct_rows('take_bp < 0')} AS negative_take_rate_pct,
       {miles_avg()} AS avg_trip_miles,
       {money_avg('trip_min_c')} AS avg_trip_min,
       {money_avg('fpm_c')} AS avg_fare_per_mile,
       {money_avg('wait_min_c')} AS avg_wait_min,
       {sla_pct()} AS sla_5min_pct,
       {pct_rows('below = 1')} AS below_tlc_min_pct,
       {total0('fare_c')} AS total_base_revenue,
       {total0('total_c')} AS total_charge_revenue,
       {total0('spread_c')} AS total_platform_margin
FROM v
GROUP BY company_name
ORDER BY total_trips DESC, company_name"""




# --- shared fragments -------------------------------------------------------


def sqrt_round(v: str, d: str, mult: int) -> str:
    """round_half_up(mult * sqrt(v) / d), exact: double estimate corrected by one."""
    m0 = f"CAST(floor({mult} * sqrt(CAST(({v}) AS DOUBLE)) / CAST(({d}) AS DOUBLE) + 0.5) AS HUGEINT)"
    fv = f"(CAST(({v}) AS HUGEINT) * {4 * mult * mult})"
    hi = f"((2 * {m0} + 1) * ({d}))"
    lo = f"((2 * {m0} - 1) * ({d}))"
    return f"({m0} + CASE WHEN {hi} * {hi} <= {fv} THEN 1 WHEN {m0} >= 1 AND {lo} * {lo} > {fv} THEN -1 ELSE 0 END)"


MOMENTS = (
    "COUNT(fare_c) AS m_n, SUM(CAST(fare_c AS HUGEINT)) AS m_s, "
    "CAST(COUNT(fare_c) AS HUGEINT) * SUM(CAST(fare_c AS HUGEINT) * fare_c) "
    "- SUM(CAST(fare_c AS HUGEINT)) * SUM(CAST(fare_c AS HUGEINT)) AS m_v"
)
STDDEV_C = sqrt_round("m_v", "m_n", 1)
CV_T = f"CASE WHEN m_s > 0 THEN {sqrt_round('m_v', 'm_s', 1000)} WHEN m_s < 0 THEN -{sqrt_round('m_v', '-m_s', 1000)} END"

AVG_FARE_C = _avg("fare_c")
TAKE_BP = rdiv("(SUM(fare_c) - SUM(pay_c)) * 10000", "SUM(fare_c)")
SLA_BP = rdiv("SUM(sla) * 10000", "COUNT(sla)")
NEG_BP = rdiv("SUM(CASE WHEN take_bp < 0 THEN 1 ELSE 0 END) * 10000", "COUNT(*)")
VIOL_BP = rdiv("SUM(below) * 10000", "COUNT(below)")
WAIT_C = _avg("wait_min_c")


def nf(cols: str) -> str:
    """ORDER BY list with NULLS FIRST on each ascending key (Spark's default)."""
    return ", ".join(f"{x.strip()} NULLS FIRST" for x in cols.split(","))


def distance_band(bands: tuple, rest: str) -> str:
    rungs = " ".join(f"WHEN miles_m < {b * 1000} THEN '{label}'" for b, label in bands)
    return f"CASE {rungs} ELSE '{rest}' END"


PAY_BANDS = ((1, "Under 1 mile"), (2, "1 to 2 miles"), (3, "2 to 3 miles"), (5, "3 to 5 miles"))
CONG_BANDS = PAY_BANDS + ((10, "5 to 10 miles"),)
PAY_ORDER = [label for _, label in PAY_BANDS] + ["5 plus miles"]
CONG_ORDER = [label for _, label in CONG_BANDS] + ["10 plus miles"]
TIME_ORDER = ["AM Rush", "Midday", "PM Rush", "Evening", "Late Night"]


def field_pos(col: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {col} = '{v}' THEN {i}" for i, v in enumerate(values, 1))
    return f"CASE {arms} ELSE 0 END"


# --- P2 ---------------------------------------------------------------------


def p2a(binding: str) -> str:
    return f"""{enriched_ctes(binding)}
SELECT 'Borough Summary' AS section, pu_borough AS borough, company_name,
       COUNT(*) AS total_trips,
       {money_avg('fare_c')} AS avg_base_fare,
       {money_avg('total_c')} AS avg_total_charge,
       {money_avg('pay_c')} AS avg_driver_pay,
       {take_rate()} AS avg_take_rate_pct,
       {miles_avg()} AS avg_miles,
       {money_avg('fpm_c')} AS avg_fare_per_mile,
       {money_avg('wait_min_c')} AS avg_wait_min,
       {sla_pct()} AS sla_5min_pct,
       {pct_rows('take_bp < 0')} AS negative_take_rate_pct,
       CAST(RANK() OVER (PARTITION BY company_name ORDER BY COUNT(*) DESC) AS BIGINT) AS volume_rank_within_platform
FROM v WHERE pu_borough IS NOT NULL
GROUP BY pu_borough, company_name
ORDER BY company_name, total_trips DESC, borough"""


def p2b(binding: str) -> str:
    return f"""{enriched_ctes(binding)}
SELECT 'Borough x Time' AS section, pu_borough AS borough, time_of_day, company_name,
       COUNT(*) AS total_trips,
       {money_avg('fare_c')} AS avg_base_fare,
       {money_avg('total_c')} AS avg_total_charge,
       {money_avg('pay_c')} AS avg_driver_pay,
       {take_rate()} AS avg_take_rate_pct,
       {money_avg('wait_min_c')} AS avg_wait_min,
       {sla_pct()} AS sla_5min_pct,
       CASE WHEN SUM(sla) * 100 < 50 * COUNT(sla) THEN 'UNDERSERVED'
            WHEN SUM(sla) * 100 < 58 * COUNT(sla) THEN 'AT RISK'
            ELSE 'ADEQUATE' END AS service_status
FROM v WHERE pu_borough IS NOT NULL
GROUP BY pu_borough, time_of_day, company_name
ORDER BY borough, company_name, {field_pos('time_of_day', TIME_ORDER)}"""


# --- P3 ---------------------------------------------------------------------


def p3a(binding: str) -> str:
    return f"""{enriched_ctes(binding)}
SELECT 'Top Corridors' AS section, pu_borough AS origin_borough, pu_zone AS origin_zone,
       do_borough AS dest_borough, do_zone AS dest_zone,
       pu_borough || ' to ' || do_borough AS corridor,
       COUNT(*) AS total_trips,
       {money_avg('fare_c')} AS avg_base_fare,
       {money_avg('total_c')} AS avg_total_charge,
       {money_avg('pay_c')} AS avg_driver_pay,
       {take_rate()} AS take_rate_pct,
       {miles_avg()} AS avg_miles,
       {money_avg('fpm_c')} AS avg_fare_per_mile,
       {sla_pct()} AS sla_5min_pct,
       {money_avg('wait_min_c')} AS avg_wait_min,
       {total0('fare_c')} AS total_base_revenue
FROM v WHERE pu_borough IS NOT NULL AND do_borough IS NOT NULL
GROUP BY pu_borough, pu_zone, do_borough, do_zone
HAVING COUNT(*) >= 50
ORDER BY total_trips DESC, {nf('origin_borough, origin_zone, dest_borough, dest_zone')}
LIMIT 20"""


def p3b(binding: str) -> str:
    return f"""{enriched_ctes(binding)}
SELECT 'Airport Segment' AS section, company_name,
       CASE WHEN is_airport = 1 THEN 'Airport' ELSE 'Non-Airport' END AS trip_type,
       COUNT(*) AS total_trips,
       {money_avg('fare_c')} AS avg_base_fare,
       {money_avg('total_c')} AS avg_total_charge,
       {money_avg('pay_c')} AS avg_driver_pay,
       {take_rate()} AS take_rate_pct,
       {miles_avg()} AS avg_miles,
       {money_avg('fpm_c')} AS avg_fare_per_mile,
       {sla_pct()} AS sla_5min_pct,
       {money_avg('wait_min_c')} AS avg_wait_min
FROM v GROUP BY company_name, is_airport
ORDER BY company_name, is_airport DESC"""


def p3c(binding: str) -> str:
    return f"""{enriched_ctes(binding)}
SELECT 'Borough Matrix' AS section, pu_borough AS origin, do_borough AS destination,
       COUNT(*) AS total_trips,
       {money_avg('fare_c')} AS avg_base_fare,
       {money_avg('fpm_c')} AS avg_fare_per_mile,
       {take_rate()} AS take_rate_pct,
       {sla_pct()} AS sla_5min_pct,
       {total0('fare_c')} AS total_revenue
FROM v WHERE pu_borough IS NOT NULL AND do_borough IS NOT NULL
GROUP BY pu_borough, do_borough
ORDER BY total_trips DESC, {nf('origin, destination')}
LIMIT 25"""


# --- P4 / W3 ----------------------------------------------------------------


def _deciled(binding: str) -> str:
    tb = ", ".join(BINDINGS[binding]["tiebreak"])
    return f"""{enriched_ctes(binding)},
deciled AS (
    SELECT *, NTILE(10) OVER (PARTITION BY company_name ORDER BY fare_c, {tb}) AS fare_decile
    FROM v WHERE take_bp IS NOT NULL
)"""


def p4(binding: str) -> str:
    money_txt = "CAST(CAST({} AS DECIMAL(18,0)) * 0.01 AS VARCHAR)"
    return f"""{_deciled(binding)}
SELECT 'Decile Summary' AS section, company_name, CAST(fare_decile AS BIGINT) AS fare_decile,
       '$' || {money_txt.format('MIN(fare_c)')} || ' to $' || {money_txt.format('MAX(fare_c)')} AS fare_range,
       COUNT(*) AS trips_in_decile,
       {money_avg('fare_c')} AS avg_base_fare,
       {money_avg('pay_c')} AS avg_driver_pay,
       {take_rate()} AS avg_take_rate_pct,
       {money_avg('spread_c')} AS avg_platform_spread,
       {miles_avg()} AS avg_miles,
       CAST(SUM(CASE WHEN take_bp < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_take_rate_trips,
       {pct_rows('take_bp < 0')} AS negative_take_rate_pct,
       {total0('spread_c')} AS total_margin,
       CASE WHEN SUM(take_bp) >= 2000 * COUNT(take_bp) THEN 'HEALTHY'
            WHEN SUM(take_bp) >= 1000 * COUNT(take_bp) THEN 'MODERATE'
            WHEN SUM(take_bp) >= 0 THEN 'THIN'
            ELSE 'LOSS MAKING' END AS margin_health
FROM deciled
GROUP BY company_name, fare_decile
ORDER BY company_name, fare_decile"""


def w3(binding: str) -> str:
    if binding == "orders":
        key = ("l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, "
               "epoch_us(l_shipdate) AS l_shipdate, l_extendedprice")
    else:
        key = "event_id AS trip_id"
    return f"""{_deciled(binding)}
SELECT company_name, {key}, {dbl('fare_c', 2)} AS base_passenger_fare,
       CAST(fare_decile AS BIGINT) AS fare_decile
FROM deciled"""


# --- P5 ---------------------------------------------------------------------


def p5a(binding: str) -> str:
    return f"""{enriched_ctes(binding)}
SELECT 'Platform Decomposition' AS section, company_name,
       COUNT(*) AS total_trips,
       {money_avg('fare_c')} AS avg_base_fare,
       {money_avg('tolls_c0')} AS avg_tolls,
       {money_avg('bcf_c0')} AS avg_bcf,
       {money_avg('tax_c0')} AS avg_sales_tax,
       {money_avg('surcharge_c0')} AS avg_congestion_surcharge,
       {money_avg('cbd_c0')} AS avg_cbd_fee,
       {money_avg('airport_c0')} AS avg_airport_fee,
       {money_avg('tips_c0')} AS avg_tips,
       {money_avg('total_c')} AS avg_total_charge,
       {share('SUM(fare_c)')} AS base_pct_of_total,
       {share('SUM(surcharge_c0)')} AS congestion_pct_of_total,
       {share('SUM(cbd_c0)')} AS cbd_pct_of_total,
       {share('SUM(surcharge_c0) + SUM(cbd_c0)')} AS total_congestion_pct,
       {share('SUM(tax_c0)')} AS tax_pct_of_total,
       {share('SUM(tips_c0)')} AS tips_pct_of_total,
       {share('SUM(pay_c)')} AS driver_pct_of_total,
       {share('SUM(spread_c)')} AS platform_pct_of_total
FROM v GROUP BY company_name ORDER BY company_name"""


def p5b(binding: str) -> str:
    return f"""{enriched_ctes(binding)}
SELECT 'Borough Fee Burden' AS section, pu_borough AS borough, company_name,
       COUNT(*) AS total_trips,
       {money_avg('fare_c')} AS avg_base_fare,
       {money_avg('total_c')} AS avg_total_charge,
       {money_avg('cong_c')} AS avg_congestion_fees,
       {share('SUM(cong_c)')} AS congestion_burden_pct,
       {money_avg('tips_c0')} AS avg_tips,
       {money_avg('pay_c')} AS avg_driver_pay
FROM v WHERE pu_borough IS NOT NULL
GROUP BY pu_borough, company_name ORDER BY borough, company_name"""


def p5c(binding: str) -> str:
    return f"""{enriched_ctes(binding)}
SELECT 'Airport Fee Structure' AS section, company_name,
       CASE WHEN is_airport = 1 THEN 'Airport' ELSE 'Non-Airport' END AS trip_type,
       COUNT(*) AS total_trips,
       {money_avg('fare_c')} AS avg_base_fare,
       {money_avg('airport_c0')} AS avg_airport_fee,
       {money_avg('total_c')} AS avg_total_charge,
       {share('SUM(airport_c0)')} AS airport_fee_pct_of_total,
       {take_rate()} AS take_rate_pct
FROM v GROUP BY company_name, is_airport ORDER BY company_name, is_airport DESC"""


# --- P6 ---------------------------------------------------------------------


def _violations() -> str:
    return f"CAST(SUM(below) AS BIGINT) AS violation_trips, {dbl(VIOL_BP, 2)} AS violation_pct"


def _due(binding: str) -> str:
    return dbl(rdiv(f"SUM({due_u(binding)})", "1000 * COUNT(*)"), 2)


def _shortfall(binding: str) -> str:
    return dbl(
        rdiv(
            f"SUM(CASE WHEN below = 1 THEN {due_u(binding)} - 1000 * pay_c END)",
            "1000 * COUNT(CASE WHEN below = 1 THEN 1 END)",
        ),
        2,
    )


def p6a(binding: str) -> str:
    return f"""{enriched_ctes(binding)}
SELECT 'Platform Summary' AS section, company_name,
       COUNT(*) AS total_trips, {_violations()},
       {money_avg('pay_c')} AS avg_driver_pay,
       {money_avg('pph_c')} AS avg_driver_hourly,
       {miles_avg()} AS avg_miles,
       {money_avg('trip_min_c')} AS avg_trip_min,
       {_due(binding)} AS avg_tlc_minimum_due,
       {_shortfall(binding)} AS avg_shortfall_on_violations
FROM v WHERE below IS NOT NULL
GROUP BY company_name ORDER BY violation_pct DESC, company_name"""


def p6b(binding: str) -> str:
    return f"""{enriched_ctes(binding)}
SELECT 'Borough Breakdown' AS section, company_name, pu_borough AS borough,
       COUNT(*) AS total_trips, {_violations()},
       {money_avg('pay_c')} AS avg_driver_pay,
       {money_avg('pph_c')} AS avg_driver_hourly,
       CASE WHEN SUM(below) * 100 >= COUNT(below) THEN 'HIGH RISK'
            WHEN SUM(below) * 200 >= COUNT(below) THEN 'MODERATE'
            WHEN SUM(below) > 0 THEN 'LOW'
            ELSE 'COMPLIANT' END AS compliance_status
FROM v WHERE below IS NOT NULL AND pu_borough IS NOT NULL
GROUP BY company_name, pu_borough ORDER BY company_name, violation_pct DESC, borough"""


def p6c(binding: str) -> str:
    return f"""{enriched_ctes(binding)}
SELECT 'Time of Day Breakdown' AS section, company_name, time_of_day,
       COUNT(*) AS total_trips, {_violations()},
       {money_avg('pay_c')} AS avg_driver_pay,
       {miles_avg()} AS avg_miles,
       {money_avg('trip_min_c')} AS avg_trip_min
FROM v WHERE below IS NOT NULL
GROUP BY company_name, time_of_day ORDER BY company_name, violation_pct DESC, time_of_day"""


def p6d(binding: str) -> str:
    return f"""{enriched_ctes(binding)}, b AS (SELECT *, {distance_band(PAY_BANDS, '5 plus miles')} AS distance_band FROM v)
SELECT 'Short Trip Analysis' AS section, company_name, distance_band,
       COUNT(*) AS total_trips, {_violations()},
       {money_avg('pay_c')} AS avg_driver_pay,
       {_due(binding)} AS avg_tlc_minimum_due,
       {_shortfall(binding)} AS avg_shortfall
FROM b WHERE below IS NOT NULL
GROUP BY company_name, distance_band ORDER BY company_name, {field_pos('distance_band', PAY_ORDER)}"""


# --- P7 ---------------------------------------------------------------------


def p7a(binding: str) -> str:
    return f"""{enriched_ctes(binding)}
SELECT 'Borough Congestion Burden' AS section, pu_borough AS borough, company_name,
       COUNT(*) AS total_trips,
       {money_avg('fare_c')} AS avg_base_fare,
       {money_avg('total_c')} AS avg_total_charge,
       {money_avg('surcharge_c0')} AS avg_congestion_surcharge,
       {money_avg('cbd_c0')} AS avg_cbd_fee,
       {money_avg('cong_c')} AS avg_total_congestion,
       {share('SUM(cong_c)')} AS congestion_burden_pct,
       {share('SUM(cong_c)', 'SUM(fare_c)')} AS congestion_vs_base_pct,
       {pct_rows('cong_c > 0', 1)} AS trips_with_congestion_pct,
       CASE WHEN SUM(total_c) > 0 AND SUM(cong_c) * 100 >= 10 * SUM(total_c) THEN 'HIGH BURDEN'
            WHEN SUM(total_c) > 0 AND SUM(cong_c) * 100 >= 5 * SUM(total_c) THEN 'MODERATE BURDEN'
            ELSE 'LOW BURDEN' END AS equity_status
FROM v WHERE pu_borough IS NOT NULL
GROUP BY pu_borough, company_name ORDER BY congestion_burden_pct DESC, borough, company_name"""


def p7b(binding: str) -> str:
    return f"""{enriched_ctes(binding)}, b AS (SELECT *, {distance_band(CONG_BANDS, '10 plus miles')} AS distance_band FROM v)
SELECT 'Distance Band Burden' AS section, company_name, distance_band,
       COUNT(*) AS total_trips,
       {money_avg('fare_c')} AS avg_base_fare,
       {money_avg('cong_c')} AS avg_congestion_fees,
       {share('SUM(cong_c)')} AS congestion_burden_pct
FROM b GROUP BY company_name, distance_band ORDER BY company_name, {field_pos('distance_band', CONG_ORDER)}"""


def p7c(binding: str) -> str:
    return f"""{enriched_ctes(binding)}
SELECT 'CBD Zone Footprint' AS section, pu_borough AS borough, pu_zone AS zone,
       COUNT(*) AS total_trips,
       {money_avg('cbd_c0')} AS avg_cbd_fee,
       {total0('cbd_c0')} AS total_cbd_fees_collected,
       {pct_rows('cbd_c0 > 0', 1)} AS trips_with_cbd_fee_pct
FROM v WHERE pu_borough IS NOT NULL
GROUP BY pu_borough, pu_zone
HAVING SUM(cbd_c0) > 0
ORDER BY total_cbd_fees_collected DESC, {nf('borough, zone')}
LIMIT 20"""


# --- P8 ---------------------------------------------------------------------


def p8a(binding: str) -> str:
    hm = BINDINGS[binding]["holiday_month"]
    return f"""{enriched_ctes(binding)},
daily AS (
    SELECT trip_date, company_name, COUNT(*) AS daily_trips,
           {rdiv('SUM(fare_c)', '100')} AS rev,
           {rdiv('SUM(total_c)', '100')} AS total_rev,
           {rdiv('SUM(spread_c)', '100')} AS margin,
           {AVG_FARE_C} AS fare_avg_c, {TAKE_BP} AS take_bp_g, {SLA_BP} AS sla_bp_g
    FROM v GROUP BY trip_date, company_name
),
w AS (
    SELECT *,
           LAG(rev) OVER (PARTITION BY company_name ORDER BY trip_date) AS prev,
           SUM(rev) OVER (PARTITION BY company_name ORDER BY trip_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS r7_sum,
           COUNT(rev) OVER (PARTITION BY company_name ORDER BY trip_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS r7_n,
           SUM(rev) OVER (PARTITION BY company_name ORDER BY trip_date ROWS UNBOUNDED PRECEDING) AS cum,
           RANK() OVER (PARTITION BY company_name ORDER BY rev DESC) AS rnk
    FROM daily
)
SELECT 'Daily Revenue Trend' AS section, CAST(trip_date AS VARCHAR) AS trip_date, company_name,
       daily_trips, {dbl('rev', 0)} AS daily_base_revenue, {dbl('total_rev', 0)} AS daily_total_revenue,
       {dbl('margin', 0)} AS daily_margin, {dbl('fare_avg_c', 2)} AS avg_base_fare,
       {dbl('take_bp_g', 2)} AS avg_take_rate_pct, {dbl('sla_bp_g', 2)} AS sla_5min_pct,
       {dbl('prev', 0)} AS prev_day_revenue,
       CASE WHEN prev IS NOT NULL AND prev > 0 THEN {dbl(rdiv('(rev - prev) * 1000', 'prev'), 1)} END AS dod_change_pct,
       {dbl(rdiv('r7_sum', 'r7_n'), 0)} AS rolling_7day_avg,
       {dbl('cum', 0)} AS cumulative_revenue,
       CAST(rnk AS BIGINT) AS revenue_rank,
       CASE WHEN rnk = 1 THEN 'PEAK DAY'
            WHEN month(trip_date) = {hm} AND day(trip_date) = 25 THEN 'CHRISTMAS TROUGH'
            WHEN month(trip_date) = {hm} AND day(trip_date) = 26 THEN 'RECOVERY START'
            WHEN month(trip_date) = {hm} AND day(trip_date) IN (24, 31) THEN 'HOLIDAY EVE'
       END AS day_label
FROM w ORDER BY company_name, trip_date"""


def p8b(binding: str) -> str:
    return f"""{enriched_ctes(binding)},
daily AS (SELECT trip_date, company_name, {rdiv('SUM(fare_c)', '100')} AS rev FROM v GROUP BY trip_date, company_name),
e AS (SELECT *, MAX(rev) OVER (PARTITION BY company_name) AS mx, MIN(rev) OVER (PARTITION BY company_name) AS mn FROM daily)
SELECT 'Peak vs Trough' AS section, company_name,
       CAST(MAX(CASE WHEN rev = mx THEN trip_date END) AS VARCHAR) AS peak_date,
       {dbl('MAX(rev)', 0)} AS peak_revenue,
       CAST(MIN(CASE WHEN rev = mn THEN trip_date END) AS VARCHAR) AS trough_date,
       {dbl('MIN(rev)', 0)} AS trough_revenue,
       {dbl(rdiv('(MIN(rev) - MAX(rev)) * 1000', 'MAX(rev)'), 1)} AS cliff_pct,
       {dbl(rdiv('MAX(rev) * 100', 'MIN(rev)'), 2)} AS peak_to_trough_ratio
FROM e GROUP BY company_name ORDER BY company_name"""


# --- P9 ---------------------------------------------------------------------


def p9a(binding: str) -> str:
    return f"""{enriched_ctes(binding)},
zs AS (
    SELECT pu_borough AS borough, pu_zone AS zone, company_name, COUNT(*) AS total_trips,
           {AVG_FARE_C} AS avg_fare_c, MIN(fare_c) AS fmin, MAX(fare_c) AS fmax,
           {SLA_BP} AS sla_bp, {TAKE_BP} AS take_bp_g, {MOMENTS}
    FROM v WHERE pu_zone IS NOT NULL
    GROUP BY pu_borough, pu_zone, company_name HAVING COUNT(*) >= 30
),
s AS (SELECT *, {STDDEV_C} AS sd_c, {CV_T} AS cv_t FROM zs)
SELECT 'Zone Volatility' AS section, borough, zone, company_name, total_trips,
       {dbl('avg_fare_c', 2)} AS avg_fare, {dbl('sd_c', 2)} AS fare_stddev,
       {dbl('fmin', 2)} AS fare_min, {dbl('fmax', 2)} AS fare_max, {dbl('fmax - fmin', 2)} AS fare_range,
       {dbl('cv_t', 1)} AS coeff_of_variation_pct, {dbl('sla_bp', 2)} AS sla_pct,
       {dbl('take_bp_g', 2)} AS avg_take_rate_pct,
       CASE WHEN cv_t >= 600 THEN 'HIGH VOLATILITY' WHEN cv_t >= 350 THEN 'MODERATE VOLATILITY'
            ELSE 'STABLE' END AS volatility_class,
       CASE WHEN cv_t < 350 AND total_trips >= 100 AND sla_bp < 5800 THEN 'ENTRY OPPORTUNITY'
            WHEN cv_t >= 600 AND sla_bp < 5500 THEN 'VOLATILE AND UNDERSERVED'
            ELSE 'STANDARD' END AS entry_signal
FROM s
ORDER BY cv_t DESC NULLS LAST, {nf('borough, zone, company_name')}
LIMIT 40"""


def _borough_vol(binding: str, where: str, extra: str) -> str:
    return f"""{enriched_ctes(binding)},
g AS (
    SELECT pu_borough AS borough, company_name, COUNT(*) AS total_trips,
           {AVG_FARE_C} AS avg_fare_c, {SLA_BP} AS sla_bp, {WAIT_C} AS wait_c, {MOMENTS}
    FROM v WHERE {where}
    GROUP BY pu_borough, company_name
),
s AS (SELECT *, {STDDEV_C} AS sd_c, {CV_T} AS cv_t FROM g)"""


def p9b(binding: str) -> str:
    return f"""{_borough_vol(binding, 'pu_borough IS NOT NULL', '')}
SELECT 'Borough Volatility' AS section, borough, company_name, total_trips,
       {dbl('avg_fare_c', 2)} AS avg_fare, {dbl('sd_c', 2)} AS fare_stddev,
       {dbl('cv_t', 1)} AS coeff_of_variation_pct, {dbl('sla_bp', 2)} AS sla_pct
FROM s ORDER BY cv_t DESC NULLS LAST, {nf('borough, company_name')}"""


def p9c(binding: str) -> str:
    return f"""{_borough_vol(binding, "time_of_day = 'Late Night' AND pu_borough IS NOT NULL", '')}
SELECT 'Late Night Volatility' AS section, borough, company_name, total_trips,
       {dbl('avg_fare_c', 2)} AS avg_fare, {dbl('sd_c', 2)} AS fare_stddev,
       {dbl('cv_t', 1)} AS coeff_of_variation_pct, {dbl('sla_bp', 2)} AS sla_pct,
       {dbl('wait_c', 2)} AS avg_wait_min
FROM s ORDER BY sla_bp NULLS FIRST, {nf('borough, company_name')}"""


# --- P10 --------------------------------------------------------------------


def _minmax(x: str, inverted: bool = False) -> str:
    lo, hi = f"MIN({x}) OVER ()", f"MAX({x}) OVER ()"
    num = f"({hi} - {x})" if inverted else f"({x} - {lo})"
    return rdiv(f"{num} * 1000", f"{hi} - {lo}")


def p10a(binding: str) -> str:
    return f"""{enriched_ctes(binding)},
zm AS (
    SELECT pu_borough AS borough, pu_zone AS zone, COUNT(*) AS total_trips,
           {AVG_FARE_C} AS fare_avg_c, {_avg('total_c')} AS total_avg_c, {TAKE_BP} AS take_bp_g,
           {SLA_BP} AS sla_bp, {WAIT_C} AS wait_c, {VIOL_BP} AS viol_bp,
           SUM(CASE WHEN wav_request_flag = 'Y' THEN 1 ELSE 0 END) AS wav_requests,
           SUM(CASE WHEN wav_match_flag = 'Y' THEN 1 ELSE 0 END) AS wav_matches
    FROM v WHERE pu_zone IS NOT NULL AND below IS NOT NULL
    GROUP BY pu_borough, pu_zone HAVING COUNT(*) >= 50
),
nz AS (
    SELECT *, {_minmax('total_trips')} AS vol_t, {_minmax('fare_avg_c')} AS fare_t,
           {_minmax('sla_bp', True)} AS sla_t, {_minmax('wait_c')} AS wait_t
    FROM zm
),
sc AS (SELECT *, {rdiv('30 * vol_t + 25 * fare_t + 30 * sla_t + 15 * wait_t', '100')} AS opp_t FROM nz)
SELECT 'Opportunity Matrix' AS section, borough, zone, total_trips,
       {dbl('fare_avg_c', 2)} AS avg_base_fare, {dbl('total_avg_c', 2)} AS avg_total_charge,
       {dbl('take_bp_g', 2)} AS avg_take_rate_pct, {dbl('sla_bp', 2)} AS sla_pct,
       {dbl('wait_c', 2)} AS avg_wait_min, {dbl('viol_bp', 2)} AS violation_pct,
       {dbl('vol_t', 1)} AS volume_score, {dbl('fare_t', 1)} AS fare_score,
       {dbl('sla_t', 1)} AS sla_gap_score, {dbl('wait_t', 1)} AS wait_gap_score,
       {dbl('opp_t', 1)} AS opportunity_score,
       CAST(RANK() OVER (ORDER BY opp_t DESC NULLS LAST) AS BIGINT) AS opportunity_rank,
       CASE WHEN opp_t >= 600 THEN 'STRONG ENTRY TARGET' WHEN opp_t >= 400 THEN 'MONITOR'
            ELSE 'INCUMBENT DEFENDED' END AS entry_recommendation,
       CASE WHEN wav_requests > 0 AND wav_matches = 0 THEN 'WAV DEMAND UNMET'
            WHEN wav_requests = 0 THEN 'WAV SUPPRESSED' ELSE 'WAV SERVED' END AS wav_status
FROM sc ORDER BY opp_t DESC NULLS LAST, {nf('borough, zone')}
LIMIT 30"""


def p10b(binding: str) -> str:
    req = "SUM(CASE WHEN wav_request_flag = 'Y' THEN 1 ELSE 0 END)"
    mat = "SUM(CASE WHEN wav_match_flag = 'Y' THEN 1 ELSE 0 END)"
    return f"""{enriched_ctes(binding)}
SELECT 'WAV Gap Analysis' AS section, pu_borough AS borough, COUNT(*) AS total_trips,
       CAST({req} AS BIGINT) AS wav_requests, CAST({mat} AS BIGINT) AS wav_matches,
       {dbl(rdiv(f'{req} * 100000', 'COUNT(*)'), 3)} AS wav_request_rate_pct,
       CASE WHEN {req} = 0 THEN 'SUPPRESSED DEMAND -- accessibility gap likely'
            WHEN {mat} = 0 THEN 'REQUESTS UNMET -- fulfillment failure'
            ELSE 'PARTIALLY SERVED' END AS wav_interpretation
FROM v WHERE pu_borough IS NOT NULL
GROUP BY pu_borough ORDER BY wav_requests DESC, borough NULLS FIRST"""


# --- P11 --------------------------------------------------------------------


def _segments(binding: str) -> str:
    return f"""{enriched_ctes(binding)},
sb AS (
    SELECT company_name, pu_borough AS borough, time_of_day, COUNT(*) AS total_trips,
           {AVG_FARE_C} AS fare_avg_c, {TAKE_BP} AS take_bp_g, {NEG_BP} AS neg_bp, {SLA_BP} AS sla_bp,
           {WAIT_C} AS wait_c, {VIOL_BP} AS viol_bp, {_avg('pph_c')} AS pph_avg_c, {MOMENTS}
    FROM v WHERE pu_borough IS NOT NULL AND below IS NOT NULL
    GROUP BY company_name, pu_borough, time_of_day HAVING COUNT(*) >= 30
),
sv AS (SELECT *, {CV_T} AS cv_t FROM sb),
sc AS (
    SELECT *,
           CASE WHEN take_bp_g >= 2000 AND neg_bp < 500 THEN 25
                WHEN take_bp_g >= 1500 AND neg_bp < 1000 THEN 20
                WHEN take_bp_g >= 1000 AND neg_bp < 1500 THEN 15
                WHEN take_bp_g >= 500 THEN 10
                WHEN take_bp_g >= 0 THEN 5 ELSE 0 END AS margin_score,
           CASE WHEN sla_bp >= 6500 AND wait_c <= 450 THEN 25
                WHEN sla_bp >= 6000 AND wait_c <= 500 THEN 20
                WHEN sla_bp >= 5500 AND wait_c <= 550 THEN 15
                WHEN sla_bp >= 5000 THEN 10
                WHEN sla_bp >= 4000 THEN 5 ELSE 0 END AS service_score,
           CASE WHEN viol_bp = 0 THEN 25 WHEN viol_bp < 25 THEN 20 WHEN viol_bp < 50 THEN 15
                WHEN viol_bp < 100 THEN 10 WHEN viol_bp < 200 THEN 5 ELSE 0 END AS compliance_score,
           CASE WHEN cv_t < 300 THEN 25 WHEN cv_t < 450 THEN 20 WHEN cv_t < 600 THEN 15
                WHEN cv_t < 750 THEN 10 ELSE 5 END AS stability_score
    FROM sv
),
fs AS (
    SELECT *, margin_score + service_score + compliance_score + stability_score AS gq
    FROM sc
)"""


def p11a(binding: str) -> str:
    return f"""{_segments(binding)}
SELECT 'Growth Quality Score' AS section, company_name, borough, time_of_day, total_trips,
       {dbl('fare_avg_c', 2)} AS avg_base_fare, {dbl('take_bp_g', 2)} AS avg_take_rate_pct,
       {dbl('neg_bp', 2)} AS negative_take_rate_pct, {dbl('sla_bp', 2)} AS sla_pct,
       {dbl('wait_c', 2)} AS avg_wait_min, {dbl('viol_bp', 2)} AS violation_pct,
       {dbl('cv_t', 1)} AS price_volatility_pct, {dbl('pph_avg_c', 2)} AS avg_driver_hourly,
       CAST(margin_score AS BIGINT) AS margin_score, CAST(service_score AS BIGINT) AS service_score,
       CAST(compliance_score AS BIGINT) AS compliance_score, CAST(stability_score AS BIGINT) AS stability_score,
       CAST(gq AS BIGINT) AS growth_quality_score,
       CAST(RANK() OVER (ORDER BY gq DESC) AS BIGINT) AS quality_rank,
       CAST(RANK() OVER (PARTITION BY company_name ORDER BY gq DESC) AS BIGINT) AS quality_rank_within_platform,
       CASE WHEN gq >= 80 THEN 'SUSTAINABLE' WHEN gq >= 60 THEN 'SOLID' WHEN gq >= 40 THEN 'FRAGILE'
            ELSE 'VULNERABLE' END AS strategic_verdict
FROM fs ORDER BY gq DESC, {nf('company_name, borough, time_of_day')}"""


def p11b(binding: str) -> str:
    def avg1(col: str) -> str:
        return dbl(rdiv(f"SUM({col}) * 10", "COUNT(*)"), 1)

    return f"""{_segments(binding)}
SELECT 'Platform Quality Summary' AS section, company_name,
       {avg1('gq')} AS avg_quality_score, {avg1('margin_score')} AS avg_margin_score,
       {avg1('service_score')} AS avg_service_score, {avg1('compliance_score')} AS avg_compliance_score,
       {avg1('stability_score')} AS avg_stability_score,
       COUNT(CASE WHEN gq >= 80 THEN 1 END) AS sustainable_segments,
       COUNT(CASE WHEN gq < 40 THEN 1 END) AS vulnerable_segments,
       COUNT(*) AS total_segments
FROM fs GROUP BY company_name ORDER BY avg_quality_score DESC, company_name"""


ORACLE_SQL: dict[str, str] = {
    "p0_enriched_orders": p0("orders"),
    "p0_enriched_events": p0("events"),
    "p1_market_position": p1("orders"),
    "p2a_borough_demand": p2a("orders"),
    "p2b_borough_time_demand": p2b("events"),
    "p3a_top_corridors": p3a("orders"),
    "p3b_airport_segment": p3b("orders"),
    "p3c_borough_matrix": p3c("orders"),
    "p4_fare_decile_margin": p4("orders"),
    "p4_fare_decile_margin_events": p4("events"),
    "w3_fare_decile_orders": w3("orders"),
    "w3_fare_decile_events": w3("events"),
    "p5a_price_decomposition": p5a("orders"),
    "p5b_borough_fee_burden": p5b("orders"),
    "p5c_airport_fee_structure": p5c("orders"),
    "p6a_pay_compliance_platform": p6a("orders"),
    "p6b_pay_compliance_borough": p6b("orders"),
    "p6c_pay_compliance_time": p6c("events"),
    "p6d_pay_compliance_distance": p6d("orders"),
    "p6d_pay_compliance_distance_events": p6d("events"),
    "p7a_congestion_by_borough": p7a("orders"),
    "p7b_congestion_by_distance": p7b("orders"),
    "p7b_congestion_by_distance_events": p7b("events"),
    "p7c_cbd_zone_footprint": p7c("orders"),
    "p8a_daily_revenue_trend": p8a("events"),
    "p8b_peak_vs_trough": p8b("events"),
    "p9a_zone_volatility": p9a("orders"),
    "p9b_borough_volatility": p9b("orders"),
    "p9c_late_night_volatility": p9c("events"),
    "p10a_zone_opportunity": p10a("orders"),
    "p10b_wav_gap": p10b("orders"),
    "p11a_growth_quality": p11a("events"),
    "p11b_platform_quality": p11b("events"),
    "p2a_borough_demand_mixed": p2a("mixed"),
    "p2b_borough_time_demand_mixed": p2b("mixed"),
    "p3a_top_corridors_mixed": p3a("mixed"),
    "p3c_borough_matrix_mixed": p3c("mixed"),
    "p4_fare_decile_margin_mixed": p4("mixed"),
    "p6b_pay_compliance_borough_mixed": p6b("mixed"),
    "p7a_congestion_by_borough_mixed": p7a("mixed"),
    "p7c_cbd_zone_footprint_mixed": p7c("mixed"),
    "p9a_zone_volatility_mixed": p9a("mixed"),
    "p10a_zone_opportunity_mixed": p10a("mixed"),
    "p10b_wav_gap_mixed": p10b("mixed"),
    "p11a_growth_quality_mixed": p11a("mixed"),
    "p11b_platform_quality_mixed": p11b("mixed"),
}
