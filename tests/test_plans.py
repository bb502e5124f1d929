"""Physical-plan checks: pruning, pushdown, join elimination, no Python, no
single-partition step before the first aggregation."""

from __future__ import annotations

import pytest
from conftest import SF001, trip, trips_df

from farelens.operators.enrich import enrich
from farelens.params import Params
from farelens.plans import REPORTS
from farelens.registry import run_query
from farelens.sources.trips import read_trips

P = Params()


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def native(spark, zones, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("trips") / "trips.parquet")
    trips_df(spark, [trip(i, PULocationID=1 + i % 2) for i in range(40)]).write.parquet(path)
    return enrich(read_trips(spark, path), zones, P)


def test_platform_only_report_drops_zone_joins(native):
    plan = plan_text(REPORTS["market_position"](native, P))
    assert "Join" not in plan
    assert "PushedFilters" in plan or "In(hvfhs_license_num" in plan


def test_pickup_report_keeps_one_join(native):
    plan = plan_text(REPORTS["borough_demand"](native, P))
    assert plan.count("Join") == 1


def test_scan_is_pruned_and_filtered(native):
    df = REPORTS["market_position"](native, P)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "pu_borough" not in text
    formatted = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "In(hvfhs_license_num, [HV0003,HV0005])" in formatted
    assert "ReadSchema" in formatted and "shared_match_flag" not in formatted.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_no_python_udf(native, name):
    df = REPORTS[name](native, P) if name != "fare_deciles_report" else REPORTS[name](native, P)
    plan = plan_text(df)
    assert "EvalPython" not in plan and "PythonUDF" not in plan


def _single_partition_before_aggregate(plan: str) -> bool:
    """True when some SinglePartition exchange has no aggregate / top-k below it."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line and "Exchange" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            below = []
            for nxt in lines[i + 1 :]:
                d = len(nxt) - len(nxt.lstrip(" :+-"))
                if d <= depth:
                    break
                below.append(nxt)
            if not any(("HashAggregate" in b or "SortAggregate" in b or "TakeOrdered" in b) for b in below):
                return True
    return False


@pytest.mark.parametrize(
    "query", ["p1_market_position", "p10a_zone_opportunity", "p11a_growth_quality", "p4_fare_decile_margin"]
)
def test_global_windows_only_after_grouping(spark, query):
    plan = run_query(spark, query, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not _single_partition_before_aggregate(plan)


def test_ntile_never_windows_a_whole_platform(spark):
    plan = run_query(spark, "w3_fare_decile_orders", SF001)._jdf.queryExecution().executedPlan().toString()
    # The only trip-level window is keyed by (platform, fare), over straddling rows.
    for line in plan.splitlines():
        if "Window [" in line and "row_number" in line:
            assert "base_passenger_fare" in line.split("[")[-2] or "base_passenger_fare" in line
