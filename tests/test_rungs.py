"""The mixed binding's rows: every ladder shows its rungs and every report filter has something to drop."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SF01

from oracle import ORACLE_SQL


@pytest.fixture(scope="module")
def rows():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF01}/{t}.parquet'")
    return lambda key, cut=None: con.execute(cut(ORACLE_SQL[key]) if cut else ORACLE_SQL[key]).df()


@pytest.mark.parametrize(
    "key, column, rungs",
    [
        ("p2b_borough_time_demand_mixed", "service_status", 3),  # C1
        ("p4_fare_decile_margin_mixed", "margin_health", 4),  # C3
        ("p6b_pay_compliance_borough_mixed", "compliance_status", 4),  # C4
        ("p7a_congestion_by_borough_mixed", "equity_status", 3),  # C7
        ("p9a_zone_volatility_mixed", "volatility_class", 3),  # C9
        ("p9a_zone_volatility_mixed", "entry_signal", 3),  # C10
        ("p10a_zone_opportunity_mixed", "entry_recommendation", 3),  # C11
        ("p10a_zone_opportunity_mixed", "wav_status", 3),  # C12
        ("p10b_wav_gap_mixed", "wav_interpretation", 3),  # C13
        ("p11a_growth_quality_mixed", "margin_score", 6),  # C14
        ("p11a_growth_quality_mixed", "service_score", 6),  # C15
        ("p11a_growth_quality_mixed", "compliance_score", 3),  # C16
        ("p11a_growth_quality_mixed", "stability_score", 5),  # C17
        ("p11a_growth_quality_mixed", "strategic_verdict", 4),  # C18
    ],
)
def test_ladders_show_their_rungs(rows, key, column, rungs):
    assert rows(key)[column].nunique() >= rungs


@pytest.mark.parametrize(
    "key, filters",
    [
        ("p2a_borough_demand_mixed", ["WHERE pu_borough IS NOT NULL"]),  # F5
        ("p3c_borough_matrix_mixed", ["do_borough IS NOT NULL"]),  # F6
        ("p9a_zone_volatility_mixed", ["pu_zone IS NOT NULL", "COUNT(*) >= 30"]),  # F7, F11
        ("p4_fare_decile_margin_mixed", ["take_bp IS NOT NULL"]),  # F8
        ("p3a_top_corridors_mixed", ["pu_borough IS NOT NULL", "do_borough IS NOT NULL", "COUNT(*) >= 50"]),  # F6, F11
        ("p10a_zone_opportunity_mixed", ["COUNT(*) >= 50"]),  # F11
        ("p7c_cbd_zone_footprint_mixed", ["SUM(cbd_c0) > 0"]),  # F12
    ],
)
def test_filters_have_rows_to_drop(rows, key, filters):
    """Without the filter the oracle's own result differs, so the comparison with Spark tests it."""
    whole = rows(key)
    for text in filters:
        assert ORACLE_SQL[key].count(text) >= 1, text
        without = rows(key, lambda sql, text=text: sql.replace(text, text.replace(text.removeprefix("WHERE "), "TRUE")))
        assert not whole.equals(without), text
