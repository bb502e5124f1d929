"""Every registered query against its independent DuckDB statement at sf0.01."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from conftest import SF01

import __spark_entry__ as E
from farelens.registry import QUERIES as REPORTS

TABLES = "region nation customer supplier part orders lineitem events".split()
# Every report has SQL; the optional operators have none and are tested against brute force.
QUERIES = {k: q for k, q in E.queries().items() if k in REPORTS}
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


#: Reports without an order of their own; all others are compared row by row in order (T1-T4, FIELD).
UNORDERED = ("p0_", "w3_")


def _rows(pdf, ordered=False):
    cols = sorted(pdf.columns)

    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return v.item() if hasattr(v, "item") else v

    rows = [tuple(norm(v) for v in rec) for rec in pdf[cols].itertuples(index=False, name=None)]
    return cols, rows if ordered else sorted(rows, key=repr)


def test_every_query_has_oracle():
    assert set(QUERIES) == set(REPORTS) <= set(SQL)


@pytest.mark.skipif(not os.path.isdir(SF01), reason="benchmark tables not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, con, name):
    ordered = not name.startswith(UNORDERED)
    s_cols, s_rows = _rows(QUERIES[name](spark, SF01).toPandas(), ordered)
    d_cols, d_rows = _rows(con.execute(SQL[name]).df(), ordered)
    assert s_cols == d_cols
    assert len(s_rows) == len(d_rows)
    assert s_rows == d_rows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "opportunity_score" in df.columns


@pytest.mark.skipif(not os.path.isdir(SF01), reason="benchmark tables not present")
@pytest.mark.parametrize("name", ["p0_enriched_events", "p8a_daily_revenue_trend", "p4_fare_decile_margin"])
def test_results_do_not_depend_on_session_settings(spark, con, name):
    """The driver's session may use another time zone or ANSI mode."""
    saved = {k: spark.conf.get(k) for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled")}
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        assert _rows(QUERIES[name](spark, SF01).toPandas()) == _rows(con.execute(SQL[name]).df())
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
