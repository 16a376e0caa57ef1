"""Registered queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def cell(v):
    return f"{float(v):.5f}" if isinstance(v, float) and not math.isnan(v) else str(v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["k02_first_touch", "k14_ida_weights", "c01_conditional_cpt", "i01_batch_inference", "e02_event_windows", "t08_multiple_testing", "r08_trade_metrics", "j01_inner_chain", "w08_rolling_mean", "g06_conditional_pivot"])
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = registry.queries()[name](spark, DATA)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(cell(r[c]) for c in want.columns) for r in got.collect())
    assert rows == sorted(tuple(map(cell, r)) for r in want.fetchall())
