
import inspect

import duckdb
from tidemark.operators import stats
from tidemark.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = ("events",)


def test_asymmetric_search(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    got = registry.queries()["m01_asymmetric_search"](spark, DATA)
    want = con.sql(registry.oracle_sql()["m01_asymmetric_search"])
    key = lambda r: tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(key(r) for r in got.select(*want.columns).collect()) == sorted(key(r) for r in want.fetchall())
    assert got.count() == 65 * 65 and got.where("best").count() == 1 and got.where("bull_nb <> bear_nb or bull_st <> bear_st").count() > 4000


def test_stream_inference_uses_each_assets_evidence(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    got = registry.queries()["z04_stream_inference"](spark, DATA).collect()
    assert len(got) == con.sql("SELECT count(DISTINCT event_type) FROM events").fetchall()[0][0] and all(r.expected_atr is not None for r in got)
    assert len({r.expected_atr for r in got}) > 1


def test_bootstrap_draws():
    assert inspect.signature(stats.bootstrap_odds).parameters["draws"].default == 10_000
