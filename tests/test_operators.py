"""Fixtures with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions.formula import FormulaError, compile_formula
from tidemark.operators import backtest, barrier, classify, events, stats, weights
from tidemark.streaming import live


def test_first_touch_path(spark):
    rows = []
    for i in range(60):
        high = 100 - 0.05 * i if i < 10 else 100 + 0.1 * (i - 10) if i < 30 else 102.0
        low = 101.8 if i >= 30 else high - 0.1
        rows.append(("a", i + 1, float(high), float(low + (1e-9 if i == 8 else 0))))
    path = spark.createDataFrame(rows, "asset string, m long, high double, low double")
    anchors = spark.createDataFrame([("a", 0, 100.0, 2.0), ("b", 0, 1.0, 1.0)], "asset string, m long, ref double, atr double")
    found = {r.asset: r for r in barrier.first_touch(anchors, path, (0.25, 0.5, 0.75, 1.0, 1.25), 2880, 1).collect()}
    a = found["a"]
    assert (a.up_025, a.up_050, a.up_075, a.up_100, a.up_125, a.down_050) == (16, 21, 26, 31, None, None)
    assert a.max_up == pytest.approx(1.0) and a.max_up_min == 31 and a.max_down == pytest.approx(-0.275) and a.max_down_min == 10
    assert found["b"].up_025 is None and found["b"].max_up is None


def test_first_significant(spark):
    cols = [f"{s}_{k}" for s in ("up", "down") for k in ("025", "050", "075", "100", "125", "150")]
    cases = [({"up_075": 20, "up_100": 40, "down_075": 30}, "up_075", 20), ({"up_075": 30, "down_075": 15}, "down_075", 15), ({}, "none", None), ({"up_075": 30, "down_075": 30}, "up_075", 30)]
    rows = [tuple(c.get(k) for k in cols) for c, _, _ in cases]
    name, minute = barrier.first_significant()
    got = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols)).select(name.alias("n"), minute.alias("m")).collect()
    assert [(r.n, r.m) for r in got] == [(n, m) for _, n, m in cases]


def test_ida_weights(spark):
    rows = [("a", i, "up_075", 100, s) for i, s in enumerate((0.10, 0.30, 0.25, 0.60))]
    df = spark.createDataFrame(rows, "asset string, m long, barrier string, hit int, score double")
    got = [r.ida for r in weights.ida_weights(df).orderBy("m").collect()]
    assert got == pytest.approx([0.041096, 0.315068, 0.082192, 0.561644], abs=1e-6)


def test_multiple_testing(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate((0.01, 0.04, 0.03, 0.005, 0.20))], "g int, k int, p double")
    got = stats.adjusted(df, "p", ["g"], "k").orderBy("k").collect()
    assert [r.bh for r in got] == pytest.approx([0.025, 0.05, 0.05, 0.025, 0.2])
    assert [r.by_ for r in got] == pytest.approx([0.057083, 0.114167, 0.114167, 0.057083, 0.456667], abs=1e-6)
    assert [r.bonferroni for r in got] == pytest.approx([0.05, 0.2, 0.15, 0.025, 1])
    assert [r.holm for r in got] == pytest.approx([0.04, 0.09, 0.09, 0.025, 0.2])


def test_table_statistics(spark):
    r = stats.table_statistics(spark.createDataFrame([(30.0, 20.0, 70.0, 180.0)], "a double, b double, c double, d double")).first()
    assert (r.odds_ratio, r.ci_low, r.ci_high) == pytest.approx((3.809203, 2.041396, 7.107892), abs=1e-5)
    assert (r.mcc, r.info_gain, r.chi2, r.cramers_v) == pytest.approx((0.252982, 0.043595, 17.787, 0.243495), abs=1e-3)


def test_regimes(spark):
    cases = {(2, 1): "sync_strong_bullish", (1, 1): "sync_bullish", (1, -1): "bullish_retracing", (1, 0): "bullish_consolidating", (0, 1): "bullish_emerging", (0, 0): "macro_ranging", (0, -1): "bearish_emerging", (-1, 0): "bearish_consolidating", (-1, 1): "bearish_retracing", (-1, -1): "sync_bearish", (-2, -1): "sync_strong_bearish", (None, 1): "macro_ranging"}
    got = spark.createDataFrame(list(cases), "d int, q int").select(classify.regime(F.col("d"), F.col("q")).alias("r")).collect()
    assert [r.r for r in got] == list(cases.values())


def test_concordance(spark):
    r = spark.createDataFrame([(2, 1, 0, -1)], "a int, b int, c int, d int").select(classify.concordance_score(*map(F.col, "abcd")).alias("x"), classify.concordance_score(*map(F.col, "abc")).alias("y")).first()
    assert (r.x, r.y) == pytest.approx((0.7875, 0.875))


def test_formula(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate((1, 3, 2, 5))], "asset string, h int, x double")
    got = df.select("h", compile_formula("x > x.shift(1) and max(x, 2) - 1 >= 2").alias("s"), compile_formula("x.rolling(3).mean()").alias("m")).orderBy("h").collect()
    assert [bool(r.s) for r in got] == [False, True, False, True] and got[1].m is None and got[2].m == 2.0
    with pytest.raises(FormulaError):
        compile_formula("__import__('os')")


def test_event_windows(spark):
    rows = [("a", 0, 0.5, "none"), ("a", 60, 0.5, "up_075"), ("a", 90, 0.5, "none"), ("a", 120, 0.5, "none"), ("a", 400, 0.0, "down_075")]
    got = events.detect_events(spark.createDataFrame(rows, "asset string, m long, score double, barrier string")).collect()
    assert [(r.start_m, r.end_m, r.outcome) for r in got] == [(0, 60, "up_075"), (120, 400, "down_075")]


def test_walk_forward_bounds(spark):
    got = backtest.walk_forward(spark, 0, 100, 50, 20).collect()
    assert [(r.train_start, r.train_end, r.test_end) for r in got] == [(0, 50, 70), (20, 70, 90)]


def test_upsert_and_stream(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0)], "asset string, t int, v double")
    new = spark.createDataFrame([("a", 1, 2.0), ("c", 0, 3.0)], "asset string, t int, v double")
    assert {(r.asset, r.v) for r in live.upsert(new, old, ["asset"], "t").collect()} == {("a", 2.0), ("b", 1.0), ("c", 3.0)}
    for i in range(3):
        (tmp_path / f"in{i}.json").write_text("".join(f'{{"asset": "a", "ts": "2024-01-01T0{i}:{m:02d}:00Z", "value": {i}.5}}\n' for m in (5, 25)))
    stream = live.bars_stream(live.payload_stream(spark, f"file://{tmp_path}/*.json"))
    live.run_available(stream, None, str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.n for r in got) == [2, 2]  # the last hour is still open
