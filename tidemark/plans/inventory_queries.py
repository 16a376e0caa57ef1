"""Queries of scalar functions, grouped checks, gates and configuration tables; with DuckDB SQL written apart."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import evidence
from tidemark.sources import config, io, market

from .market_queries import CPT_SQL, INFER_SQL, MIDPOINTS, STATES, TRAIN_SQL, composites, prediction_cpt, predictions, query, rounded, training

EPOCH = "CAST(floor(epoch(ts)) AS BIGINT)"


def events(spark, sf_dir: str) -> DataFrame:
    since = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumns({"ntz": F.col("ts").cast("timestamp_ntz"), "micros": since})


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ntz) -> "F.Column":
    """Whole seconds since 1970 of a time without zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ntz) / 1_000_000)


# Scalar functions


@query("f08_content_hash", "SELECT c_custkey, md5(c_mktsegment || '|' || c_nationkey || '|' || c_custkey) AS version FROM customer")
def f08(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.md5(F.concat_ws("|", "c_mktsegment", "c_nationkey", "c_custkey")).alias("version"))


@query("f10_add_minutes", "SELECT event_id, CAST(floor(epoch(ts + to_minutes(CAST(event_id % 90 AS INTEGER)))) AS BIGINT) AS later FROM events")
def f10(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", epoch(F.col("ntz") + F.make_dt_interval(mins=(F.col("event_id") % 90).cast("int"))).alias("later"))


@query("f11_minutes_between", "SELECT user_id, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000) AS BIGINT) AS minutes FROM events GROUP BY user_id")
def f11(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id").agg(F.min("micros").alias("a"), F.max("micros").alias("b"))
    return e.select("user_id", F.floor((F.col("b") - F.col("a")) / 60_000_000).alias("minutes"))


@query("f15_utc_normalization", f"SELECT event_id, {EPOCH} - 7200 AS utc FROM events")
def f15(spark, sf_dir):
    """Local times at +02:00 as UTC."""
    return events(spark, sf_dir).select("event_id", (epoch(F.col("ntz") - F.make_dt_interval(hours=F.lit(2)))).alias("utc"))


@query("f16_bar_close", f"SELECT event_id, frame, {EPOCH} // len * len + len AS closes FROM (SELECT event_id, ts, ['1m', '1h', '4h', 'D'][event_id % 4 + 1] AS frame, [60, 3600, 14400, 86400][event_id % 4 + 1] AS len FROM events)")
def f16(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("frame", F.element_at(F.array(*map(F.lit, ("1m", "1h", "4h", "D"))), (F.col("event_id") % 4 + 1).cast("int")))
    length = F.when(F.col("frame") == "1m", 60).when(F.col("frame") == "1h", 3600).when(F.col("frame") == "4h", 14400).otherwise(86400)
    return e.select("event_id", "frame", (F.floor(F.col("micros") / 1_000_000 / length) * length + length).alias("closes"))


@query("f27_entropy_confidence", INFER_SQL + ", t AS (SELECT asset, h, unnest([p_up_strong + p_up_weak, p_neutral, p_down_weak + p_down_strong]) AS p FROM pred) SELECT asset, h, round(1 + sum(p * log2(p)) / log2(3), 6) AS confidence FROM t GROUP BY asset, h")
def f27(spark, sf_dir):
    p = predictions(spark, sf_dir)
    three = (p["p_up_strong"] + p["p_up_weak"], p["p_neutral"], p["p_down_weak"] + p["p_down_strong"])
    return rounded(p.select("asset", "h", (1 + reduce(lambda a, b: a + b, (x * F.log2(x) for x in three)) / math.log2(3)).alias("confidence")))


@query("f30_state_map", CPT_SQL + " SELECT regime, hypothesis, CAST(count(*) AS INTEGER) AS n_states, round(max(CASE WHEN state = 'neutral' THEN prob END), 6) AS neutral, round(coalesce(max(CASE WHEN state = 'sideways' THEN prob END), 0.0), 6) AS unknown FROM c GROUP BY regime, hypothesis")
def f30(spark, sf_dir):
    maps = prediction_cpt(training(spark, sf_dir)).groupBy("regime", "hypothesis").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("state", "prob")))).alias("m"))
    return rounded(maps.select("regime", "hypothesis", F.size("m").alias("n_states"), F.try_element_at("m", F.lit("neutral")).alias("neutral"), F.coalesce(F.try_element_at("m", F.lit("sideways")), F.lit(0.0)).alias("unknown")))


@query("f33_json_field", "SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k FROM events")
def f33(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("f34_json_build", "SELECT o_orderkey, '{\"key\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' AS doc FROM orders")
def f34(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))).alias("doc"))


@query("f35_array_contains", "SELECT c_nationkey, bool_or(c_mktsegment = 'BUILDING') AS has_building, CAST(count(DISTINCT c_mktsegment) AS INTEGER) AS n FROM customer GROUP BY c_nationkey")
def f35(spark, sf_dir):
    sets = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("s"))
    return sets.select("c_nationkey", F.array_contains("s", "BUILDING").alias("has_building"), F.size("s").alias("n"))


# Projections, predicates, joins


@query("b01_dynamic_select", "WITH " + market.SIGNALS_SQL.strip() + " SELECT asset, h, trend_fast AS trend_fast_60, jump AS jump_60 FROM sig")
def b01(spark, sf_dir):
    return config.dynamic_select(market.signals(spark, sf_dir), ["trend_fast", "jump", "not_there"], "_60")


@query("b05_look_back", "WITH " + market.BARS_SQL.strip() + " SELECT asset, h, close FROM bars WHERE h >= (SELECT max(h) FROM bars) - 72")
def b05(spark, sf_dir):
    b = market.hourly_bars(market.minutes(spark, sf_dir))
    return b.crossJoin(F.broadcast(b.agg(F.max("h").alias("now")))).where("h >= now - 72").select("asset", "h", "close")


@query("b10_leakage_guard", "SELECT unnest(['barrier', 'hit', 'max_up', 'state']) AS col")
def b10(spark, sf_dir):
    """Columns of the training rows that a feature query must not read."""
    return spark.createDataFrame([(c,) for c in config.leakage(training(spark, sf_dir))], "col string")


@query("a24_column_discovery", "SELECT unnest(['confirming', 'coincident', 'leading']) AS col")
def a24(spark, sf_dir):
    have = composites(spark, sf_dir).columns
    return spark.createDataFrame([(c,) for c in ("leading", "coincident", "confirming", "absent") if c in have], "col string")


@query("j06_anchor_join", "WITH " + market.BARS_SQL.strip() + ", dly AS (SELECT asset, h // 24 AS d, max(high) - min(low) AS span FROM bars GROUP BY ALL) SELECT b.asset, b.h, round(dly.span, 6) AS day_before FROM bars b JOIN dly ON dly.asset = b.asset AND dly.d = b.h // 24 - 1")
def j06(spark, sf_dir):
    """Hours meet the day before them through a precomputed day number."""
    b = market.hourly_bars(market.minutes(spark, sf_dir)).withColumn("d", F.floor(F.col("h") / 24))
    days = b.groupBy("asset", "d").agg((F.max("high") - F.min("low")).alias("day_before")).withColumn("d", F.col("d") + 1)
    return rounded(b.join(days, ["asset", "d"]).select("asset", "h", "day_before"))


# Groups


@query("g16_combination_counts", TRAIN_SQL + ", g AS (SELECT a.i * 25 + b.i * 5 + c.i AS combo, a.s AS ls, b.s AS cs, c.s AS fs FROM (VALUES ('strong_bearish', 0), ('bearish', 1), ('neutral', 2), ('bullish', 3), ('strong_bullish', 4)) a(s, i) CROSS JOIN (VALUES ('strong_bearish', 0), ('bearish', 1), ('neutral', 2), ('bullish', 3), ('strong_bullish', 4)) b(s, i) CROSS JOIN (VALUES ('strong_bearish', 0), ('bearish', 1), ('neutral', 2), ('bullish', 3), ('strong_bullish', 4)) c(s, i)) SELECT CAST(combo AS INTEGER) AS combo, count(t.ls) AS n FROM g LEFT JOIN trn t USING (ls, cs, fs) GROUP BY combo")
def g16(spark, sf_dir):
    number = F.lit(0)
    for c in ("leading_state", "coincident_state", "confirming_state"):
        number = number * 5 + F.array_position(F.array(*map(F.lit, ("strong_bearish", "bearish", "neutral", "bullish", "strong_bullish"))), F.col(c)).cast("int") - 1
    n = training(spark, sf_dir).groupBy(number.alias("combo")).agg(F.count("*").alias("n"))
    return spark.range(125).select(F.col("id").cast("int").alias("combo")).join(F.broadcast(n), "combo", "left").select("combo", F.coalesce("n", F.lit(0)).alias("n"))


@query("g15_single_horizon", TRAIN_SQL + " SELECT asset, ls AS leading_state, count(*) FILTER (hit <= 60 AND state LIKE 'up%') AS hits, count(*) FILTER (NOT coalesce(hit <= 60 AND state LIKE 'up%', FALSE)) AS misses FROM trn GROUP BY asset, ls")
def g15(spark, sf_dir):
    won = F.coalesce((F.col("hit") <= 60) & F.col("state").startswith("up"), F.lit(False))
    return training(spark, sf_dir).groupBy("asset", "leading_state").agg(F.count_if(won).alias("hits"), F.count_if(~won).alias("misses"))


@query("g22_pivot_mean", TRAIN_SQL + " SELECT regime, " + ", ".join(f"round(avg(CASE WHEN state = '{s}' THEN leading END), 6) + 0e0 AS {s}" for s in STATES) + " FROM trn GROUP BY regime")
def g22(spark, sf_dir):
    wide = training(spark, sf_dir).groupBy("regime").pivot("state", STATES).agg(F.round(F.avg("leading"), 6))
    return wide.select("regime", *((F.col(s) + 0.0).alias(s) for s in STATES))


@query("g28_return_by_outcome", TRAIN_SQL + ", r AS (SELECT state, (lead(close, 4) OVER (PARTITION BY asset ORDER BY h) - close) / atr AS x FROM trn) SELECT state, count(x) AS n, round(avg(x), 6) AS mean_atr FROM r GROUP BY state")
def g28(spark, sf_dir):
    after = F.lead("close", 4).over(Window.partitionBy("asset").orderBy("h"))
    r = training(spark, sf_dir).select("state", ((after - F.col("close")) / F.col("atr")).alias("x"))
    return rounded(r.groupBy("state").agg(F.count("x").alias("n"), F.avg("x").alias("mean_atr")))


# Statistics

CLASSES = {k: c for k, (c, _, _) in market.SIGNALS.items()}
FOLD_SQL = "CASE WHEN h >= (SELECT min(h) + (max(h) - min(h)) * 8 // 10 FROM trn) THEN 'oos' WHEN h // 24 % 2 = 1 THEN 'odd' ELSE 'even' END"


@query("t14_signal_alpha", TRAIN_SQL + f""", ln AS (SELECT {FOLD_SQL} AS fold, state AS y, unnest([{", ".join(f"'{k}'" for k in CLASSES)}]) AS signal, unnest([{", ".join("cross_sig" if k == "cross" else k for k in CLASSES)}]) AS x FROM trn),
n AS (SELECT signal, fold, x, y, count(*) AS w FROM ln GROUP BY ALL), q AS (SELECT *, sum(w) OVER (PARTITION BY signal, fold) AS t, sum(w) OVER (PARTITION BY signal, fold, x) AS wx, sum(w) OVER (PARTITION BY signal, fold, y) AS wy FROM n),
mi AS (SELECT signal, fold, greatest(sum(w / t * ln(w * t / (wx * wy))), 0) AS mi FROM q GROUP BY ALL),
wd AS (SELECT signal, CASE {" ".join(f"WHEN signal = '{k}' THEN '{c}'" for k, c in CLASSES.items())} END AS class, coalesce(max(mi) FILTER (fold = 'odd'), 0) AS o, coalesce(max(mi) FILTER (fold = 'even'), 0) AS e, coalesce(max(mi) FILTER (fold = 'oos'), 0) AS s FROM mi GROUP BY signal),
st AS (SELECT *, (o + e) / 2 AS a, greatest(0.1, 1 - abs(o - e) / greatest(o, e, 1e-9)) AS stab FROM wd), md AS (SELECT *, median(a) OVER (PARTITION BY class) AS m FROM st)
SELECT signal, class, round(a, 6) AS mi_avg, round(stab, 6) AS stability, round(s, 6) AS oos_mi, round(CASE WHEN a = 0 THEN 0 ELSE least(2.5, greatest(0, a / CASE WHEN m = 0 THEN 1e-6 ELSE m END * stab)) END, 6) AS weight FROM md""")
def t14(spark, sf_dir):
    t = training(spark, sf_dir)
    ends = t.agg((F.min("h") + F.floor((F.max("h") - F.min("h")) * 8 / 10)).alias("cut"))
    fold = F.when(F.col("h") >= F.col("cut"), "oos").when(F.floor(F.col("h") / 24) % 2 == 1, "odd").otherwise("even")
    found = evidence.signal_alpha(t.crossJoin(F.broadcast(ends)).withColumn("fold", fold), CLASSES, "state", "fold")
    return rounded(found.select("signal", "class", "mi_avg", "stability", "oos_mi", "weight"))


@query("t16_spearman", TRAIN_SQL + ", r AS (SELECT asset, abs(leading) AS x, max_up AS y FROM trn WHERE max_up IS NOT NULL), k AS (SELECT asset, rank() OVER (PARTITION BY asset ORDER BY x) + (count(*) OVER (PARTITION BY asset, x) - 1) / 2e0 AS a, rank() OVER (PARTITION BY asset ORDER BY y) + (count(*) OVER (PARTITION BY asset, y) - 1) / 2e0 AS b FROM r) SELECT asset, round(corr(a, b), 6) AS rho FROM k GROUP BY asset")
def t16(spark, sf_dir):
    t = training(spark, sf_dir).select("asset", F.abs("leading").alias("x"), F.col("max_up").alias("y"))
    return rounded(evidence.spearman(t, "x", "y", ["asset"]))


# Diagnoses and gates

CHECK_SQL = TRAIN_SQL + """, hs AS (SELECT hypothesis, count(*) / (SELECT count(*) FROM trn)::DOUBLE AS s FROM trn GROUP BY 1),
hy AS (SELECT 'no_setup' AS name, coalesce(sum(s) FILTER (hypothesis = 'no_setup'), 0) AS v FROM hs UNION ALL SELECT 'long', coalesce(sum(s) FILTER (hypothesis LIKE '%long'), 0) FROM hs UNION ALL SELECT 'short', coalesce(sum(s) FILTER (hypothesis LIKE '%short'), 0) FROM hs),
hc AS (SELECT 'hypothesis' AS node, name, v, CASE WHEN name = 'no_setup' THEN CASE WHEN v > 0.9 THEN 'FAIL' WHEN v > 0.8 THEN 'WARN' ELSE 'PASS' END ELSE CASE WHEN v < 0.02 THEN 'WARN' ELSE 'PASS' END END AS status FROM hy),
cl AS (SELECT unnest(['leading', 'coincident', 'confirming', 'regime']) AS node, unnest([ls, cs, fs, regime]) AS s FROM trn), cn AS (SELECT node, s, count(*) AS n FROM cl GROUP BY ALL),
cc AS (SELECT node, 'largest_state' AS name, max(n) / sum(n)::DOUBLE AS v, CASE WHEN max(n) / sum(n)::DOUBLE > 0.9 THEN 'FAIL' WHEN count(*) < 3 THEN 'WARN' ELSE 'PASS' END AS status FROM cn GROUP BY node),
ck AS (SELECT * FROM hc UNION ALL SELECT * FROM cc)"""


def node_checks(spark, sf_dir) -> DataFrame:
    """(node, name, v, status): shares of hypotheses, and whether a node is stuck in a state or has few."""
    t = io.staged(training(spark, sf_dir).select("hypothesis", "regime", *(f"{c}_state" for c in ("leading", "coincident", "confirming"))))
    share = lambda test: F.avg(test.cast("double"))
    sides = t.agg(F.array(*(F.struct(F.lit(n).alias("name"), share(x).alias("v")) for n, x in (("no_setup", F.col("hypothesis") == "no_setup"), ("long", F.col("hypothesis").endswith("long")), ("short", F.col("hypothesis").endswith("short"))))).alias("x"))
    sides = sides.select(F.lit("hypothesis").alias("node"), F.inline("x"))
    sides = sides.withColumn("status", F.when(F.col("name") == "no_setup", evidence.graded(F.col("v"), 0.8, 0.9)).otherwise(evidence.graded(F.col("v"), 0.02, -1.0, False)))
    long_ = t.select(F.explode(F.array(*(F.struct(F.lit(n).alias("node"), F.col(c).alias("s")) for n, c in (("leading", "leading_state"), ("coincident", "coincident_state"), ("confirming", "confirming_state"), ("regime", "regime"))))).alias("x")).select("x.*")
    n = long_.groupBy("node", "s").agg(F.count("*").alias("n")).groupBy("node").agg((F.max("n") / F.sum("n")).alias("v"), F.count("*").alias("active"))
    status = F.when(F.col("v") > 0.9, "FAIL").when(F.col("active") < 3, "WARN").otherwise("PASS")
    return sides.unionByName(n.select("node", F.lit("largest_state").alias("name"), "v", status.alias("status")))


@query("y60_composite_diagnosis", CHECK_SQL + " SELECT node, round(v, 6) AS largest, status FROM cc")
def y60(spark, sf_dir):
    return rounded(node_checks(spark, sf_dir).where("name = 'largest_state'").select("node", F.col("v").alias("largest"), "status"))


@query("y61_hypothesis_diagnosis", CHECK_SQL + " SELECT name, round(v, 6) AS share, status FROM hc")
def y61(spark, sf_dir):
    return rounded(node_checks(spark, sf_dir).where("node = 'hypothesis'").select("name", F.col("v").alias("share"), "status"))


@query("v07_node_diagnosis", CHECK_SQL + " SELECT node, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS status FROM ck GROUP BY node")
def v07(spark, sf_dir):
    worst = F.when(F.bool_or(F.col("status") == "FAIL"), "FAIL").when(F.bool_or(F.col("status") == "WARN"), "WARN").otherwise("PASS")
    return node_checks(spark, sf_dir).groupBy("node").agg(worst.alias("status"))


@query("v09_production_readiness", CHECK_SQL + " SELECT count(*) AS n_checks, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'WARN') AS warned, CASE WHEN bool_or(status = 'FAIL') THEN 'NO-GO' ELSE 'GO' END AS verdict FROM ck")
def v09(spark, sf_dir):
    return evidence.verdict(node_checks(spark, sf_dir))


BRIER = " + ".join(f"power(p_{s} - CASE WHEN actual = '{s}' THEN 1 ELSE 0 END, 2)" for s in STATES)


@query("y62_prediction_diagnosis", INFER_SQL + f", m AS (SELECT avg(CASE WHEN actual = predicted THEN 1e0 ELSE 0 END) AS a, avg(({BRIER}) / {len(STATES)}) AS b FROM pred) SELECT 'accuracy' AS name, round(a, 6) AS v, CASE WHEN a < 0.05 THEN 'FAIL' WHEN a < 0.15 THEN 'WARN' ELSE 'PASS' END AS status FROM m UNION ALL SELECT 'brier', round(b, 6), CASE WHEN b > 0.3 THEN 'WARN' ELSE 'PASS' END FROM m")
def y62(spark, sf_dir):
    brier = sum((F.pow(F.col(f"p_{s}") - (F.col("actual") == s).cast("double"), 2) for s in STATES[1:]), F.pow(F.col(f"p_{STATES[0]}") - (F.col("actual") == STATES[0]).cast("double"), 2)) / len(STATES)
    m = predictions(spark, sf_dir).agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("a"), F.avg(brier).alias("b"))
    rows = F.array(F.struct(F.lit("accuracy").alias("name"), F.col("a").alias("v"), evidence.graded(F.col("a"), 0.15, 0.05, False).alias("status")), F.struct(F.lit("brier").alias("name"), F.col("b").alias("v"), evidence.graded(F.col("b"), 0.3, 1e9).alias("status")))
    return rounded(m.select(F.inline(rows)))


@query("v06_directional_alignment", INFER_SQL + ", d AS (SELECT asset, sign(" + " + ".join(f"p_{s} * {v}" for s, v in MIDPOINTS.items()) + ") AS p, CASE WHEN actual LIKE 'up%' THEN 1 WHEN actual LIKE 'down%' THEN -1 ELSE 0 END AS a FROM pred) SELECT asset, count(*) AS n, round(avg(CASE WHEN p = a THEN 1e0 ELSE 0 END), 6) AS aligned FROM d WHERE a <> 0 AND p <> 0 GROUP BY asset")
def v06(spark, sf_dir):
    expected = sum((F.col(f"p_{s}") * v for s, v in list(MIDPOINTS.items())[1:]), F.col("p_up_strong") * MIDPOINTS["up_strong"])
    side = F.when(F.col("actual").startswith("up"), 1).when(F.col("actual").startswith("down"), -1).otherwise(0)
    d = predictions(spark, sf_dir).select("asset", F.signum(expected).alias("p"), side.alias("a")).where("a <> 0 AND p <> 0")
    return rounded(d.groupBy("asset").agg(F.count("*").alias("n"), F.avg((F.col("p") == F.col("a")).cast("double")).alias("aligned")))


@query("y63_entropy_gate", CPT_SQL + ", e AS (SELECT sum(-prob * log2(prob)) AS x FROM c GROUP BY regime, hypothesis) SELECT round(avg(x), 6) AS mean_entropy, avg(x) BETWEEN 0.5 AND 2.5 AS passes FROM e")
def y63(spark, sf_dir):
    e = prediction_cpt(training(spark, sf_dir)).groupBy("regime", "hypothesis").agg(F.sum(-F.col("prob") * F.log2("prob")).alias("x"))
    return rounded(e.agg(F.avg("x").alias("mean_entropy"), F.avg("x").between(0.5, 2.5).alias("passes")))


@query("y64_key_diversity", CPT_SQL + ", k AS (SELECT regime || '|' || hypothesis AS key FROM ks) SELECT count(*) AS n_keys, count(DISTINCT split_part(key, '|', 1)) AS first_parts, count(DISTINCT split_part(key, '|', 2)) AS second_parts, count(*) >= 5 AND count(DISTINCT split_part(key, '|', 1)) + count(DISTINCT split_part(key, '|', 2)) >= 4 AS passes FROM k")
def y64(spark, sf_dir):
    k = training(spark, sf_dir).select(F.split(F.concat_ws("|", "regime", "hypothesis"), r"\|").alias("p")).distinct()
    k = k.agg(F.count("*").alias("n_keys"), F.countDistinct(F.col("p")[0]).alias("first_parts"), F.countDistinct(F.col("p")[1]).alias("second_parts"))
    return k.withColumn("passes", (F.col("n_keys") >= 5) & (F.col("first_parts") + F.col("second_parts") >= 4))


@query("y66_staleness_gate", TRAIN_SQL + ", a AS (SELECT asset, (SELECT max(h) FROM trn) - max(h) AS age FROM trn GROUP BY asset) SELECT asset, CAST(age AS BIGINT) AS age, CASE WHEN age > 24 THEN 'FAIL' WHEN age > 6 THEN 'WARN' ELSE 'PASS' END AS status FROM a")
def y66(spark, sf_dir):
    t = training(spark, sf_dir).groupBy("asset").agg(F.max("h").alias("last"))
    t = t.crossJoin(F.broadcast(t.agg(F.max("last").alias("now")))).select("asset", (F.col("now") - F.col("last")).alias("age"))
    return t.withColumn("status", evidence.graded(F.col("age"), 6, 24))


@query("y46_training_readiness", TRAIN_SQL + ", n AS (SELECT max(h) AS now FROM trn) SELECT asset, hz AS horizon, count(*) FILTER (h + hz / 60 <= now OR hit <= hz) AS eligible, count(*) FILTER (hit <= hz) AS hits FROM trn CROSS JOIN n CROSS JOIN (SELECT unnest([60, 120, 240]) AS hz) GROUP BY asset, hz")
def y46(spark, sf_dir):
    t = training(spark, sf_dir)
    t = t.crossJoin(F.broadcast(t.agg(F.max("h").alias("now")))).withColumn("horizon", F.explode(F.array(F.lit(60), F.lit(120), F.lit(240))))
    hit = F.coalesce(F.col("hit") <= F.col("horizon"), F.lit(False))
    return t.groupBy("asset", "horizon").agg(F.count_if((F.col("h") + F.col("horizon") / 60 <= F.col("now")) | hit).alias("eligible"), F.count_if(hit).alias("hits"))


# Configuration and stored tables


@query("a15_mirrored_thresholds", "SELECT CAST(p_size % 5 AS INTEGER) AS k, 0.05 + p_size % 5 / 100e0 AS neutral, 0.15e0 AS strong, -(0.05 + p_size % 5 / 100e0) AS neutral_down, CASE WHEN p_size % 5 = 2 THEN -0.2e0 ELSE -0.15e0 END AS strong_down FROM part GROUP BY ALL")
def a15(spark, sf_dir):
    """Thresholds given for the upper side only, but for one key."""
    k = table(spark, sf_dir, "part").select((F.col("p_size") % 5).cast("int").alias("k")).distinct()
    rows = k.select("k", F.inline(F.array(F.struct(F.lit("neutral").alias("name"), (0.05 + F.col("k") / 100).alias("value")), F.struct(F.lit("strong").alias("name"), F.lit(0.15).alias("value")), F.struct(F.lit("strong_down").alias("name"), F.when(F.col("k") == 2, -0.2).alias("value"))))).where("value is not null")
    return config.mirrored_thresholds(rows, ["k"])


@query("a14_config_overrides", "SELECT c_custkey AS asset, CASE WHEN c_custkey % 3 = 0 THEN 2e0 WHEN TRUE THEN 1.5e0 END AS level, 48e0 AS hours FROM customer")
def a14(spark, sf_dir):
    """Own value for every third asset, a common one for the rest, and a default for what no row names."""
    assets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asset"))
    own = assets.where("asset % 3 = 0").select("asset", F.lit("level").alias("name"), F.lit(2.0).alias("value"))
    common = spark.range(1).select(F.lit(None).cast("long").alias("asset"), F.lit("level").alias("name"), F.lit(1.5).alias("value"))
    return config.with_overrides(assets, own.unionByName(common), {"level": 1.0, "hours": 48.0})


@query("a12_latest_snapshot", TRAIN_SQL + " SELECT asset, arg_max(h, h) AS h, arg_max(regime, h) AS regime, arg_max(hypothesis, h) AS hypothesis, round(arg_max(atr, h), 6) AS atr FROM trn GROUP BY asset")
def a12(spark, sf_dir):
    """Newest rows of three sources per asset, side by side."""
    t = training(spark, sf_dir)
    newest = lambda c: t.groupBy("asset").agg(F.max_by(c, "h").alias(c))
    base = t.groupBy("asset").agg(F.max("h").alias("h"))
    return rounded(reduce(lambda a, c: a.join(newest(c), "asset", "left"), ("regime", "hypothesis", "atr"), base))


@query("a08_stored_tables", TRAIN_SQL + ", s AS (SELECT asset AS scope, max(h) AS generated, count(*) AS n FROM trn GROUP BY asset) SELECT scope, CAST(generated AS BIGINT) AS generated, n FROM s WHERE (SELECT max(h) FROM trn) - generated <= 24")
def a08(spark, sf_dir):
    """Tables of every scope stored twice, an older version and a newer one; the fresh ones of a node read back."""
    t = training(spark, sf_dir)
    rows = t.groupBy(F.col("asset").alias("scope")).agg(F.max("h").alias("generated"), F.count("*").alias("n")).withColumns({"branch": F.lit("entry"), "node": F.lit("prediction")})
    rows = io.staged(rows)
    path = f"{io.shared_folder(spark)}/store"
    config.save_tables(rows.withColumn("generated", F.col("generated") - 1), path)
    config.save_tables(rows, path)
    config.save_tables(rows.withColumn("node", F.lit("other")), path)
    now = F.lit(rows.agg(F.max("generated")).first()[0])
    found = config.load_table(spark, path, "prediction", now, 24, "scope string, generated long, n long, branch string, node string")
    return found.select("scope", "generated", "n")


@query("y24_store_status", TRAIN_SQL + ", s AS (SELECT asset, regime, max(h) AS generated FROM trn GROUP BY ALL) SELECT asset, count(*) AS n_tables, CAST((SELECT max(h) FROM trn) - max(generated) AS BIGINT) AS newest_age, CAST((SELECT max(h) FROM trn) - min(generated) AS BIGINT) AS oldest_age, count(*) FILTER ((SELECT max(h) FROM trn) - generated > 24) AS stale FROM s GROUP BY asset")
def y24(spark, sf_dir):
    s = training(spark, sf_dir).groupBy("asset", "regime").agg(F.max("h").alias("generated"))
    s = s.crossJoin(F.broadcast(s.agg(F.max("generated").alias("now")))).withColumn("age", F.col("now") - F.col("generated"))
    return s.groupBy("asset").agg(F.count("*").alias("n_tables"), F.min("age").alias("newest_age"), F.max("age").alias("oldest_age"), F.count_if(F.col("age") > 24).alias("stale"))


@query("a02_insert_new", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def a02(spark, sf_dir):
    """Rows inserted in two batches; a key that is there already is left as it is."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    first = io.latest_wins(o, ["o_custkey"], -F.col("o_orderkey"))
    again = o.where("o_orderkey % 2 = 0").join(first, "o_custkey", "left_anti")
    return first.unionByName(again)


@query("o04_top_strategies", TRAIN_SQL + ", s AS (SELECT regime, hypothesis, count(*) AS n, avg(CASE WHEN state LIKE 'up%' THEN 1e0 WHEN state LIKE 'down%' THEN -1e0 ELSE 0 END) AS edge FROM trn WHERE hypothesis <> 'no_setup' GROUP BY ALL) SELECT regime, hypothesis, n, round(edge, 6) AS edge FROM s WHERE n >= 10 ORDER BY abs(edge) DESC, regime, hypothesis LIMIT 5")
def o04(spark, sf_dir):
    side = F.when(F.col("state").startswith("up"), 1.0).when(F.col("state").startswith("down"), -1.0).otherwise(0.0)
    s = training(spark, sf_dir).where("hypothesis <> 'no_setup'").groupBy("regime", "hypothesis").agg(F.count("*").alias("n"), F.avg(side).alias("edge")).where("n >= 10")
    return rounded(s.orderBy(F.abs("edge").desc(), "regime", "hypothesis").limit(5))
