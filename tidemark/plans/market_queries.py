"""Queries of the domain operators over the market view, with independent DuckDB SQL. Names begin with the inventory row."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.formula import compile_formula
from tidemark.operators import backtest, barrier, classify, cpt, events, stats, weights
from tidemark.sources import io, market

LEVELS, SHORT = barrier.LEVELS, 240
STATES = ["up_strong", "up_weak", "neutral", "down_weak", "down_strong"]
#: State midpoints in ATR.
MIDPOINTS = {"up_strong": 1.25, "up_weak": 0.75, "neutral": 0.0, "down_weak": -0.75, "down_strong": -1.25}
HYPOTHESES = ["strong_long", "weak_long", "no_setup", "weak_short", "strong_short"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = re.sub(r"(?<!['\"])\bleading\b(?!['\"])", '"leading"', sql)  # a keyword there
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """signals() with the three class scores."""
    of = lambda cls: {k: (p, w) for k, (c, p, w) in market.SIGNALS.items() if c == cls}
    return market.signals(spark, sf_dir).withColumns({c: classify.composite(of(c), "half") for c in ("leading", "coincident", "confirming")})


def labels(spark: SparkSession, sf_dir: str, window: int = SHORT) -> DataFrame:
    """(asset, h, m, close, atr, first-touch columns, barrier, hit) of every bar with an ATR."""
    anchors = market.bars(spark, sf_dir).select("asset", (F.col("h") * 60).alias("m"), F.col("close").alias("ref"), "atr", "h")
    path = market.minutes(spark, sf_dir).select("asset", "m", F.col("value").alias("high"), F.col("value").alias("low"))
    name, minute = barrier.first_significant()
    return barrier.first_touch(anchors.drop("h"), path, window=window).withColumns({"h": F.floor(F.col("m") / 60), "barrier": name, "hit": minute})


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with scores, states, regime and hypothesis."""
    lab = labels(spark, sf_dir).select("asset", "h", "barrier", "hit", "max_up", barrier.barrier_state(F.col("barrier"), F.col("hit"), SHORT).alias("state"))
    return evidence(spark, sf_dir).join(lab, ["asset", "h"])


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """composites() with their states, regime and hypothesis, labelled or not."""
    c = composites(spark, sf_dir)
    c = c.withColumns({s + "_state": classify.five_states(F.col(s)) for s in ("leading", "coincident", "confirming")})
    return c.withColumns({"regime": classify.reduced_regime(classify.regime(F.col("trend_slow"), F.col("trend_fast"))), "hypothesis": classify.hypothesis(F.col("leading_state"))})


def touch_sql(window: int) -> str:
    cols = ", ".join([f"min(CASE WHEN (e.value - a.close) / a.atr >= {k} THEN e.m - a.h * 60 - 59 END) AS up_{barrier.level_key(k)}" for k in LEVELS] + [f"min(CASE WHEN (e.value - a.close) / a.atr <= -{k} THEN e.m - a.h * 60 - 59 END) AS down_{barrier.level_key(k)}" for k in LEVELS])
    more = "max((e.value - a.close) / a.atr) AS max_up, min((e.value - a.close) / a.atr) AS max_down, arg_min(e.m - a.h * 60 - 59, (-(e.value - a.close) / a.atr, e.m)) AS max_up_min, arg_min(e.m - a.h * 60 - 59, ((e.value - a.close) / a.atr, e.m)) AS max_down_min"
    case = lambda v: "CASE " + " ".join(
        f"WHEN {win} AND {s}_{k} <= coalesce({o}, 1e9) THEN {v(s, k)}"
        for s, win, o in (("up", "up_075 IS NOT NULL AND up_075 <= coalesce(down_075, 1e9)", "down_075"), ("down", "down_075 IS NOT NULL AND down_075 < coalesce(up_075, 1e9)", "up_075"))
        for k in ("150", "125", "100", "075")
    )
    return f""",
touch AS (SELECT a.asset, a.h, any_value(a.close) AS close, any_value(a.atr) AS atr, {cols}, {more} FROM atr a LEFT JOIN ev e ON e.asset = a.asset AND e.m >= a.h * 60 + 60 AND e.m < a.h * 60 + 60 + {window} GROUP BY a.asset, a.h),
lab AS (SELECT *, {case(lambda s, k: f"'{s}_{k}'")} ELSE 'none' END AS barrier, {case(lambda s, k: f"{s}_{k}")} END AS hit FROM touch),
stt AS (SELECT *, CASE WHEN barrier = 'none' OR hit > {window} THEN 'neutral' WHEN barrier LIKE 'up%' THEN CASE WHEN barrier >= 'up_100' THEN 'up_strong' ELSE 'up_weak' END ELSE CASE WHEN barrier >= 'down_100' THEN 'down_strong' ELSE 'down_weak' END END AS state FROM lab)"""


def five_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 0.15 THEN 'strong_bullish' WHEN {x} >= 0.05 THEN 'bullish' WHEN {x} <= -0.15 THEN 'strong_bearish' WHEN {x} <= -0.05 THEN 'bearish' ELSE 'neutral' END"


REGIME_SQL = "CASE WHEN d IS NULL OR q IS NULL THEN 'macro_ranging' WHEN d >= 2 AND q > 0 THEN 'sync_strong_bullish' WHEN d <= -2 AND q < 0 THEN 'sync_strong_bearish' " + " ".join(f"WHEN sign(d) = {x} AND sign(q) = {y} THEN '{n}'" for (x, y), n in classify.REGIMES.items()) + " END"
REDUCED_SQL = "CASE r " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in classify.REDUCED.items()) + " END"
HYPOTHESIS_SQL = "CASE ls " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in classify.HYPOTHESES.items()) + " END"
TRAIN_SQL = (
    "WITH " + market.SIGNALS_SQL.strip() + touch_sql(SHORT)
    + f""",
cls AS (SELECT *, {five_sql('leading')} AS ls, {five_sql('coincident')} AS cs, {five_sql('confirming')} AS fs, {REGIME_SQL.replace(' d ', ' trend_slow ').replace('(d)', '(trend_slow)').replace(' q ', ' trend_fast ').replace('(q)', '(trend_fast)')} AS r FROM comp),
trn AS (SELECT c.*, {REDUCED_SQL} AS regime, {HYPOTHESIS_SQL} AS hypothesis, s.barrier, s.hit, s.max_up, s.state FROM cls c JOIN stt s USING (asset, h))"""
)
TOUCH_48H = "WITH " + market.BARS_SQL.strip() + touch_sql(2880)
SIGNAL_SQL = "WITH " + market.SIGNALS_SQL.strip()
STATES_VALUES = "(VALUES " + ", ".join(f"('{s}')" for s in STATES) + ") x(state)"


@query("d01_hourly_bars", "WITH " + market.BARS_SQL.strip() + " SELECT asset, h, open, high, low, close FROM bars")
def d01(spark, sf_dir):
    return market.hourly_bars(market.minutes(spark, sf_dir))


@query("d02_atr_bars", "WITH " + market.BARS_SQL.strip() + " SELECT asset, h, round(atr, 6) AS atr FROM atr")
def d02(spark, sf_dir):
    return rounded(market.bars(spark, sf_dir).select("asset", "h", "atr"))


@query("k02_first_touch", TOUCH_48H + " SELECT asset, h, " + ", ".join(f"CAST({s}_{barrier.level_key(k)} AS INTEGER) AS {s}_{barrier.level_key(k)}" for s in ("up", "down") for k in LEVELS) + ", round(max_up, 6) AS max_up, round(max_down, 6) AS max_down, CAST(max_up_min AS INTEGER) AS max_up_min, CAST(max_down_min AS INTEGER) AS max_down_min FROM touch")
def k02(spark, sf_dir):
    return rounded(labels(spark, sf_dir, 2880).drop("m", "ref", "atr", "barrier", "hit"))


@query("k04_first_significant", TOUCH_48H + " SELECT asset, h, barrier, CAST(hit AS INTEGER) AS hit FROM lab")
def k04(spark, sf_dir):
    return labels(spark, sf_dir, 2880).select("asset", "h", "barrier", "hit")


@query("k08_barrier_states", TRAIN_SQL + " SELECT asset, state, count(*) AS n FROM stt GROUP BY asset, state")
def k08(spark, sf_dir):
    return labels(spark, sf_dir).groupBy("asset", barrier.barrier_state(F.col("barrier"), F.col("hit"), SHORT).alias("state")).agg(F.count("*").alias("n"))


@query("k09_horizon_outcome", TOUCH_48H + " SELECT asset, h, CAST(CASE WHEN barrier = 'none' OR hit > 240 THEN 0 WHEN barrier LIKE 'up%' THEN 1 ELSE -1 END AS INTEGER) AS y FROM lab")
def k09(spark, sf_dir):
    out = F.when((F.col("barrier") == "none") | (F.col("hit") > 240), 0).when(F.col("barrier").startswith("up"), 1).otherwise(-1)
    return labels(spark, sf_dir, 2880).select("asset", "h", out.alias("y"))


@query("k10_return_bins", "WITH " + market.BARS_SQL.strip() + ", r AS (SELECT a.asset, a.h, (b.close - a.close) / a.atr AS x FROM atr a JOIN bars b ON b.asset = a.asset AND b.h = a.h + 4) SELECT asset, h, CAST(sign(x) * CASE WHEN abs(x) >= 1.25 THEN 3 WHEN abs(x) >= 0.75 THEN 2 WHEN abs(x) >= 0.25 THEN 1 ELSE 0 END AS INTEGER) AS bin FROM r")
def k10(spark, sf_dir):
    b = market.hourly_bars(market.minutes(spark, sf_dir)).select("asset", (F.col("h") - 4).alias("h"), F.col("close").alias("later"))
    a = market.bars(spark, sf_dir).join(b, ["asset", "h"])
    return a.select("asset", "h", barrier.atr_bins((F.col("later") - F.col("close")) / F.col("atr")).alias("bin"))


@query("j07_asof_atr", "WITH " + market.BARS_SQL.strip() + ", late AS (SELECT asset, (h + 1) * 60 AS at, atr FROM atr) SELECT e.event_id, round(l.atr, 6) AS atr FROM ev e ASOF LEFT JOIN late l ON e.asset = l.asset AND e.m >= l.at")
def j07(spark, sf_dir):
    closed = market.bars(spark, sf_dir).select("asset", ((F.col("h") + 1) * 60).alias("m"), "atr")
    rows = market.minutes(spark, sf_dir).select("asset", "m", "event_id")
    return rounded(barrier.asof_join(rows, closed, "asset", "m", "atr").select("event_id", "atr"))


IDA_SQL = TRAIN_SQL + """,
i0 AS (SELECT asset, h, barrier, hit, leading AS score, CASE WHEN barrier LIKE 'down%' THEN -leading ELSE leading END AS s FROM trn),
i1 AS (SELECT *, 0.2 * abs(s) + 0.8 * greatest(0, coalesce(s - lag(s) OVER (PARTITION BY asset, barrier, hit ORDER BY h), 0)) + 0.01 AS a FROM i0),
i2 AS (SELECT *, a / sum(a) OVER (PARTITION BY asset, barrier, hit) AS w0, count(*) OVER (PARTITION BY asset, barrier, hit) AS n FROM i1),
i3 AS (SELECT *, 1 / sum(w0 * w0) OVER (PARTITION BY asset, barrier, hit) AS e FROM i2),
i4 AS (SELECT *, CASE WHEN e < 0.3 * n AND n > 2 THEN greatest(w0, 0.05) ELSE w0 END AS f FROM i3),
ida AS (SELECT asset, h, barrier, hit, CASE WHEN barrier = 'none' OR hit IS NULL THEN 1.0 ELSE f / sum(f) OVER (PARTITION BY asset, barrier, hit) END::DOUBLE AS w, CASE WHEN barrier = 'none' OR hit IS NULL THEN 1.0 ELSE 1.0 / n END::DOUBLE AS u FROM i4)"""


def weighted(spark, sf_dir):
    rows = training(spark, sf_dir).withColumns({"score": F.col("leading"), "m": F.col("h")})
    return weights.uniqueness(weights.ida_weights(rows))


@query("k12_uniqueness", IDA_SQL + " SELECT asset, h, round(u, 6) AS w FROM ida")
def k12(spark, sf_dir):
    return rounded(weighted(spark, sf_dir).select("asset", "h", "w"))


@query("k14_ida_weights", IDA_SQL + " SELECT asset, h, round(w, 6) AS ida FROM ida")
def k14(spark, sf_dir):
    return rounded(weighted(spark, sf_dir).select("asset", "h", "ida"))


@query("k15_weight_validation", IDA_SQL + " SELECT asset, count(*) AS clusters, CAST(count(*) FILTER (abs(s - 1) > 0.001) AS BIGINT) AS bad FROM (SELECT asset, barrier, hit, sum(w) AS s FROM ida WHERE barrier <> 'none' GROUP BY 1, 2, 3) GROUP BY asset")
def k15(spark, sf_dir):
    sums = weighted(spark, sf_dir).where("barrier <> 'none'").groupBy("asset", "barrier", "hit").agg(F.sum("ida").alias("s"))
    return sums.groupBy("asset").agg(F.count("*").alias("clusters"), F.count_if(F.abs(F.col("s") - 1) > 0.001).alias("bad"))


@query("g19_barrier_n_eff", IDA_SQL + " SELECT barrier, round(power(sum(w), 2) / sum(w * w), 4) AS n_eff, count(*) AS n FROM ida GROUP BY barrier")
def g19(spark, sf_dir):
    return rounded(weights.effective_size(weighted(spark, sf_dir), "ida", "barrier"), 4)


@query("k18_composites", SIGNAL_SQL + " SELECT asset, h, round(leading, 6) AS leading, round(coincident, 6) AS coincident, round(confirming, 6) AS confirming FROM comp")
def k18(spark, sf_dir):
    return rounded(composites(spark, sf_dir).select("asset", "h", "leading", "coincident", "confirming"))


@query("k20_active_aggregate", SIGNAL_SQL + ", long AS (SELECT asset, h, 'leading' AS cls, trend_fast AS v, 1.5e0 AS w FROM sig UNION ALL SELECT asset, h, 'leading', jump, 1e0 FROM sig UNION ALL SELECT asset, h, 'coincident', trend_slow, 1.2e0 FROM sig UNION ALL SELECT asset, h, 'coincident', range_place, 0.8e0 FROM sig) SELECT asset, h, cls, round(sum(v * w) / (2 * sum(w)), 6) AS score FROM long WHERE v <> 0 GROUP BY asset, h, cls")
def k20(spark, sf_dir):
    names = ["trend_fast", "jump", "trend_slow", "range_place"]
    rows = F.array(*(F.struct(F.lit(market.SIGNALS[n][0]).alias("cls"), F.col(n).alias("v"), F.lit(market.SIGNALS[n][2]).alias("w")) for n in names))
    long_ = market.signals(spark, sf_dir).select("asset", "h", F.inline(rows)).where("v <> 0")
    return long_.groupBy("asset", "h", "cls").agg(F.round(F.sum(F.col("v") * F.col("w")) / (2 * F.sum("w")), 6).alias("score"))


@query("k21_five_states", TRAIN_SQL + f", lo AS (SELECT *, CASE WHEN leading >= 0.2 THEN 'strong_bullish' WHEN leading >= 0.1 THEN 'bullish' WHEN leading <= -0.3 THEN 'strong_bearish' WHEN leading <= -0.05 THEN 'bearish' ELSE 'neutral' END AS skewed FROM trn) SELECT asset, h, ls AS symmetric, skewed FROM lo")
def k21(spark, sf_dir):
    return training(spark, sf_dir).select("asset", "h", F.col("leading_state").alias("symmetric"), classify.five_states(F.col("leading"), 0.1, 0.2, 0.05, 0.3).alias("skewed"))


@query("k22_regime", TRAIN_SQL + " SELECT asset, h, r AS regime, regime AS reduced FROM trn")
def k22(spark, sf_dir):
    return training(spark, sf_dir).select("asset", "h", classify.regime(F.col("trend_slow"), F.col("trend_fast")).alias("regime"), F.col("regime").alias("reduced"))


@query("k26_concordance", SIGNAL_SQL + ", c AS (SELECT asset, h, (trend_slow * 60 + trend_fast * 30 + jump * 10 + 200) / 400e0 AS x, (trend_slow * 50 + cross_sig * 25 + trend_fast * 15 + jump * 10 + 200) / 400e0 AS y FROM sig) SELECT asset, h, round(x, 6) AS three, round(y, 6) AS four, CASE WHEN y >= 0.8 THEN 'strong' WHEN y >= 0.6 THEN 'moderate' WHEN y >= 0.4 THEN 'mixed' ELSE 'weak' END AS evidence FROM c")
def k26(spark, sf_dir):
    s = market.signals(spark, sf_dir)
    three, four = classify.concordance_score(s["trend_slow"], s["trend_fast"], s["jump"]), classify.concordance_score(s["trend_slow"], s["cross"], s["trend_fast"], s["jump"])
    return rounded(s.select("asset", "h", three.alias("three"), four.alias("four"), classify.evidence_state(four).alias("evidence")))


VALUE_SQL = lambda c: f"(CASE {c} WHEN 'strong_bullish' THEN 2 WHEN 'bullish' THEN 1 WHEN 'neutral' THEN 0 WHEN 'bearish' THEN -1 ELSE -2 END)"


@query("k30_alignment", TRAIN_SQL + f", a AS (SELECT asset, h, {VALUE_SQL('cs')} AS c, {VALUE_SQL('fs')} AS f FROM trn) SELECT asset, h, c * f / 4e0 AS alignment, CASE WHEN c = 0 AND f = 0 THEN 'NEUTRAL' WHEN c = 0 OR f = 0 THEN 'PARTIAL' WHEN sign(c) = sign(f) THEN 'FULL_ALIGNED' ELSE 'OPPOSING' END AS category, CASE WHEN c * f / 4e0 >= 0.1 THEN 'high' WHEN c * f / 4e0 <= -0.1 THEN 'low' ELSE 'medium' END AS confidence FROM a")
def k30(spark, sf_dir):
    t = training(spark, sf_dir)
    return t.select("asset", "h", *(v.alias(k) for k, v in classify.alignment(t["coincident_state"], t["confirming_state"]).items()))


@query("k31_hypothesis", TRAIN_SQL + " SELECT hypothesis, count(*) AS n FROM trn GROUP BY hypothesis")
def k31(spark, sf_dir):
    return training(spark, sf_dir).groupBy("hypothesis").agg(F.count("*").alias("n"))


@query("k32_position_labels", TRAIN_SQL + ", p AS (SELECT asset, h, close / lag(close) OVER w - 1 AS ch, atr / lag(atr) OVER w AS vr, leading - lag(leading) OVER w AS dl, 60 * (h - lag(h) OVER w) AS mins, (close - lag(close) OVER w) / lag(atr) OVER w AS pnl, state FROM trn WINDOW w AS (PARTITION BY asset ORDER BY h)) SELECT asset, h, CASE WHEN ch > 0.005 THEN 'bullish' WHEN ch < -0.005 THEN 'bearish' ELSE 'neutral' END AS momentum, CASE WHEN coalesce(nullif(vr, 0), 1) < 0.8 THEN 'low_vol' WHEN coalesce(nullif(vr, 0), 1) > 1.2 THEN 'high_vol' ELSE 'normal' END AS volatility, CASE WHEN dl >= 0.03 THEN 'strengthening' WHEN dl <= -0.03 THEN 'weakening' ELSE 'stable' END AS delta, CASE WHEN mins < 60 THEN '0-1h' WHEN mins < 240 THEN '1-4h' WHEN mins < 720 THEN '4-12h' ELSE '12h+' END AS bucket, CASE WHEN coalesce(pnl, 0) < -0.25 THEN 'losing' WHEN coalesce(pnl, 0) > 0.25 THEN 'winning' ELSE 'breakeven' END AS pnl, CASE WHEN state LIKE 'up%' THEN 'target_hit' WHEN state LIKE 'down%' THEN 'stoploss_hit' ELSE 'timeout' END AS long_label FROM p")
def k32(spark, sf_dir):
    by = Window.partitionBy("asset").orderBy("h")
    before = lambda c: F.lag(c).over(by)
    t = training(spark, sf_dir)
    return t.select(
        "asset", "h", classify.momentum_label(F.col("close") / before("close") - 1).alias("momentum"), classify.volatility_label(F.col("atr") / before("atr")).alias("volatility"),
        classify.delta_state(F.col("leading") - before("leading"), 0.03).alias("delta"), classify.time_bucket(60 * (F.col("h") - before("h"))).alias("bucket"),
        classify.pnl_bucket(F.coalesce((F.col("close") - before("close")) / before("atr"), F.lit(0.0))).alias("pnl"), classify.direction_label(F.col("state"), F.lit("long")).alias("long_label"),
    )


CPT_SQL = TRAIN_SQL + f""",
cnt AS (SELECT regime, hypothesis, state, count(*) AS w FROM trn GROUP BY 1, 2, 3),
ks AS (SELECT DISTINCT regime, hypothesis FROM cnt),
c AS (SELECT ks.regime, ks.hypothesis, x.state, (coalesce(cnt.w, 0) + 1e0) / (t.n + 5) AS prob, t.n::DOUBLE AS weight_total FROM ks CROSS JOIN {STATES_VALUES} LEFT JOIN cnt ON cnt.regime = ks.regime AND cnt.hypothesis = ks.hypothesis AND cnt.state = x.state JOIN (SELECT regime, hypothesis, sum(w) AS n FROM cnt GROUP BY 1, 2) t ON t.regime = ks.regime AND t.hypothesis = ks.hypothesis)"""


def prediction_cpt(rows: DataFrame, weight=None) -> DataFrame:
    return cpt.conditional(rows, ["regime", "hypothesis"], "state", STATES, weight)


@query("c01_conditional_cpt", CPT_SQL + " SELECT regime, hypothesis, state, round(prob, 6) AS prob, round(weight_total, 6) AS weight_total FROM c")
def c01(spark, sf_dir):
    return rounded(prediction_cpt(training(spark, sf_dir)))


@query("c02_prior_cpt", TRAIN_SQL + f" SELECT x.state, round((coalesce(n, 0) + 1e0) / ((SELECT count(*) FROM trn) + 5), 6) AS prob FROM {STATES_VALUES} LEFT JOIN (SELECT state, count(*) AS n FROM trn GROUP BY state) t USING (state)")
def c02(spark, sf_dir):
    return rounded(cpt.prior(training(spark, sf_dir), "state", STATES))


@query("c05_hypothesis_cpt_grid", TRAIN_SQL + " , g AS (SELECT a.s AS leading_state, b.s AS hypothesis FROM (VALUES ('strong_bullish'), ('bullish'), ('neutral'), ('bearish'), ('strong_bearish')) a(s) CROSS JOIN (VALUES ('strong_long'), ('weak_long'), ('no_setup'), ('weak_short'), ('strong_short')) b(s)) SELECT g.leading_state, g.hypothesis, round((coalesce(x.n, 0) + 1e0) / (coalesce(t.n, 0) + 5), 6) AS prob FROM g LEFT JOIN (SELECT ls, hypothesis, count(*) AS n FROM trn GROUP BY 1, 2) x ON x.ls = g.leading_state AND x.hypothesis = g.hypothesis LEFT JOIN (SELECT ls, count(*) AS n FROM trn GROUP BY 1) t ON t.ls = g.leading_state")
def c05(spark, sf_dir):
    keys = cpt.grid(spark, leading_state=list(classify.HYPOTHESES))
    return rounded(cpt.conditional(training(spark, sf_dir), ["leading_state"], "hypothesis", HYPOTHESES, keys=keys).drop("weight_total"))


@query("c06_weighted_cpt", IDA_SQL + f", j AS (SELECT t.regime, t.state, i.w * CASE WHEN t.state = 'neutral' THEN 0.5 ELSE 1 END AS w FROM trn t JOIN ida i USING (asset, h)), k AS (SELECT regime, state, sum(w) AS w FROM j GROUP BY 1, 2) SELECT r.regime, x.state, round((coalesce(k.w, 0) + 1e0) / (r.n + 5), 6) AS prob FROM (SELECT regime, sum(w) AS n FROM k GROUP BY 1) r CROSS JOIN {STATES_VALUES} LEFT JOIN k ON k.regime = r.regime AND k.state = x.state")
def c06(spark, sf_dir):
    w = F.col("ida") * F.when(F.col("state") == "neutral", 0.5).otherwise(1.0)
    return rounded(cpt.conditional(weighted(spark, sf_dir), ["regime"], "state", STATES, w).drop("weight_total"))


@query("c19_cpt_quality", CPT_SQL + " SELECT count(*) AS n_keys, round(avg(h), 6) AS mean_entropy, round(max(o), 6) AS max_off FROM (SELECT regime, hypothesis, sum(-prob * log2(prob)) AS h, abs(sum(prob) - 1) AS o FROM c GROUP BY 1, 2)")
def c19(spark, sf_dir):
    return rounded(cpt.quality(prediction_cpt(training(spark, sf_dir)), ["regime", "hypothesis"]))


def _half(n: int) -> str:
    return f"""s{n} AS (SELECT regime, state, count(*) AS w FROM trn WHERE h % 2 = {n} GROUP BY 1, 2), p{n} AS (SELECT r.regime, x.state, (coalesce(s.w, 0) + 1e0) / (r.n + 5) AS p FROM (SELECT regime, sum(w) AS n FROM s{n} GROUP BY 1) r CROSS JOIN {STATES_VALUES} LEFT JOIN s{n} s ON s.regime = r.regime AND s.state = x.state)"""


@query("c22_cpt_stability", TRAIN_SQL + f", {_half(0)}, {_half(1)} SELECT round(1 - avg(d), 6) AS stability, count(*) AS n_keys FROM (SELECT regime, sqrt(greatest(sum((a.p * log2(2 * a.p / (a.p + b.p)) + b.p * log2(2 * b.p / (a.p + b.p))) / 2), 0)) AS d FROM p0 a JOIN p1 b USING (regime, state) GROUP BY regime)")
def c22(spark, sf_dir):
    t = training(spark, sf_dir)
    a, b = (cpt.conditional(t.where(F.col("h") % 2 == i), ["regime"], "state", STATES) for i in (0, 1))
    return rounded(cpt.stability(a, b, ["regime"], "state"))


@query("c24_cpt_cascade", TRAIN_SQL + ", own AS (SELECT regime, state, count(*) AS n FROM trn WHERE asset = (SELECT min(asset) FROM trn) GROUP BY 1, 2), ev2 AS (SELECT regime, state, count(*) AS n FROM trn GROUP BY 1, 2) SELECT regime, state, n FROM own UNION ALL SELECT regime, state, n FROM ev2 WHERE regime NOT IN (SELECT regime FROM own)")
def c24(spark, sf_dir):
    t = training(spark, sf_dir)
    count = lambda d: d.groupBy("regime", "state").agg(F.count("*").alias("n"))
    first = t.agg(F.min("asset").alias("asset"))
    return cpt.cascade([count(t.join(F.broadcast(first), "asset")), count(t)], ["regime"])


CUT = "(SELECT min(h) + (max(h) - min(h)) * 7 // 10 FROM trn)"
INFER_SQL = TRAIN_SQL + f""",
fit AS (SELECT * FROM trn WHERE h < {CUT}), tst AS (SELECT * FROM trn WHERE h >= {CUT}),
fc AS (SELECT regime, hypothesis, state, count(*) AS w FROM fit GROUP BY 1, 2, 3), fk AS (SELECT regime, hypothesis, sum(w) AS n FROM fc GROUP BY 1, 2),
pr AS (SELECT x.state, (coalesce(n, 0) + 1e0) / ((SELECT count(*) FROM fit) + 5) AS d FROM {STATES_VALUES} LEFT JOIN (SELECT state, count(*) AS n FROM fit GROUP BY 1) t USING (state)),
dist AS (SELECT t.asset, t.h, t.state AS actual, x.state, CASE WHEN fk.n IS NULL THEN pr.d ELSE (coalesce(fc.w, 0) + 1e0) / (fk.n + 5) END AS p FROM tst t CROSS JOIN {STATES_VALUES} JOIN pr ON pr.state = x.state LEFT JOIN fk ON fk.regime = t.regime AND fk.hypothesis = t.hypothesis LEFT JOIN fc ON fc.regime = t.regime AND fc.hypothesis = t.hypothesis AND fc.state = x.state),
wide AS (SELECT asset, h, any_value(actual) AS actual, {", ".join(f"max(CASE WHEN state = '{s}' THEN p END) AS p_{s}" for s in STATES)} FROM dist GROUP BY 1, 2),
pred AS (SELECT *, CASE greatest({", ".join(f"p_{s}" for s in STATES)}) {" ".join(f"WHEN p_{s} THEN '{s}'" for s in STATES)} END AS predicted FROM wide)"""


def predictions(spark, sf_dir):
    """Tables fitted on the first 70 % of the period, looked up for the rest."""
    t = io.staged(training(spark, sf_dir))  # met four times
    ends = t.agg((F.min("h") + F.floor((F.max("h") - F.min("h")) * 7 / 10)).alias("cut"))
    t = t.crossJoin(F.broadcast(ends))
    fit, test = t.where("h < cut"), t.where("h >= cut").drop("cut")
    found = cpt.lookup(test.withColumnRenamed("state", "actual"), prediction_cpt(fit), ["regime", "hypothesis"], "state", STATES, cpt.prior(fit, "state", STATES))
    return found.withColumn("predicted", cpt.argmax(STATES))


@query("i01_batch_inference", INFER_SQL + " SELECT asset, h, actual, predicted, " + ", ".join(f"round(p_{s}, 6) AS p_{s}" for s in STATES) + " FROM pred")
def i01(spark, sf_dir):
    return rounded(predictions(spark, sf_dir).select("asset", "h", "actual", "predicted", *(f"p_{s}" for s in STATES)))


@query("i05_expected_atr", INFER_SQL + " SELECT asset, h, round(" + " + ".join(f"p_{s} * {v}" for s, v in MIDPOINTS.items()) + ", 6) AS expected FROM pred")
def i05(spark, sf_dir):
    return rounded(predictions(spark, sf_dir).select("asset", "h", cpt.expected_atr(MIDPOINTS).alias("expected")))


@query("i06_prediction_metrics", INFER_SQL + " SELECT asset, h, CASE WHEN u > d THEN 'up' WHEN d > u THEN 'down' ELSE 'flat' END AS direction, round(greatest(u, d), 6) AS win_rate, round(u / d, 6) AS strength FROM (SELECT asset, h, p_up_strong + p_up_weak AS u, p_down_strong + p_down_weak AS d FROM pred)")
def i06(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumns({"u": F.col("p_up_strong") + F.col("p_up_weak"), "d": F.col("p_down_strong") + F.col("p_down_weak")})
    return rounded(p.select("asset", "h", F.when(F.col("u") > F.col("d"), "up").when(F.col("d") > F.col("u"), "down").otherwise("flat").alias("direction"), F.greatest("u", "d").alias("win_rate"), (F.col("u") / F.col("d")).alias("strength")))


@query("r12_probability_strategy", INFER_SQL + " SELECT asset, h, CAST(CASE WHEN p_up_strong + p_up_weak >= 0.5 THEN 1 WHEN p_down_strong + p_down_weak >= 0.5 THEN -1 ELSE 0 END AS INTEGER) AS side, CAST(CASE WHEN p_up_strong + p_up_weak >= 1.5 * (p_down_strong + p_down_weak) THEN 1 WHEN p_down_strong + p_down_weak >= 1.5 * (p_up_strong + p_up_weak) THEN -1 ELSE 0 END AS INTEGER) AS edge_side FROM pred")
def r12(spark, sf_dir):
    p = predictions(spark, sf_dir)
    u, d = p["p_up_strong"] + p["p_up_weak"], p["p_down_strong"] + p["p_down_weak"]
    return p.select("asset", "h", F.when(u >= 0.5, 1).when(d >= 0.5, -1).otherwise(0).alias("side"), F.when(u >= 1.5 * d, 1).when(d >= 1.5 * u, -1).otherwise(0).alias("edge_side"))


BRIER = "(" + " + ".join(f"power(p_{s} - CASE WHEN actual = '{s}' THEN 1 ELSE 0 END, 2)" for s in STATES) + ") / 5"


@query("r02_step_metrics", INFER_SQL + f" SELECT asset, h // 24 AS step, count(*) AS n, round(avg(CASE WHEN predicted = actual THEN 1e0 ELSE 0 END), 6) AS accuracy, round(avg(CASE WHEN split_part(predicted, '_', 1) = split_part(actual, '_', 1) THEN 1e0 ELSE 0 END), 6) AS directional, round(avg({BRIER}), 6) AS brier FROM pred GROUP BY 1, 2")
def r02(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumns({"step": F.floor(F.col("h") / 24), "brier": F.expr(BRIER)})
    side = lambda c: F.split_part(F.col(c), F.lit("_"), F.lit(1))
    return rounded(p.groupBy("asset", "step").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("actual")).cast("double")).alias("accuracy"), F.avg((side("predicted") == side("actual")).cast("double")).alias("directional"), F.avg("brier").alias("brier")))


@query("v04_calibration", INFER_SQL + " SELECT CAST(least(floor(p_neutral * 5), 4) AS BIGINT) AS bin, count(*) AS n, round(avg(p_neutral), 6) AS predicted, round(avg(CASE WHEN actual = 'neutral' THEN 1e0 ELSE 0 END), 6) AS observed FROM pred GROUP BY 1")
def v04(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return rounded(p.groupBy(F.least(F.floor(F.col("p_neutral") * 5), F.lit(4)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p_neutral").alias("predicted"), F.avg((F.col("actual") == "neutral").cast("double")).alias("observed")))


@query("v12_confusion", INFER_SQL + " SELECT predicted, actual, count(*) AS n FROM pred GROUP BY 1, 2")
def v12(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("predicted", "actual").agg(F.count("*").alias("n"))


COMBO_SQL = IDA_SQL + f""",
cb AS (SELECT ({VALUE_SQL('ls')} + 2) * 25 + ({VALUE_SQL('cs')} + 2) * 5 + {VALUE_SQL('fs')} + 2 AS combo, t.state LIKE 'up%' AS y, i.w FROM trn t JOIN ida i USING (asset, h)),
ab AS (SELECT combo, sum(CASE WHEN y THEN w ELSE 0 END) AS a, sum(CASE WHEN y THEN 0 ELSE w END) AS b FROM cb GROUP BY combo),
tb AS (SELECT combo, a, b, sum(a) OVER () - a AS c, sum(b) OVER () - b AS d FROM ab)"""


def combos(spark, sf_dir):
    rows = weighted(spark, sf_dir)
    v = {s: classify.mapped(F.col(f"{s}_state"), classify.STATE_VALUES) + 2 for s in ("leading", "coincident", "confirming")}
    rows = rows.select((v["leading"] * 25 + v["coincident"] * 5 + v["confirming"]).cast("long").alias("combo"), F.col("state").startswith("up").alias("hit"), "ida")
    return stats.contingency(rows, "combo", "hit", F.col("ida"), [])


@query("g14_contingency", COMBO_SQL + " SELECT combo::BIGINT AS combo, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d FROM tb")
def g14(spark, sf_dir):
    return rounded(combos(spark, sf_dir))


T01_SQL = COMBO_SQL + """,
o AS (SELECT *, ln((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))) AS l, sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5)) AS se, (a + b) * (c + d) * (a + c) * (b + d) AS mg, a + b + c + d AS n FROM tb),
z AS (SELECT *, abs(l / se) AS x, 1 / (1 + 0.2316419 * abs(l / se)) AS t, CASE WHEN mg > 0 THEN n * power(greatest(abs(a * d - b * c) - n / 2, 0), 2) / mg ELSE 0 END AS chi2 FROM o),
st AS (SELECT *, exp(l) AS odds_ratio, exp(l - 1.959963984540054 * se) AS ci_low, exp(l + 1.959963984540054 * se) AS ci_high,
  2 * (exp(-x * x / 2) / sqrt(2 * pi()) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))) AS p_value, CASE WHEN mg > 0 THEN (a * d - b * c) / sqrt(mg) ELSE 0 END AS mcc FROM z)"""


@query("t01_odds_ratio", T01_SQL + " SELECT combo::BIGINT AS combo, round(odds_ratio, 4) AS odds_ratio, round(ci_low, 4) AS ci_low, round(ci_high, 4) AS ci_high, round(p_value, 6) AS p_value, round(chi2, 4) AS chi2, round(mcc, 6) AS mcc, round(sqrt(chi2 / n), 6) AS cramers_v, round(CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0 END, 6) AS ppv FROM st")
def t01(spark, sf_dir):
    t = stats.table_statistics(combos(spark, sf_dir))
    return t.select("combo", *(F.round(c, k).alias(c) for c, k in (("odds_ratio", 4), ("ci_low", 4), ("ci_high", 4), ("p_value", 6), ("chi2", 4), ("mcc", 6), ("cramers_v", 6), ("ppv", 6))))


@query("t08_multiple_testing", T01_SQL + ", k AS (SELECT combo, p_value AS p, row_number() OVER (ORDER BY p_value, combo) AS k, count(*) OVER () AS m FROM st), h AS (SELECT *, (SELECT sum(1e0 / k) FROM k) AS hs FROM k) SELECT combo::BIGINT AS combo, round(least(1, min(p * m / k) OVER (ORDER BY k DESC)), 6) AS bh, round(least(1, min(p * m / k * hs) OVER (ORDER BY k DESC)), 6) AS by_, round(least(1, p * m), 6) AS bonferroni, round(least(1, max(p * (m - k + 1)) OVER (ORDER BY k)), 6) AS holm FROM h")
def t08(spark, sf_dir):
    t = stats.table_statistics(combos(spark, sf_dir)).withColumn("target", F.lit("up"))
    return rounded(stats.adjusted(t, "p_value", ["target"], "combo").select("combo", "bh", "by_", "bonferroni", "holm"))


@query("t09_signal_classes", T01_SQL + " SELECT combo::BIGINT AS combo, CASE WHEN odds_ratio > 1.5 AND ci_low > 1 AND a + b >= 20 AND mcc > 0.05 THEN 'golden' WHEN odds_ratio > 1 AND ci_low > 1 THEN 'promising' ELSE 'noise' END AS class FROM st")
def t09(spark, sf_dir):
    t = stats.table_statistics(combos(spark, sf_dir))
    return t.select("combo", stats.signal_class(t).alias("class"))


@query("t05_bootstrap_odds")
def t05(spark, sf_dir):
    return rounded(stats.bootstrap_odds(combos(spark, sf_dir), "combo"))


@query("t02_fisher", COMBO_SQL + """, q AS (SELECT combo, CAST(floor(a + 0.5 + 1e-9) AS BIGINT) AS a, CAST(floor(b + 0.5 + 1e-9) AS BIGINT) AS b, CAST(floor(c + 0.5 + 1e-9) AS BIGINT) AS c, CAST(floor(d + 0.5 + 1e-9) AS BIGINT) AS d FROM tb),
e AS (SELECT combo, a, b, c, d, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS k FROM q),
l AS (SELECT *, lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1) - lgamma(c + d - a - c + k + 1) - (lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1)) AS v FROM e WHERE c + d - a - c + k >= 0 AND a + c - k >= 0)
SELECT combo::BIGINT AS combo, round(least(1e0, sum(CASE WHEN v <= o + 1e-7 THEN exp(v) ELSE 0 END)), 6) AS p FROM (SELECT *, max(CASE WHEN k = a THEN v END) OVER (PARTITION BY combo) AS o FROM l) GROUP BY combo""")
def t02(spark, sf_dir):
    return rounded(combos(spark, sf_dir).select("combo", stats.fisher_p("a", "b", "c", "d").alias("p")))


@query("t12_mutual_information", IDA_SQL + ", x AS (SELECT t.asset, t.ls, t.state, sum(i.w) AS w FROM trn t JOIN ida i USING (asset, h) GROUP BY 1, 2, 3), y AS (SELECT *, sum(w) OVER (PARTITION BY asset) AS n, sum(w) OVER (PARTITION BY asset, ls) AS wx, sum(w) OVER (PARTITION BY asset, state) AS wy FROM x) SELECT asset, round(greatest(sum(w / n * ln(w * n / (wx * wy))), 0), 6) AS mi FROM y WHERE w > 0 GROUP BY asset")
def t12(spark, sf_dir):
    return rounded(stats.mutual_information(weighted(spark, sf_dir), "leading_state", "state", F.col("ida"), ["asset"]))


@query("t13_hit_rate", IDA_SQL + " SELECT asset, round(CASE WHEN count(*) >= 50 THEN sum(CASE WHEN sign(leading) = CASE WHEN state LIKE 'up%' THEN 1 ELSE -1 END THEN w ELSE 0 END) / sum(w) ELSE 0.5 END, 6) AS hit_rate FROM trn JOIN ida USING (asset, h) WHERE state <> 'neutral' AND leading <> 0 GROUP BY asset")
def t13(spark, sf_dir):
    t = weighted(spark, sf_dir).where("state <> 'neutral' AND leading <> 0")
    right = F.signum("leading") == F.when(F.col("state").startswith("up"), 1).otherwise(-1)
    return rounded(t.groupBy("asset").agg(F.when(F.count("*") >= 50, F.sum(F.when(right, F.col("ida")).otherwise(0.0)) / F.sum("ida")).otherwise(0.5).alias("hit_rate")))


@query("t17_correlation", TRAIN_SQL + " SELECT asset, round(corr(leading, coincident), 6) AS r FROM trn GROUP BY asset")
def t17(spark, sf_dir):
    return rounded(training(spark, sf_dir).groupBy("asset").agg(F.corr("leading", "coincident").alias("r")))


GRID_SQL = TRAIN_SQL + """,
s AS (SELECT round(leading, 2) AS x, state, count(*) AS w FROM trn GROUP BY 1, 2), gr AS (SELECT nb / 100e0 AS nb, st / 100e0 AS st FROM (SELECT unnest(range(2, 18, 2)) AS nb) CROSS JOIN (SELECT unnest(range(10, 55, 5)) AS st) WHERE nb < st),
cells AS (SELECT nb, st, CASE WHEN x >= st THEN 2 WHEN x >= nb THEN 1 WHEN x <= -st THEN -2 WHEN x <= -nb THEN -1 ELSE 0 END AS c, state, sum(w) AS w FROM gr CROSS JOIN s GROUP BY 1, 2, 3, 4),
mg AS (SELECT *, sum(w) OVER (PARTITION BY nb, st) AS n, sum(w) OVER (PARTITION BY nb, st, c) AS wx, sum(w) OVER (PARTITION BY nb, st, state) AS wy FROM cells)"""


@query("m01_threshold_grid", GRID_SQL + " SELECT nb, st, round(sum(w / n * ln(w * n / (wx * wy))), 6) AS mi, round(max(CASE WHEN c = 0 THEN wx / n ELSE 0 END), 6) AS neutral_share FROM mg GROUP BY nb, st")
def m01(spark, sf_dir):
    """Rows collapse to (score, state) counts before they meet the grid."""
    cells = training(spark, sf_dir).groupBy(F.round("leading", 2).alias("x"), "state").agg(F.count("*").alias("w"))
    grid = spark.createDataFrame([(nb / 100, st / 100) for nb in range(2, 18, 2) for st in range(10, 55, 5) if nb < st], "nb double, st double")
    code = F.when(F.col("x") >= F.col("st"), 2).when(F.col("x") >= F.col("nb"), 1).when(F.col("x") <= -F.col("st"), -2).when(F.col("x") <= -F.col("nb"), -1).otherwise(0)
    rows = cells.crossJoin(F.broadcast(grid)).withColumn("c", code)
    mi = stats.mutual_information(rows, "c", "state", F.col("w"), ["nb", "st"])
    neutral = rows.groupBy("nb", "st").agg((F.sum(F.when(F.col("c") == 0, F.col("w")).otherwise(0)) / F.sum("w")).alias("neutral_share"))
    return rounded(mi.join(neutral, ["nb", "st"]))


SIDE_GRID = [(nb / 100, st / 100) for st in (15, 20, 25, 30, 35, 40, 45, 50, 60) for nb in (5, 8, 10, 12, 15, 18, 20, 25) if nb < st]
GRID_KEYS = ["bull_st", "bull_nb", "bear_st", "bear_nb"]
SEARCH_SQL = TRAIN_SQL + """,
s AS (SELECT "leading" AS x, state, count(*) AS w FROM trn GROUP BY 1, 2),
side AS (SELECT nb / 100e0 AS nb, st / 100e0 AS st FROM (SELECT unnest([5, 8, 10, 12, 15, 18, 20, 25]) AS nb) CROSS JOIN (SELECT unnest([15, 20, 25, 30, 35, 40, 45, 50, 60]) AS st) WHERE nb < st),
gr AS (SELECT a.nb AS bull_nb, a.st AS bull_st, b.nb AS bear_nb, b.st AS bear_st FROM side a CROSS JOIN side b),
cells AS (SELECT bull_st, bull_nb, bear_st, bear_nb, CASE WHEN x >= bull_st THEN 2 WHEN x >= bull_nb THEN 1 WHEN x <= -bear_st THEN -2 WHEN x <= -bear_nb THEN -1 ELSE 0 END AS c, state, sum(w) AS w FROM gr CROSS JOIN s GROUP BY 1, 2, 3, 4, 5, 6),
mg AS (SELECT *, sum(w) OVER (PARTITION BY bull_st, bull_nb, bear_st, bear_nb) AS n, sum(w) OVER (PARTITION BY bull_st, bull_nb, bear_st, bear_nb, c) AS wx, sum(w) OVER (PARTITION BY bull_st, bull_nb, bear_st, bear_nb, state) AS wy FROM cells),
mi AS (SELECT bull_st, bull_nb, bear_st, bear_nb, greatest(sum(w / n * ln(w * n / (wx * wy))), 0) AS mi, sum(CASE WHEN c = 0 THEN w ELSE 0 END) / max(n) AS neutral, sum(CASE WHEN c > 0 THEN w ELSE 0 END) / max(n) AS bull, sum(CASE WHEN c < 0 THEN w ELSE 0 END) / max(n) AS bear, count(DISTINCT CASE WHEN wx / n > 0.05 THEN c END) AS active FROM mg GROUP BY 1, 2, 3, 4),
ok AS (SELECT *, active >= 3 AND neutral >= 0.1 AND neutral <= 0.6 AND bull >= 0.05 AND bear >= 0.05 AS valid FROM mi)"""


@query("m01_asymmetric_search", SEARCH_SQL + " SELECT bull_st, bull_nb, bear_st, bear_nb, round(mi, 6) AS mi, round(neutral, 6) AS neutral_share, valid, row_number() OVER (ORDER BY valid DESC, round(mi, 9) DESC, bull_st, bull_nb, bear_st, bear_nb) = 1 AS best FROM ok")
def m01_search(spark, sf_dir):
    """Band and threshold of either side vary alone; best: the first in grid order of the most informative valid rows, of all
    rows where none is valid. Scores collapse to the steps between thresholds before they meet the grid."""
    edges = sorted({v for pair in SIDE_GRID for v in pair})
    steps = lambda x: sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))
    up = steps(F.col("leading")) - steps(-F.col("leading"))
    cells = training(spark, sf_dir).groupBy(up.alias("x"), "state").agg(F.count("*").alias("w"))
    at = {e: i + 1 for i, e in enumerate(edges)}
    grid = spark.createDataFrame([(s, n, t, m, at[s], at[n], at[t], at[m]) for n, s in SIDE_GRID for m, t in SIDE_GRID], ", ".join(f"{k} double" for k in GRID_KEYS) + ", s int, n int, t int, m int")
    code = F.when(F.col("x") >= F.col("s"), 2).when(F.col("x") >= F.col("n"), 1).when(F.col("x") <= -F.col("t"), -2).when(F.col("x") <= -F.col("m"), -1).otherwise(0)
    rows = cells.crossJoin(F.broadcast(grid)).withColumn("c", code)
    mi = stats.mutual_information(rows, "c", "state", F.col("w"), GRID_KEYS)
    part = {c: F.sum(F.when(F.col("c") == c, F.col("w")).otherwise(0)) / F.sum("w") for c in (-2, -1, 0, 1, 2)}
    share = rows.groupBy(*GRID_KEYS).agg(*(v.alias(f"c{c}") for c, v in part.items()), *((F.sum(F.when(test, F.col("w")).otherwise(0)) / F.sum("w")).alias(k) for k, test in (("bull", F.col("c") > 0), ("bear", F.col("c") < 0))))
    active = sum((F.when(F.col(f"c{c}") > 0.05, 1).otherwise(0) for c in part), F.lit(0))
    valid = (active >= 3) & F.col("c0").between(0.1, 0.6) & (F.col("bull") >= 0.05) & (F.col("bear") >= 0.05)
    all_rows = mi.join(share, GRID_KEYS).withColumn("valid", valid)
    first = F.row_number().over(Window.orderBy(F.desc("valid"), F.desc(F.round("mi", 9)), *GRID_KEYS))
    return rounded(all_rows.select(*GRID_KEYS, "mi", F.col("c0").alias("neutral_share"), "valid", (first == 1).alias("best")))


@query("m04_decision_tree")
def m04(spark, sf_dir):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    t = training(spark, sf_dir).select("leading", F.col("state").startswith("up").cast("double").alias("label"))
    data = VectorAssembler(inputCols=["leading"], outputCol="features").transform(t)
    model = DecisionTreeClassifier(maxDepth=3, seed=42).fit(data)
    return model.transform(data).groupBy("label", "prediction").agg(F.count("*").alias("n"))


@query("m06_logistic_regression")
def m06(spark, sf_dir):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    names = list(market.SIGNALS)
    t = training(spark, sf_dir).select(*names, F.col("state").startswith("up").cast("double").alias("label"))
    data = VectorAssembler(inputCols=names, outputCol="raw").transform(t)
    data = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(data).transform(data)
    model = LogisticRegression(regParam=1.0 / max(1, data.count())).fit(data)
    size = max(abs(float(v)) for v in model.coefficients) or 1.0
    return spark.createDataFrame([(n, float(v), 0.5 + 2.0 * abs(float(v)) / size) for n, v in zip(names, model.coefficients, strict=True)], "signal string, coefficient double, weight double")


SPIKE_SQL = TRAIN_SQL + """,
e0 AS (SELECT asset, h * 60 AS m, leading AS score, coalesce(abs(leading - lag(leading) OVER (PARTITION BY asset ORDER BY h)), 0) AS delta, barrier FROM trn),
e1 AS (SELECT *, abs(score) >= 0.15 OR delta >= 0.08 AS spike, min(CASE WHEN barrier <> 'none' THEN m END) OVER r AS hm, max(m) OVER r AS lm FROM e0 WINDOW r AS (PARTITION BY asset ORDER BY m RANGE BETWEEN CURRENT ROW AND 1440 FOLLOWING)),
e2 AS (SELECT e1.asset, e1.m, e1.score, e1.delta, coalesce(hm, lm) AS end_m, coalesce(b.barrier, 'timeout') AS outcome FROM e1 LEFT JOIN e0 b ON b.asset = e1.asset AND b.m = e1.hm WHERE spike AND coalesce(hm, lm) - e1.m >= 60)"""


def spike_rows(spark, sf_dir):
    return training(spark, sf_dir).select("asset", (F.col("h") * 60).alias("m"), F.col("leading").alias("score"), "barrier")


@query("e01_spikes", SPIKE_SQL + " SELECT asset, m, spike FROM e1")
def e01(spark, sf_dir):
    return events.spikes(spike_rows(spark, sf_dir)).select("asset", "m", "spike")


@query("e03_candidate_windows", SPIKE_SQL + " SELECT asset, m, end_m, outcome FROM e2")
def e03(spark, sf_dir):
    return events.candidate_windows(events.spikes(spike_rows(spark, sf_dir))).where("accepted").select("asset", "m", "end_m", "outcome")


E02_SQL = SPIKE_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """,
ch AS (SELECT asset, m, end_m, outcome, score, delta FROM e2 WHERE (asset, m) IN (SELECT asset, min(m) FROM e2 GROUP BY asset)
  UNION ALL SELECT n.asset, n.m, n.end_m, n.outcome, n.score, n.delta FROM (SELECT ch.asset, (SELECT min(m) FROM e2 WHERE e2.asset = ch.asset AND e2.m >= ch.end_m + 60) AS m FROM ch) x JOIN e2 n ON n.asset = x.asset AND n.m = x.m)"""


@query("e02_event_windows", E02_SQL + " SELECT asset, m AS start_m, end_m, outcome, round(score, 6) AS trigger_score, round(delta, 6) AS trigger_delta FROM ch")
def e02(spark, sf_dir):
    return rounded(events.detect_events(spike_rows(spark, sf_dir)))


@query("e07_event_statistics", E02_SQL + " SELECT outcome, count(*) AS n, round(avg(end_m - m), 4) AS mean_minutes FROM ch GROUP BY outcome")
def e07(spark, sf_dir):
    found = events.detect_events(spike_rows(spark, sf_dir))
    return found.groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.avg(F.col("end_m") - F.col("start_m")), 4).alias("mean_minutes"))


TRADE_SQL = "WITH " + market.BARS_SQL.strip() + touch_sql(1440) + """,
td AS (SELECT asset, h * 60 AS m, atr, close, down_050 AS s, up_100 AS t FROM touch),
tr2 AS (SELECT asset, m, CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN 'stop' WHEN t IS NOT NULL THEN 'target' ELSE 'timeout' END AS reason, CASE WHEN s IS NOT NULL AND (t IS NULL OR s <= t) THEN -0.5 * atr WHEN t IS NOT NULL THEN 1.0 * atr ELSE 0 END - 0.002 * close AS pnl FROM td)"""


def trades(spark, sf_dir):
    return backtest.fixed_trades(labels(spark, sf_dir, 1440), "050", "100")


@query("r04_fixed_trades", TRADE_SQL + " SELECT asset, m, reason, round(pnl, 6) AS pnl FROM tr2")
def r04(spark, sf_dir):
    return rounded(trades(spark, sf_dir).select("asset", "m", "reason", "pnl"))


@query("r08_trade_metrics", TRADE_SQL + """, eq AS (SELECT asset, m, pnl, sum(pnl) OVER (PARTITION BY asset ORDER BY m) AS e FROM tr2), dd AS (SELECT *, max(e) OVER (PARTITION BY asset ORDER BY m) - e AS d FROM eq)
SELECT asset, count(*) AS trades, round(avg(CASE WHEN pnl > 0.01 THEN 1e0 ELSE 0 END), 6) AS win_rate, round(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END), 6) AS profit_factor, round(max(d), 4) AS max_drawdown, round(avg(pnl) / stddev_pop(pnl) * sqrt(252), 6) AS sharpe, round(avg(pnl) / sqrt(avg(power(least(pnl, 0), 2))) * sqrt(252), 6) AS sortino FROM dd GROUP BY asset""")
def r08(spark, sf_dir):
    return rounded(backtest.metrics(trades(spark, sf_dir), ["asset"])).withColumn("max_drawdown", F.round("max_drawdown", 4))


@query("r14_equity_curve", TRADE_SQL + " SELECT asset, d, round(sum(p) OVER (PARTITION BY asset ORDER BY d), 4) AS equity FROM (SELECT asset, m // 1440 AS d, sum(pnl) AS p FROM tr2 GROUP BY 1, 2)")
def r14(spark, sf_dir):
    daily = trades(spark, sf_dir).groupBy("asset", F.floor(F.col("m") / 1440).alias("d")).agg(F.sum("pnl").alias("p"))
    return daily.select("asset", "d", F.round(F.sum("p").over(Window.partitionBy("asset").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)), 4).alias("equity"))


@query("g25_exit_reasons", TRADE_SQL + " SELECT reason, count(*) AS n, CAST(count(*) FILTER (pnl > 0) AS BIGINT) AS wins, round(sum(pnl), 4) AS pnl FROM tr2 GROUP BY reason")
def g25(spark, sf_dir):
    return trades(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), F.round(F.sum("pnl"), 4).alias("pnl"))


@query("r10_executor")
def r10(spark, sf_dir):
    rows = composites(spark, sf_dir).select("asset", (F.col("h") * 60).alias("m"), F.col("close").alias("price"), F.when(F.col("leading") >= 0.3, 1).when(F.col("leading") <= -0.3, -1).otherwise(0).alias("side"))
    return rounded(backtest.execute(rows), 4)


@query("r01_walk_forward", TRAIN_SQL + ", b AS (SELECT min(h) AS lo, max(h) + 1 AS hi FROM trn), w AS (SELECT i AS win, lo + i * 24 AS a, lo + 240 + i * 24 AS c, lo + 264 + i * 24 AS e FROM (SELECT unnest(range(0, greatest(0, (hi - lo - 240) // 24))) AS i, lo FROM b)), f AS (SELECT win, state, count(*) AS n FROM w JOIN trn ON h >= a AND h < c GROUP BY 1, 2), top AS (SELECT win, arg_max(state, (n, state)) AS predicted FROM f GROUP BY win) SELECT w.win, count(*) AS n, round(avg(CASE WHEN t.state = top.predicted THEN 1e0 ELSE 0 END), 6) AS accuracy FROM w JOIN top USING (win) JOIN trn t ON t.h >= w.c AND t.h < w.e GROUP BY w.win")
def r01(spark, sf_dir):
    """Refit per window: the most frequent training state predicts the window's test rows."""
    t = training(spark, sf_dir)
    low, high = t.agg(F.min("h"), F.max("h") + 1).first()
    windows = F.broadcast(backtest.walk_forward(spark, low, high, 240, 24))
    fit = t.join(windows, (F.col("h") >= F.col("train_start")) & (F.col("h") < F.col("train_end"))).groupBy("window", "state").agg(F.count("*").alias("n"))
    top = fit.groupBy("window").agg(F.max_by("state", F.struct("n", "state")).alias("predicted"))
    test = t.join(windows, (F.col("h") >= F.col("train_end")) & (F.col("h") < F.col("test_end"))).join(top, "window")
    return test.groupBy(F.col("window").alias("win")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("state") == F.col("predicted")).cast("double")), 6).alias("accuracy"))


@query("v01_barrier_integrity", TOUCH_48H + " SELECT asset, CAST(count(*) FILTER (up_050 < up_025 OR up_100 < up_075) AS BIGINT) AS not_monotone, CAST(count(*) FILTER (up_100 IS NOT NULL AND max_up < 1) AS BIGINT) AS extremes, CAST(count(*) FILTER (barrier <> 'none' AND hit IS NULL) AS BIGINT) AS unnamed, CAST(count(*) FILTER (atr <= 0) AS BIGINT) AS bad_atr FROM lab GROUP BY asset")
def v01(spark, sf_dir):
    c = F.col
    return labels(spark, sf_dir, 2880).groupBy("asset").agg(F.count_if((c("up_050") < c("up_025")) | (c("up_100") < c("up_075"))).alias("not_monotone"), F.count_if(c("up_100").isNotNull() & (c("max_up") < 1)).alias("extremes"), F.count_if((c("barrier") != "none") & c("hit").isNull()).alias("unnamed"), F.count_if(c("atr") <= 0).alias("bad_atr"))


@query("v02_look_ahead", TOUCH_48H + " SELECT asset, count(*) AS rows_open, CAST(count(*) FILTER (barrier <> 'none') AS BIGINT) AS labelled FROM lab WHERE h + 1 + 48 > (SELECT max(h) FROM lab) GROUP BY asset")
def v02(spark, sf_dir):
    t = labels(spark, sf_dir, 2880)
    return t.crossJoin(F.broadcast(t.agg(F.max("h").alias("now")))).where("h + 1 + 48 > now").groupBy("asset").agg(F.count("*").alias("rows_open"), F.count_if(F.col("barrier") != "none").alias("labelled"))


@query("v03_outcome_distribution", TRAIN_SQL + " SELECT asset, state, round(100e0 * count(*) / sum(count(*)) OVER (PARTITION BY asset), 6) AS pct FROM trn GROUP BY asset, state")
def v03(spark, sf_dir):
    n = training(spark, sf_dir).groupBy("asset", "state").agg(F.count("*").alias("n"))
    return n.select("asset", "state", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("asset")), 6).alias("pct"))


@query("v08_timing_precision", TRAIN_SQL + f", a AS (SELECT {VALUE_SQL('cs')} * {VALUE_SQL('fs')} / 4e0 AS x, state FROM trn), b AS (SELECT CASE WHEN x >= 0.1 THEN 'high' WHEN x <= -0.1 THEN 'low' ELSE 'medium' END AS confidence, state FROM a) SELECT confidence, count(*) AS n, round(avg(CASE WHEN state LIKE 'up%' THEN 1e0 ELSE 0 END), 6) AS win_rate FROM b GROUP BY confidence")
def v08(spark, sf_dir):
    t = training(spark, sf_dir)
    t = t.withColumn("confidence", classify.alignment(t["coincident_state"], t["confirming_state"])["confidence"])
    return t.groupBy("confidence").agg(F.count("*").alias("n"), F.round(F.avg(F.col("state").startswith("up").cast("double")), 6).alias("win_rate"))


@query("n04_formula_signals", "WITH " + market.BARS_SQL.strip() + " , z AS (SELECT asset, h, close, lag(close) OVER w AS p1, lag(close, 5) OVER w AS p5, atr, avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma, count(*) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n FROM atr WINDOW w AS (PARTITION BY asset ORDER BY h)), y AS (SELECT *, CASE WHEN n = 20 THEN ma END AS m20, CASE WHEN lag(n) OVER (PARTITION BY asset ORDER BY h) = 20 THEN lag(ma) OVER (PARTITION BY asset ORDER BY h) END AS m20p FROM z) SELECT asset, h, close > m20 AND p1 <= m20p AS cross_up, close < p5 AND atr > 1 AS diverge, abs(close - m20) <= 0.5 * atr AS zone FROM y")
def n04(spark, sf_dir):
    b = market.bars(spark, sf_dir).withColumn("m20", compile_formula("close.rolling(20).mean()"))
    b = b.withColumn("m20p", compile_formula("m20.shift(1)"))
    return b.select("asset", "h", compile_formula("close > m20 and close.shift(1) <= m20p").alias("cross_up"), compile_formula("close < close.shift(5) and atr > 1").alias("diverge"), compile_formula("abs(close - m20) <= 0.5 * atr").alias("zone"))


def count_sql(test: str, *cols: str) -> str:
    return " + ".join(f"CASE WHEN {c} {test} 0 THEN 1 ELSE 0 END" for c in cols)


@query("k25_concordance_scenario", SIGNAL_SQL + f", n AS (SELECT asset, h, {count_sql('>', 'trend_slow', 'cross_sig', 'trend_fast', 'jump')} AS u, {count_sql('<', 'trend_slow', 'cross_sig', 'trend_fast', 'jump')} AS d FROM sig) SELECT asset, h, CASE WHEN u = 4 OR (u = 3 AND d = 0) THEN 'strong_bullish' WHEN d = 4 OR (d = 3 AND u = 0) THEN 'strong_bearish' WHEN u = 2 AND d = 0 THEN 'moderate_bullish' WHEN d = 2 AND u = 0 THEN 'moderate_bearish' WHEN u > d AND d > 0 THEN 'weak_bullish' WHEN d > u AND u > 0 THEN 'weak_bearish' WHEN u = d AND u > 0 THEN 'conflicted' ELSE 'neutral' END AS scenario FROM n")
def k25(spark, sf_dir):
    s = market.signals(spark, sf_dir)
    return s.select("asset", "h", classify.concordance_scenario(s["trend_slow"], s["cross"], s["trend_fast"], s["jump"]).alias("scenario"))


POSITION_SQL = ORACLES["k32_position_labels"].split(") SELECT asset, h, CASE WHEN ch")[0] + "), q AS (SELECT asset, h, CASE WHEN ch" + ORACLES["k32_position_labels"].split(") SELECT asset, h, CASE WHEN ch")[1] + """), pos AS (SELECT q.*, t.state, CASE WHEN k.x >= 0.8 THEN 'exit_now' WHEN 1 - k.x >= 0.8 THEN 'extend' ELSE 'hold' END AS exit_timing,
CASE WHEN t.state = 'up_strong' THEN 'high' WHEN t.state = 'up_weak' THEN 'medium' ELSE 'low' END AS confidence FROM q JOIN trn t USING (asset, h) JOIN (SELECT asset, h, least(greatest(coalesce((close - lag(close) OVER w) / lag(atr) OVER w / nullif(lag(max_up) OVER w, 0), 0.5), 0), 1) AS x FROM trn WINDOW w AS (PARTITION BY asset ORDER BY h)) k USING (asset, h))"""
#: States of the position nodes.
NODES = {
    "delta": ["weakening", "stable", "strengthening"], "bucket": ["0-1h", "1-4h", "4-12h", "12h+"], "pnl": ["losing", "breakeven", "winning"], "momentum": ["bearish", "neutral", "bullish"],
    "volatility": ["low_vol", "normal", "high_vol"], "exit_timing": ["exit_now", "hold", "extend"], "confidence": ["low", "medium", "high"], "long_label": ["target_hit", "stoploss_hit", "timeout"],
}


def positions(spark, sf_dir):
    by = Window.partitionBy("asset").orderBy("h")
    before = lambda c: F.lag(c).over(by)
    exits = classify.exit_label((F.col("close") - before("close")) / before("atr"), before("max_up"))
    rows = k32(spark, sf_dir).join(training(spark, sf_dir).select("asset", "h", "state", exits.alias("exit_timing")), ["asset", "h"])
    return rows.withColumns({"confidence": classify.confidence_label(F.col("state"), F.lit("long"))})


def grid_sql(parents: list[str], child: str) -> str:
    values = lambda c: "(VALUES " + ", ".join(f"('{s}')" for s in NODES[c]) + f") v_{c}({c})"
    keys, on = ", ".join(parents), " AND ".join(f"x.{p} = g.{p}" for p in parents)
    return f"SELECT {', '.join('g.' + p for p in parents)}, g.{child}, round((coalesce(x.n, 0) + 1e0) / (coalesce(t.n, 0) + {len(NODES[child])}), 6) AS prob FROM (SELECT * FROM {' CROSS JOIN '.join(values(c) for c in [*parents, child])}) g LEFT JOIN (SELECT {keys}, {child}, count(*) AS n FROM pos GROUP BY ALL) x ON {on} AND x.{child} = g.{child} LEFT JOIN (SELECT {keys}, count(*) AS n FROM pos GROUP BY ALL) t ON {on.replace('x.', 't.')}"


def position_cpt(parents: list[str], child: str):
    def run(spark, sf_dir):
        keys = cpt.grid(spark, **{p: NODES[p] for p in parents})
        return rounded(cpt.conditional(positions(spark, sf_dir), parents, child, NODES[child], keys=keys).drop("weight_total"))

    return run


for _name, _parents, _child in (
    ("c08_entry_confidence_cpt", ["delta", "pnl"], "confidence"), ("c10_position_confidence_cpt", ["delta", "momentum", "bucket"], "confidence"), ("c11_momentum_cpt", ["delta", "bucket"], "momentum"),
    ("c12_volatility_cpt", ["delta", "bucket"], "volatility"), ("c13_exit_timing_cpt", ["delta", "bucket", "pnl"], "exit_timing"), ("c14_position_prediction_cpt", ["momentum", "volatility", "exit_timing"], "long_label"),
):
    query(_name, POSITION_SQL + " " + grid_sql(_parents, _child))(position_cpt(_parents, _child))


@query("i08_position_decisions", POSITION_SQL + " SELECT asset, h, CASE WHEN exit_timing = 'exit_now' THEN 'CLOSE' WHEN momentum = 'bearish' AND long_label IN ('stoploss_hit', 'timeout') THEN 'CLOSE' WHEN long_label = 'target_hit' AND momentum <> 'bearish' THEN 'HOLD' WHEN momentum = 'bullish' AND exit_timing = 'extend' THEN 'SCALE_IN' WHEN momentum = 'bearish' AND exit_timing = 'hold' THEN 'SCALE_OUT' ELSE 'HOLD' END AS action, CASE volatility WHEN 'low_vol' THEN 1.2e0 WHEN 'high_vol' THEN 0.5e0 ELSE 1e0 END * CASE WHEN exit_timing <> 'exit_now' AND NOT (momentum = 'bearish' AND long_label IN ('stoploss_hit', 'timeout')) AND NOT (long_label = 'target_hit' AND momentum <> 'bearish') AND (momentum = 'bullish' AND exit_timing = 'extend' OR momentum = 'bearish' AND exit_timing = 'hold') THEN 0.5e0 ELSE 1e0 END AS size FROM pos")
def i08(spark, sf_dir):
    p = positions(spark, sf_dir)
    found = classify.position_decision(p["momentum"], p["volatility"], p["exit_timing"], p["long_label"])
    return rounded(p.select("asset", "h", found["action"].alias("action"), found["size"].alias("size")))


@query("c20_semantic_sanity", CPT_SQL + " SELECT hypothesis, CAST(count(*) AS BIGINT) AS n_keys, CAST(count(*) FILTER (CASE WHEN hypothesis LIKE '%long' THEN u + 0.01 >= d WHEN hypothesis LIKE '%short' THEN d + 0.01 >= u ELSE TRUE END) AS BIGINT) AS sane FROM (SELECT regime, hypothesis, sum(CASE WHEN state LIKE 'up%' THEN prob ELSE 0 END) AS u, sum(CASE WHEN state LIKE 'down%' THEN prob ELSE 0 END) AS d FROM c GROUP BY 1, 2) GROUP BY hypothesis")
def c20(spark, sf_dir):
    mass = lambda side: F.sum(F.when(F.col("state").startswith(side), F.col("prob")).otherwise(0.0))
    k = prediction_cpt(training(spark, sf_dir)).groupBy("regime", "hypothesis").agg(mass("up").alias("u"), mass("down").alias("d"))
    sane = F.when(F.col("hypothesis").endswith("long"), F.col("u") + 0.01 >= F.col("d")).when(F.col("hypothesis").endswith("short"), F.col("d") + 0.01 >= F.col("u")).otherwise(F.lit(True))
    return k.groupBy("hypothesis").agg(F.count("*").alias("n_keys"), F.count_if(sane).alias("sane"))


@query("c23_key_coverage", CPT_SQL + " , g AS (SELECT r.v AS regime, y.v AS hypothesis FROM (VALUES ('full_bullish'), ('bullish_transition'), ('macro_ranging'), ('bearish_transition'), ('full_bearish')) r(v) CROSS JOIN (VALUES ('strong_long'), ('weak_long'), ('no_setup'), ('weak_short'), ('strong_short')) y(v)) SELECT g.regime, g.hypothesis FROM g LEFT JOIN ks USING (regime, hypothesis) WHERE ks.regime IS NULL")
def c23(spark, sf_dir):
    keys = cpt.grid(spark, regime=sorted(set(classify.REDUCED.values())), hypothesis=HYPOTHESES)
    return keys.join(training(spark, sf_dir).select("regime", "hypothesis").distinct(), ["regime", "hypothesis"], "left_anti")


@query("m08_threshold_sensitivity", TRAIN_SQL + " SELECT k / 100e0 AS threshold, count(*) FILTER (abs(leading) >= k / 100e0) AS n, round(avg(CASE WHEN abs(leading) >= k / 100e0 THEN CASE WHEN state LIKE 'up%' THEN 1e0 ELSE 0 END END), 6) AS up_share FROM trn CROSS JOIN (SELECT unnest(range(5, 65, 10)) AS k) GROUP BY k")
def m08(spark, sf_dir):
    t = training(spark, sf_dir).groupBy("leading", F.col("state").startswith("up").cast("double").alias("y")).agg(F.count("*").alias("w"))
    grid = spark.createDataFrame([(k / 100,) for k in range(5, 65, 10)], "threshold double")
    hit = F.abs("leading") >= F.col("threshold")
    g = t.crossJoin(F.broadcast(grid)).groupBy("threshold").agg(F.sum(F.when(hit, F.col("w")).otherwise(0)).alias("n"), F.sum(F.when(hit, F.col("w") * F.col("y"))).alias("up"))
    return rounded(g.select("threshold", "n", F.try_divide("up", F.col("n")).alias("up_share")))


@query("g12_row_mode", SIGNAL_SQL + ", v AS (SELECT asset, h, x, count(*) AS c FROM (SELECT asset, h, unnest([trend_fast, jump, trend_slow, cross_sig]) AS x FROM sig) GROUP BY ALL) SELECT asset, h, CAST(arg_max(x, (c, -x)) AS INTEGER) AS mode FROM v GROUP BY asset, h")
def g12(spark, sf_dir):
    values = F.array("trend_fast", "jump", "trend_slow", "cross")
    votes = F.transform(F.array(*map(F.lit, range(-2, 3))), lambda v: F.struct(F.size(F.filter("_v", lambda x: x == v)).alias("c"), (-v).alias("m")))
    return market.signals(spark, sf_dir).withColumn("_v", values).select("asset", "h", (-F.array_max(votes)["m"]).alias("mode"))
