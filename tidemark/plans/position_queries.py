"""Queries of the position side: chained inference, entry decisions, exits; with DuckDB SQL written apart."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import classify, cpt, evidence, position
from tidemark.sources import io, market

from .market_queries import NODES, STATES, TRAIN_SQL, VALUE_SQL, positions, query, rounded, training

DELTAS = {"dl": "leading", "dc": "coincident", "df": "confirming"}
DELTA_SQL = lambda c: f"CASE WHEN {c} - lag({c}) OVER w >= 0.03 THEN 'strengthening' WHEN {c} - lag({c}) OVER w <= -0.03 THEN 'weakening' ELSE 'stable' END"
POS3_SQL = TRAIN_SQL + f""", lagged AS (SELECT asset, h, state, {", ".join(f"{DELTA_SQL(c)} AS {n}" for n, c in DELTAS.items())}, 60 * (h - lag(h) OVER w) AS mins, close / lag(close) OVER w - 1 AS ch, coalesce(nullif(atr / lag(atr) OVER w, 0), 1) AS vr,
  (close - lag(close) OVER w) / lag(atr) OVER w AS gain, lag(max_up) OVER w AS most FROM trn WINDOW w AS (PARTITION BY asset ORDER BY h)),
pos3 AS (SELECT *, CASE WHEN mins < 60 THEN '0-1h' WHEN mins < 240 THEN '1-4h' WHEN mins < 720 THEN '4-12h' ELSE '12h+' END AS bucket, CASE WHEN gain < -0.25 THEN 'losing' WHEN gain > 0.25 THEN 'winning' ELSE 'breakeven' END AS pnl,
  CASE WHEN ch > 0.005 THEN 'bullish' WHEN ch < -0.005 THEN 'bearish' ELSE 'neutral' END AS momentum, CASE WHEN vr < 0.8 THEN 'low_vol' WHEN vr > 1.2 THEN 'high_vol' ELSE 'normal' END AS volatility,
  CASE WHEN coalesce(gain / nullif(most, 0), 0.5) >= 0.8 THEN 'exit_now' WHEN coalesce(gain / nullif(most, 0), 0.5) <= 1 - 0.8 THEN 'extend' ELSE 'hold' END AS exit_timing,
  CASE WHEN state LIKE 'up%' THEN 'target_hit' WHEN state LIKE 'down%' THEN 'stoploss_hit' ELSE 'timeout' END AS long_label FROM lagged)"""


def best_sql(name: str, parents: dict[str, str], child: str) -> str:
    """Table of the first most probable state per parent key; parents: column to node."""
    values = lambda node: ", ".join(f"('{s}')" for s in NODES[node])
    grid = " CROSS JOIN ".join([*(f"(VALUES {values(n)}) v_{c}({c})" for c, n in parents.items()), "(VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(NODES[child])) + ") x(s, i)"])
    on = lambda t: " AND ".join(f"{t}.{c} = g.{c}" for c in parents)
    keys = ", ".join(parents)
    return f""", {name} AS (SELECT {", ".join(f"g.{c}" for c in parents)}, arg_min(s, (-p, i)) AS best, max(p) AS p FROM (SELECT g.*, (coalesce(x.n, 0) + 1e0) / (coalesce(t.n, 0) + {len(NODES[child])}) AS p FROM (SELECT * FROM {grid}) g
LEFT JOIN (SELECT {keys}, {child} AS s, count(*) AS n FROM pos3 GROUP BY ALL) x ON {on("x")} AND x.s = g.s LEFT JOIN (SELECT {keys}, count(*) AS n FROM pos3 GROUP BY ALL) t ON {on("t")}) g GROUP BY {", ".join(f"g.{c}" for c in parents)})"""


PARENTS = {"momentum": {"dl": "delta", "bucket": "bucket"}, "volatility": {"dc": "delta", "bucket": "bucket"}, "exit_timing": {"df": "delta", "bucket": "bucket", "pnl": "pnl"}, "long_label": {"momentum": "momentum", "volatility": "volatility", "exit_timing": "exit_timing"}}
CHAIN_SQL = POS3_SQL + "".join(best_sql(f"b{i}", p, c) for i, (c, p) in enumerate(PARENTS.items())) + """,
chain AS (SELECT q.asset, q.h, b0.best AS momentum, b1.best AS volatility, b2.best AS exit_timing FROM pos3 q JOIN b0 USING (dl, bucket) JOIN b1 USING (dc, bucket) JOIN b2 USING (df, bucket, pnl)),
inferred AS (SELECT c.*, b3.best AS prediction, b3.p, CASE WHEN b3.p >= 0.5 THEN 'high' WHEN b3.p >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM chain c JOIN b3 USING (momentum, volatility, exit_timing))"""


def lagged(spark, sf_dir):
    """training() with the states of three deltas, time and profit since the bar before, and its labels."""
    by = Window.partitionBy("asset").orderBy("h")
    before = lambda c: F.lag(c).over(by)
    gain = (F.col("close") - before("close")) / before("atr")
    return training(spark, sf_dir).select(
        "asset", "h", "state", *(classify.delta_state(F.col(c) - before(c), 0.03).alias(n) for n, c in DELTAS.items()), classify.time_bucket(60 * (F.col("h") - before("h"))).alias("bucket"),
        classify.pnl_bucket(F.coalesce(gain, F.lit(0.0))).alias("pnl"), classify.momentum_label(F.col("close") / before("close") - 1).alias("momentum"), classify.volatility_label(F.col("atr") / before("atr")).alias("volatility"),
        classify.exit_label(gain, before("max_up")).alias("exit_timing"), classify.direction_label(F.col("state"), F.lit("long")).alias("long_label"),
    )


def inferred(spark, sf_dir):
    rows = io.staged(lagged(spark, sf_dir))
    tables = [(c, cpt.conditional(rows, list(p), c, NODES[c], keys=cpt.grid(spark, **{k: NODES[n] for k, n in p.items()})), list(p), NODES[c]) for c, p in PARENTS.items()]
    return position.infer_position(rows.select("asset", "h", *DELTAS, "bucket", "pnl"), tables).withColumnRenamed("long_label", "prediction")


@query("i03_position_inference", CHAIN_SQL + " SELECT asset, h, momentum, volatility, exit_timing, prediction, confidence, round(p, 6) AS confidence_prob FROM inferred")
def i03(spark, sf_dir):
    return rounded(inferred(spark, sf_dir).select("asset", "h", "momentum", "volatility", "exit_timing", "prediction", "confidence", "confidence_prob"))


@query("i04_dual_inference", CHAIN_SQL + ", nw AS (SELECT asset, max(h) AS h FROM trn GROUP BY asset) SELECT t.asset, t.h, t.regime, t.hypothesis, i.prediction, i.confidence FROM trn t JOIN nw USING (asset, h) JOIN inferred i USING (asset, h)")
def i04(spark, sf_dir):
    newest = training(spark, sf_dir).groupBy("asset").agg(F.max_by(F.struct("h", "regime", "hypothesis"), "h").alias("x")).select("asset", "x.*")
    return newest.join(inferred(spark, sf_dir).select("asset", "h", "prediction", "confidence"), ["asset", "h"])


@query("k33_exit_fallback", TRAIN_SQL + ", z AS (SELECT asset, h, state, coalesce(hit, 0) * 3 AS mins FROM trn) SELECT asset, h, CASE WHEN mins > 720 AND (state LIKE '%weak%' OR state = 'timeout') THEN 'exit_now' WHEN mins < 240 AND state LIKE '%strong%' THEN 'extend' ELSE 'hold' END AS label FROM z")
def k33(spark, sf_dir):
    return training(spark, sf_dir).select("asset", "h", position.exit_label_from_outcome(F.col("state"), F.col("hit") * 3).alias("label"))


@query("y41_exit_label", POS3_SQL + " SELECT asset, h, exit_timing FROM pos3")
def y41(spark, sf_dir):
    return lagged(spark, sf_dir).select("asset", "h", "exit_timing")


@query("k37_pnl_in_atr", TRAIN_SQL + " SELECT asset, h, round(coalesce((lead(close) OVER w / close - 1) * close / atr, 0), 6) AS pnl FROM trn WINDOW w AS (PARTITION BY asset ORDER BY h)")
def k37(spark, sf_dir):
    after = F.lead("close").over(Window.partitionBy("asset").orderBy("h"))
    return rounded(training(spark, sf_dir).select("asset", "h", position.pnl_in_atr(after / F.col("close") - 1, F.col("close"), F.col("atr")).alias("pnl")))


FOUR = ("trend_slow", "cross", "trend_fast", "jump")


@query("k38_evidence_strength", "WITH " + market.SIGNALS_SQL.strip() + ", u AS (SELECT asset, h, unnest([trend_slow, cross_sig, trend_fast, jump]) AS x FROM sig) SELECT asset, h, round(((1 - stddev_pop(x) / 2) + abs(avg(x)) / 2) / 2, 6) AS strength FROM u GROUP BY asset, h")
def k38(spark, sf_dir):
    return rounded(market.signals(spark, sf_dir).select("asset", "h", evidence.evidence_strength(*map(F.col, FOUR)).alias("strength")))


@query("k39_weighted_vote", TRAIN_SQL + ", v AS (SELECT asset, h // 24 AS d, ls, sum(round(abs(leading), 6)) AS w FROM trn GROUP BY ALL), t AS (SELECT asset, d, arg_min(ls, (-round(w, 9), ls)) AS winner, sum(w) AS n, max(w) AS m FROM v GROUP BY ALL) SELECT asset, d, winner, round(m / n, 5) AS share FROM t WHERE n > 0")
def k39(spark, sf_dir):
    t = training(spark, sf_dir).select("asset", F.floor(F.col("h") / 24).alias("d"), "leading_state", F.round(F.abs("leading"), 6).cast("decimal(18,6)").alias("c"))
    found = evidence.weighted_vote(t.where("c > 0"), ["asset", "d"], "leading_state", "c")
    return found.select("asset", "d", "winner", F.round(F.col("share").cast("double"), 5).alias("share"))


@query("r03_entry_decision", TRAIN_SQL + " SELECT asset, h, CASE WHEN hypothesis LIKE 'strong%' AND regime IN ('full_bullish', 'full_bearish') THEN split_part(hypothesis, '_', 2) END AS strict_side, CASE WHEN hypothesis <> 'no_setup' THEN split_part(hypothesis, '_', 2) END AS side FROM trn")
def r03(spark, sf_dir):
    t = training(spark, sf_dir)
    strict = position.entry_decision(t["hypothesis"], t["regime"], True, ("full_bullish", "full_bearish"))
    return t.select("asset", "h", strict.alias("strict_side"), position.entry_decision(t["hypothesis"], t["regime"]).alias("side"))


EXITS_SQL = TRAIN_SQL + """, trd AS (SELECT asset || '|' || h AS id, asset, h, h * 60 + 59 AS m, split_part(hypothesis, '_', 2) AS side, close AS entry, CASE WHEN hypothesis LIKE '%long' THEN close - atr ELSE close + atr END AS stop, CASE WHEN hypothesis LIKE '%long' THEN close + 1.5 * atr ELSE close - 1.5 * atr END AS target FROM trn WHERE hypothesis <> 'no_setup'),
mn AS (SELECT asset, m AS t, max(value) AS high, min(value) AS low FROM ev GROUP BY 1, 2),
wk AS (SELECT trd.*, t, high, low, CASE side WHEN 'long' THEN high - entry ELSE entry - low END AS up, CASE side WHEN 'long' THEN low - entry ELSE entry - high END AS down, CASE side WHEN 'long' THEN low <= stop ELSE high >= stop END AS hs, CASE side WHEN 'long' THEN high >= target ELSE low <= target END AS ht FROM trd JOIN mn ON mn.asset = trd.asset AND t > m AND t <= m + 1440),
ac AS (SELECT *, min(CASE WHEN up / entry >= 0.05 THEN t END) OVER (PARTITION BY id) AS act FROM wk),
pk AS (SELECT *, max(CASE WHEN t >= act THEN up END) OVER (PARTITION BY id ORDER BY t) * 0.5 AS lev FROM ac),
rs AS (SELECT *, CASE WHEN hs THEN 'stop_loss' WHEN t > act AND down <= lev THEN 'trailing_stop' WHEN ht THEN 'take_profit' END AS why FROM pk),
fi AS (SELECT *, min(CASE WHEN why IS NOT NULL THEN t END) OVER (PARTITION BY id) AS ex FROM rs),
ib AS (SELECT id, any_value(asset) AS asset, any_value(h) AS h, any_value(side) AS side, any_value(entry) AS entry, any_value(ex) AS exit_m, max(CASE WHEN t = ex THEN why END) AS reason, max(CASE WHEN t = ex THEN CASE why WHEN 'stop_loss' THEN stop WHEN 'take_profit' THEN target ELSE CASE side WHEN 'long' THEN entry + lev ELSE entry - lev END END END) AS price, max(high) FILTER (ex IS NULL OR t <= ex) AS hi, min(low) FILTER (ex IS NULL OR t <= ex) AS lo FROM fi GROUP BY id),
al AS (SELECT trd.id, trd.asset, trd.h, trd.side, trd.entry, ib.exit_m, ib.reason, ib.price, hi, lo FROM trd LEFT JOIN ib USING (id))"""


def trades(spark, sf_dir):
    t = training(spark, sf_dir).where("hypothesis <> 'no_setup'")
    side = position.entry_decision(t["hypothesis"], t["regime"])
    sign = F.when(side == "long", 1.0).otherwise(-1.0)
    return t.select(F.concat_ws("|", "asset", "h").alias("id"), "asset", (F.col("h") * 60 + 59).alias("m"), side.alias("side"), F.col("close").alias("entry"), (F.col("close") - sign * F.col("atr")).alias("stop"), (F.col("close") + sign * 1.5 * F.col("atr")).alias("target"))


def bar_exits(spark, sf_dir):
    path = market.minutes(spark, sf_dir).groupBy("asset", "m").agg(F.max("value").alias("high"), F.min("value").alias("low"))
    return position.exits_inside_bars(trades(spark, sf_dir), path, 24, 0.05, 0.5)


@query("r06_intrabar_exits", EXITS_SQL + " SELECT id, CAST(exit_m AS BIGINT) AS exit_m, reason, round(price, 6) AS exit_price FROM al")
def r06(spark, sf_dir):
    return rounded(bar_exits(spark, sf_dir).select("id", "exit_m", "reason", "exit_price"))


@query("r09_excursions", EXITS_SQL + ", ex AS (SELECT asset, side, greatest(0, CASE side WHEN 'long' THEN (entry - lo) / entry ELSE (hi - entry) / entry END) AS mae, greatest(0, CASE side WHEN 'long' THEN (hi - entry) / entry ELSE (entry - lo) / entry END) AS mfe FROM al WHERE hi IS NOT NULL) SELECT asset, side, count(*) AS n, round(avg(mae), 6) AS mean_mae, round(max(mae), 6) AS max_mae, round(avg(mfe), 6) AS mean_mfe, round(max(mfe), 6) AS max_mfe FROM ex GROUP BY asset, side")
def r09(spark, sf_dir):
    t = bar_exits(spark, sf_dir).where("highest is not null")
    found = position.excursions(t)
    t = t.select("asset", "side", *(v.alias(k) for k, v in found.items()))
    return rounded(t.groupBy("asset", "side").agg(F.count("*").alias("n"), *(f(c).alias(f"{n}_{c}") for c in ("mae", "mfe") for f, n in ((F.avg, "mean"), (F.max, "max")))))


CASCADE_SQL = EXITS_SQL + "," + POS3_SQL[len(TRAIN_SQL) + 1 :] + """,
sg AS (SELECT p.asset, p.h, t.close, p.exit_timing, p.momentum, CASE WHEN p.state LIKE '%strong' THEN p.long_label END AS prediction FROM pos3 p JOIN trn t USING (asset, h)),
wy AS (SELECT al.id, sg.h, sg.close, CASE WHEN sg.h >= al.h + 24 THEN 'timeout' WHEN exit_timing = 'exit_now' THEN 'exit_signal' WHEN (side = 'long' AND momentum = 'bearish') OR (side = 'short' AND momentum = 'bullish') THEN 'momentum_reversal' WHEN prediction IN ('stoploss_hit', 'timeout') THEN 'position_prediction_' || prediction END AS why FROM al JOIN sg ON sg.asset = al.asset AND sg.h > al.h AND sg.h <= al.h + 24),
fs AS (SELECT id, arg_min(why, h) AS why, arg_min(close, h) AS close, min(h) AS h FROM wy WHERE why IS NOT NULL GROUP BY id),
cs2 AS (SELECT al.id, al.asset, al.side, al.entry, CASE WHEN fs.id IS NOT NULL AND (al.exit_m IS NULL OR fs.h <= al.exit_m // 60) THEN fs.why ELSE al.reason END AS reason, CASE WHEN fs.id IS NOT NULL AND (al.exit_m IS NULL OR fs.h <= al.exit_m // 60) THEN fs.h * 60 + 59 ELSE al.exit_m END AS exit_m, CASE WHEN fs.id IS NOT NULL AND (al.exit_m IS NULL OR fs.h <= al.exit_m // 60) THEN fs.close ELSE al.price END AS price FROM al LEFT JOIN fs USING (id))"""


def cascaded(spark, sf_dir):
    rows = lagged(spark, sf_dir).select("asset", "h", "exit_timing", "momentum", F.when(F.col("state").endswith("strong"), F.col("long_label")).alias("prediction"))
    signals = rows.join(market.bars(spark, sf_dir).select("asset", "h", "close"), ["asset", "h"])
    return position.exit_cascade(bar_exits(spark, sf_dir), signals, 24)


@query("r05_exit_cascade", CASCADE_SQL + " SELECT id, CAST(exit_m AS BIGINT) AS exit_m, reason, round(price, 6) AS exit_price FROM cs2")
def r05(spark, sf_dir):
    return rounded(cascaded(spark, sf_dir).select("id", "exit_m", "reason", "exit_price"))


@query("r07_closed_trades", CASCADE_SQL + " SELECT asset, side, reason, count(*) AS n, round(avg(CASE side WHEN 'long' THEN price / entry - 1 ELSE 1 - price / entry END - 0.0011), 6) AS mean_net FROM cs2 WHERE reason IS NOT NULL GROUP BY ALL")
def r07(spark, sf_dir):
    t = cascaded(spark, sf_dir).where("reason is not null")
    gross = F.when(F.col("side") == "long", F.col("exit_price") / F.col("entry") - 1).otherwise(1 - F.col("exit_price") / F.col("entry"))
    return rounded(t.groupBy("asset", "side", "reason").agg(F.count("*").alias("n"), F.avg(gross - 0.0011).alias("mean_net")))


REFINE_SQL = TRAIN_SQL + f""", al AS (SELECT cs, fs, state, CASE WHEN {VALUE_SQL('cs')} * {VALUE_SQL('fs')} / 4e0 >= 0.1 THEN 'high' WHEN {VALUE_SQL('cs')} * {VALUE_SQL('fs')} / 4e0 <= -0.1 THEN 'low' ELSE 'medium' END AS conf FROM trn),
gr AS (SELECT cs, fs, any_value(conf) AS conf, count(*) AS n, avg(CASE WHEN state LIKE 'up%' THEN 1e0 ELSE 0 END) AS wr FROM al GROUP BY cs, fs),
pd AS (SELECT *, CASE WHEN conf = 'high' THEN (n + 1e0) / (n + 3) ELSE 1e0 / (n + 3) END AS ph, CASE WHEN conf = 'medium' THEN (n + 1e0) / (n + 3) ELSE 1e0 / (n + 3) END AS pm, CASE WHEN conf = 'low' THEN (n + 1e0) / (n + 3) ELSE 1e0 / (n + 3) END AS pl FROM gr),
mv AS (SELECT *, CASE WHEN n >= 30 AND conf = 'high' AND wr < 0.55 THEN least(0.15, ph / 2) ELSE 0 END AS a, CASE WHEN n >= 30 AND conf = 'medium' AND wr > 0.58 THEN least(0.15, pm / 2) ELSE 0 END AS b, CASE WHEN n >= 30 AND conf = 'low' AND wr > 0.55 THEN least(0.15, pl / 2) ELSE 0 END AS c FROM pd)"""


@query("c09_refined_confidence", REFINE_SQL + " SELECT cs AS coincident, fs AS confirming, n, round(ph - a + b, 6) AS high, round(pm + a - b + c, 6) AS medium, round(pl - c, 6) AS low FROM mv")
def c09(spark, sf_dir):
    t = training(spark, sf_dir)
    t = t.withColumn("conf", classify.alignment(t["coincident_state"], t["confirming_state"])["confidence"])
    keys = ["coincident_state", "confirming_state"]
    g = t.groupBy(*keys).agg(F.first("conf").alias("derived"), F.count("*").alias("n"), F.avg(F.col("state").startswith("up").cast("double")).alias("wr"))
    p = {s: (F.when(F.col("derived") == s, F.col("n")).otherwise(0) + 1.0) / (F.col("n") + 3) for s in ("high", "medium", "low")}
    new = evidence.shifted(p["high"], p["medium"], p["low"], F.col("derived"), F.when(F.col("n") >= 30, F.col("wr")))
    return rounded(g.select(F.col(keys[0]).alias("coincident"), F.col(keys[1]).alias("confirming"), "n", *(v.alias(k) for k, v in new.items())))


@query("y27_confidence_stability", REFINE_SQL + f", z AS (SELECT {VALUE_SQL('cs')} * {VALUE_SQL('fs')} / 4e0 AS x FROM trn) SELECT conf AS confidence, count(*) AS n, round(1 - (SELECT stddev_pop(x) FROM z), 6) AS stability FROM al GROUP BY conf")
def y27(spark, sf_dir):
    t = training(spark, sf_dir)
    found = classify.alignment(t["coincident_state"], t["confirming_state"])
    t = t.select(found["alignment"].alias("x"), found["confidence"].alias("confidence"))
    return rounded(t.groupBy("confidence").agg(F.count("*").alias("n")).crossJoin(F.broadcast(t.agg((1 - F.stddev_pop("x")).alias("stability")))))


@query("c03_regime_prior", TRAIN_SQL + " , g AS (SELECT v AS regime FROM (VALUES ('full_bullish'), ('bullish_transition'), ('macro_ranging'), ('bearish_transition'), ('full_bearish')) x(v)), n AS (SELECT g.regime, count(t.regime) * CASE WHEN g.regime LIKE '%ranging%' THEN 0.5e0 ELSE 1e0 END AS w FROM g LEFT JOIN trn t USING (regime) GROUP BY g.regime) SELECT regime, round((w + 1) / ((SELECT sum(w) FROM n) + 5), 6) AS prob FROM n")
def c03(spark, sf_dir):
    states = ["full_bullish", "bullish_transition", "macro_ranging", "bearish_transition", "full_bearish"]
    weight = F.when(F.col("regime").contains("ranging") | F.col("regime").contains("neutral"), 0.5).otherwise(1.0)
    return rounded(cpt.prior(training(spark, sf_dir), "regime", states, weight))


@query("c04_composite_cpt", TRAIN_SQL + ", g AS (SELECT r.regime, s.s FROM (SELECT DISTINCT regime FROM trn) r CROSS JOIN (VALUES ('strong_bullish'), ('bullish'), ('neutral'), ('bearish'), ('strong_bearish')) s(s)) SELECT g.regime, g.s AS leading_state, round((count(t.ls) + 1e0) / (sum(count(t.ls)) OVER (PARTITION BY g.regime) + 5), 6) AS prob FROM g LEFT JOIN trn t ON t.regime = g.regime AND t.ls = g.s GROUP BY g.regime, g.s")
def c04(spark, sf_dir):
    return rounded(cpt.conditional(training(spark, sf_dir), ["regime"], "leading_state", list(classify.HYPOTHESES)).drop("weight_total"))


@query("c17_majority_vote_cpt", TRAIN_SQL + f", v AS (SELECT asset, h, state, x, count(*) AS c FROM (SELECT asset, h, state, unnest([trend_fast, jump, trend_slow, cross_sig]) AS x FROM trn) GROUP BY ALL), m AS (SELECT asset, h, any_value(state) AS state, CAST(arg_max(x, (c, -x)) AS INTEGER) AS vote FROM v GROUP BY asset, h) SELECT g.vote, g.state, round((count(m.state) + 1e0) / (sum(count(m.state)) OVER (PARTITION BY g.vote) + 5), 6) AS prob FROM (SELECT DISTINCT m.vote, s.state FROM m CROSS JOIN (VALUES {', '.join(f"('{s}')" for s in STATES)}) s(state)) g LEFT JOIN m ON m.vote = g.vote AND m.state = g.state GROUP BY g.vote, g.state")
def c17(spark, sf_dir):
    from .market_queries import g12

    rows = g12(spark, sf_dir).withColumnRenamed("mode", "vote").join(training(spark, sf_dir).select("asset", "h", "state"), ["asset", "h"])
    return rounded(cpt.conditional(rows, ["vote"], "state", STATES).drop("weight_total"))
