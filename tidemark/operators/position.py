"""Position side of a trade: labels, chained table lookups, entry decisions, exits inside bars and the exit cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cpt import lookup


def exit_label_from_outcome(outcome: Column, minutes: Column) -> Column:
    """extend for a strong outcome before 240 minutes, exit_now for a weak one or a timeout after 720, else hold; nulls count as 0 and neutral."""
    m, o = F.coalesce(minutes, F.lit(0)), F.coalesce(outcome, F.lit("neutral"))
    late = (m > 720) & (o.contains("weak") | (o == "timeout"))
    return F.when(late, "exit_now").when((m < 240) & o.contains("strong"), "extend").otherwise("hold")


def pnl_in_atr(ret: Column, entry_close: Column, entry_atr: Column) -> Column:
    """Return times entry price over entry ATR; 0 where that is no number."""
    x = F.try_divide(ret * entry_close, entry_atr)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def first_largest(states: list[str], prefix: str) -> Column:
    """State with the largest probability in columns prefix + state; the first of equals."""
    best = F.greatest(*(F.col(prefix + s) for s in states))
    return reduce(lambda c, s: c.when(F.col(prefix + s) == best, s), states, F.when(F.lit(False), ""))


def infer_position(rows: DataFrame, steps: list[tuple[str, DataFrame, list[str], list[str]]]) -> DataFrame:
    """rows with a prediction per step (name, table, parents, states), each of which can be a parent of the next; the last one's
    largest probability gives confidence: high from 0.5, medium from 0.4, else low. Keys without a row count as uniform."""
    for name, table, parents, states in steps:
        uniform = {f"p_{s}": 1.0 / len(states) for s in states}
        rows = lookup(rows, table, parents, name, states).fillna(uniform)
        rows = rows.withColumns({name: first_largest(states, "p_"), "_most": F.greatest(*(F.col(f"p_{s}") for s in states))}).drop(*uniform)
    most = F.col("_most")
    return rows.withColumns({"confidence": F.when(most >= 0.5, "high").when(most >= 0.4, "medium").otherwise("low"), "confidence_prob": most}).drop("_most")


def entry_decision(hypothesis: Column, regime: Column, strong_only: bool = False, regimes: tuple[str, ...] = ()) -> Column:
    """long, short or null from a hypothesis such as weak_long; weak ones do not count with strong_only, other regimes than those given never."""
    h = F.lower(hypothesis)
    side = F.regexp_extract(h, "^(weak|strong)_(long|short)$", 2)
    ok = (side != "") & (~h.startswith("weak") if strong_only else F.lit(True)) & (F.lower(regime).isin(*regimes) if regimes else F.lit(True))
    return F.when(ok, side)


def exits_inside_bars(trades: DataFrame, path: DataFrame, hours: int, activation: float | None = None, trail: float = 0.5) -> DataFrame:
    """trades (id, asset, m, side, entry, stop, target) with exit_m, exit_price and reason of the first minute that touches a level within
    `hours`; the stop counts before the trailing stop, and that before the target. best and worst: highest and lowest price until then.

    path: (asset, m, high, low), a row per minute. The trailing stop starts once the price has gained `activation` (a share) and from the next minute on stands at the entry plus
    1 - trail of the best gain since. Trades meet the path by asset and day, so a hot asset spreads over its days."""
    long_ = F.col("side") == "long"
    day = lambda m: F.floor(m / 1440)
    spread = trades.withColumn("day", F.explode(F.sequence(day(F.col("m") + 1), day(F.col("m") + hours * 60))))
    walk = spread.join(path.withColumnRenamed("m", "t").withColumn("day", day(F.col("t"))), ["asset", "day"])
    walk = walk.where((F.col("t") > F.col("m")) & (F.col("t") <= F.col("m") + hours * 60))
    by = Window.partitionBy("id").orderBy("t")
    # Favourable and adverse extremes of a minute, as gains over the entry.
    sign = F.when(long_, 1.0).otherwise(-1.0)
    walk = walk.withColumns({"good": F.when(long_, F.col("high")).otherwise(F.col("low")), "bad": F.when(long_, F.col("low")).otherwise(F.col("high"))})
    gain = lambda c: sign * (F.col(c) - F.col("entry"))
    walk = walk.withColumns({"up": gain("good"), "down": gain("bad")})
    hit_stop = F.when(long_, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    hit_target = F.when(long_, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    level = F.lit(None).cast("double")
    if activation is not None:
        walk = walk.withColumn("on", F.max((F.col("up") / F.col("entry") >= activation).cast("int")).over(by))
        walk = walk.withColumn("peak", F.max(F.when(F.col("on") == 1, F.col("up"))).over(by))
        level = F.when(F.lag("on").over(by) == 1, F.col("peak") * (1 - trail))
    walk = walk.withColumn("level", level)
    reason = F.when(hit_stop, "stop_loss").when(F.col("down") <= F.col("level"), "trailing_stop").when(hit_target, "take_profit")
    walk = walk.withColumn("reason", reason)
    walk = walk.withColumn("open_until", F.min(F.when(F.col("reason").isNotNull(), F.col("t"))).over(Window.partitionBy("id")))
    walk = walk.where(F.col("open_until").isNull() | (F.col("t") <= F.col("open_until")))
    price = F.when(F.col("reason") == "stop_loss", F.col("stop")).when(F.col("reason") == "take_profit", F.col("target")).otherwise(F.col("entry") + sign * F.col("level"))
    at = F.when(F.col("reason").isNotNull(), F.struct("t", price.alias("price"), "reason"))
    found = walk.groupBy("id").agg(F.min(at).alias("x"), F.max("high").alias("highest"), F.min("low").alias("lowest"))
    out = trades.join(found, "id", "left")
    return out.select(*trades.columns, F.col("x.t").alias("exit_m"), F.col("x.price").alias("exit_price"), F.col("x.reason").alias("reason"), "highest", "lowest")


def exit_cascade(trades: DataFrame, signals: DataFrame, hours: int) -> DataFrame:
    """trades of exits_inside_bars() with the exit that comes first hour by hour: at the end of each hour the timeout, then exit_now, momentum
    against the side, an unfavourable prediction, and only then what was touched within that hour.

    signals: (asset, h, close, exit_timing, momentum, prediction); hour h holds the minutes 60 h to 60 h + 59 and ends with its close."""
    against = ((F.col("side") == "long") & (F.col("momentum") == "bearish")) | ((F.col("side") == "short") & (F.col("momentum") == "bullish"))
    why = F.when(F.col("h") >= F.col("entry_h") + hours, "timeout").when(F.col("exit_timing") == "exit_now", "exit_signal").when(against, "momentum_reversal").when(F.col("prediction").isin("stoploss_hit", "timeout"), F.concat(F.lit("position_prediction_"), F.col("prediction")))
    asked = trades.withColumn("entry_h", F.floor(F.col("m") / 60)).withColumn("h", F.explode(F.sequence(F.col("entry_h") + 1, F.col("entry_h") + hours)))
    met = asked.join(signals, ["asset", "h"]).withColumn("why", why).where("why is not null")
    first = met.groupBy("id").agg(F.min(F.struct("h", "why", "close")).alias("s"))
    out = trades.join(first, "id", "left")
    signal = F.col("s").isNotNull() & (F.col("exit_m").isNull() | (F.col("s.h") <= F.floor(F.col("exit_m") / 60)))
    return out.select(
        "id", "asset", "m", "side", "entry", F.when(signal, F.col("s.h") * 60 + 59).otherwise(F.col("exit_m")).alias("exit_m"), F.when(signal, F.col("s.close")).otherwise(F.col("exit_price")).alias("exit_price"),
        F.when(signal, F.col("s.why")).otherwise(F.col("reason")).alias("reason"),
    )


def excursions(trades: DataFrame) -> dict[str, Column]:
    """Largest adverse and favourable move of a trade as shares of the entry price, neither below 0."""
    long_, entry = F.col("side") == "long", F.col("entry")
    up, down = (F.col("highest") - entry) / entry, (entry - F.col("lowest")) / entry
    return {"mae": F.greatest(F.lit(0.0), F.when(long_, down).otherwise(up)), "mfe": F.greatest(F.lit(0.0), F.when(long_, up).otherwise(down))}
