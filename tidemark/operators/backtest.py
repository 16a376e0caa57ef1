"""Walk-forward windows, trades with fixed exits, portfolio metrics and an all-in executor."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def walk_forward(spark: SparkSession, start: int, end: int, train: int, test: int) -> DataFrame:
    """(window, train_start, train_end, test_end): sliding windows of whole test steps inside [start, end); bounds are half-open."""
    n = max(0, (end - start - train) // test)
    return spark.range(n).select(F.col("id").alias("window"), (F.lit(start) + F.col("id") * test).alias("train_start"), (F.lit(start + train) + F.col("id") * test).alias("train_end"), (F.lit(start + train + test) + F.col("id") * test).alias("test_end"))


def fixed_trades(entries: DataFrame, stop: str, target: str, fee: float = 0.001) -> DataFrame:
    """entries (ref, atr, first-touch columns) as long trades that leave at the stop (checked first) or the target level; levels
    are keys such as 075. Null times on both sides leave flat at the timeout."""
    k, q = int(target) / 100, int(stop) / 100
    t, s = F.col(f"up_{target}"), F.col(f"down_{stop}")
    out = F.when(s.isNotNull() & (t.isNull() | (s <= t)), "stop").when(t.isNotNull(), "target").otherwise("timeout")
    gain = F.when(F.col("reason") == "stop", -q * F.col("atr")).when(F.col("reason") == "target", k * F.col("atr")).otherwise(0.0)
    r = entries.withColumn("reason", out)
    return r.withColumns({"pnl": gain - 2 * fee * F.col("ref"), "minutes": F.when(F.col("reason") == "stop", s).when(F.col("reason") == "target", t)})


def metrics(trades: DataFrame, by: list[str], pnl: str = "pnl", order: str = "m", band: float = 0.01) -> DataFrame:
    """Trades, win rate, profit factor, largest drawdown, Sharpe and Sortino ratio (population deviation, sqrt 252)."""
    run = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("_equity", F.sum(pnl).over(run)).withColumn("_down", F.max("_equity").over(run) - F.col("_equity"))
    gains, losses = F.sum(F.when(F.col(pnl) > 0, F.col(pnl)).otherwise(0.0)), F.sum(F.when(F.col(pnl) < 0, -F.col(pnl)).otherwise(0.0))
    year = math.sqrt(252)
    downside = F.sqrt(F.avg(F.pow(F.least(F.col(pnl), F.lit(0.0)), 2)))
    return t.groupBy(*by).agg(
        F.count("*").alias("trades"), F.avg(F.when(F.col(pnl) > band, 1.0).otherwise(0.0)).alias("win_rate"), F.when(losses > 0, gains / losses).alias("profit_factor"), F.max("_down").alias("max_drawdown"),
        F.when(F.stddev_pop(pnl) > 0, F.avg(pnl) / F.stddev_pop(pnl) * year).alias("sharpe"), F.when(downside > 0, F.avg(pnl) / downside * year).alias("sortino"),
    )


def execute(signals: DataFrame, stop: float = 0.05, target: float = 0.10, fee: float = 0.0005, capital: float = 10_000.0) -> DataFrame:
    """(asset, m, equity, position): all-in executor with reversal; each row (asset, m, price, side -1/0/1) first meets stop and
    target, then the signal. Path dependent, so one sequential scan per asset."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cash, side, entry, size, out = capital, 0, 0.0, 0.0, []
        for r in pdf.sort_values("m").itertuples(index=False):
            if side:
                move = side * (r.price - entry) / entry
                if move <= -stop or move >= target or (r.side and r.side != side):
                    move = max(-stop, min(target, move))
                    cash += size * entry * move - fee * size * r.price
                    side, size = 0, 0.0
            if r.side and not side and r.price > 0 and cash > 0:
                side, entry, size = int(r.side), r.price, cash * (1 - fee) / r.price
                cash -= fee * cash
            out.append((r.asset, r.m, cash + (size * entry * side * (r.price - entry) / entry if side else 0.0), side))
        return pd.DataFrame(out, columns=["asset", "m", "equity", "position"])

    return signals.groupBy("asset").applyInPandas(run, "asset string, m long, equity double, position int")
