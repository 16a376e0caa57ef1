"""Market view over event streams: hourly bars, ATR and class signals of each asset. Hours and minutes count from 1970 (UTC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Signal -> (class, polarity, weight).
SIGNALS = {
    "trend_fast": ("leading", 1, 1.5), "jump": ("leading", 1, 1.0), "trend_slow": ("coincident", 1, 1.2), "range_place": ("coincident", 1, 0.8),
    "cross": ("confirming", 1, 1.0), "expansion": ("confirming", -1, 0.5),
}

#: The same view for DuckDB; queries append to this chain.
BARS_SQL = """
ev AS (SELECT event_type AS asset, CAST(floor(epoch(ts) / 60) AS BIGINT) AS m, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, epoch(ts) AS s, event_id, value FROM events),
bars AS (SELECT asset, h, arg_min(value, (s, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (s, event_id)) AS close FROM ev GROUP BY asset, h),
tr AS (SELECT *, lag(close) OVER w AS prev, row_number() OVER w AS rn, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM bars WINDOW w AS (PARTITION BY asset ORDER BY h)),
ind AS (SELECT asset, h, open, high, low, close, prev, avg(tr) OVER (PARTITION BY asset ORDER BY h ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr, rn FROM tr),
atr AS (SELECT * FROM ind WHERE rn >= 14 AND atr > 0)"""

SIGNALS_SQL = BARS_SQL + """,
roll AS (SELECT *, avg(close) OVER (PARTITION BY asset ORDER BY h ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ma5, avg(close) OVER (PARTITION BY asset ORDER BY h ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma20,
  max(high) OVER (PARTITION BY asset ORDER BY h ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS hi10, min(low) OVER (PARTITION BY asset ORDER BY h ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS lo10 FROM atr),
raw AS (SELECT asset, h, close, atr, (close - ma5) / atr AS trend_fast, (close - coalesce(prev, close)) / atr AS jump, (close - ma20) / atr AS trend_slow, CASE WHEN hi10 > lo10 THEN 2 * (close - lo10) / (hi10 - lo10) - 1 ELSE 0 END AS range_place, (ma5 - ma20) / atr AS cross_, (high - low) / atr - 1 AS expansion FROM roll),
sig AS (SELECT asset, h, close, atr, """ + ", ".join(f"CASE WHEN {c} >= 0.8 THEN 2 WHEN {c} >= 0.25 THEN 1 WHEN {c} <= -0.8 THEN -2 WHEN {c} <= -0.25 THEN -1 ELSE 0 END AS {n}" for n, c in (("trend_fast", "trend_fast"), ("jump", "jump"), ("trend_slow", "trend_slow"), ("range_place", "range_place"), ("cross_sig", "cross_"), ("expansion", "expansion"))) + """ FROM raw),
comp AS (SELECT *, greatest(-1e0, least(1e0, (trend_fast * 1.5e0 + jump * 1e0) / (2 * 2.5e0))) AS leading, greatest(-1e0, least(1e0, (trend_slow * 1.2e0 + range_place * 0.8e0) / (2 * 2e0))) AS coincident, greatest(-1e0, least(1e0, (cross_sig * 1e0 - expansion * 0.5e0) / (2 * 1.5e0))) AS confirming FROM sig)"""


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, m, h, s, event_id, value) of the event stream."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    since = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return e.select(F.col("event_type").alias("asset"), F.floor(since / 60_000_000).alias("m"), F.floor(since / 3_600_000_000).alias("h"), (since / 1e6).alias("s"), "event_id", "value")


def hourly_bars(events: DataFrame) -> DataFrame:
    """(asset, h, open, high, low, close); opening and closing values are the first and last by time, then id."""
    order = F.struct("s", "event_id")
    return events.groupBy("asset", "h").agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"))


def with_atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """bars with prev (last close) and atr (mean true range of n bars), from the n-th bar on."""
    by = Window.partitionBy("asset").orderBy("h")
    prev = F.lag("close").over(by)
    tr = F.greatest(F.col("high") - F.col("low"), F.coalesce(F.abs(F.col("high") - F.col("prev")), F.lit(0.0)), F.coalesce(F.abs(F.col("low") - F.col("prev")), F.lit(0.0)))
    out = bars.withColumn("prev", prev).withColumn("tr", tr).withColumns({"atr": F.avg("tr").over(by.rowsBetween(1 - n, 0)), "rn": F.row_number().over(by)})
    return out.where((F.col("rn") >= n) & (F.col("atr") > 0)).drop("tr", "rn")


def discretize(x, weak: float = 0.25, strong: float = 0.8):
    """-2..2 by symmetric inclusive thresholds."""
    return F.when(x >= strong, 2).when(x >= weak, 1).when(x <= -strong, -2).when(x <= -weak, -1).otherwise(0)


def with_signals(bars: DataFrame) -> DataFrame:
    """(asset, h, close, atr, one column per signal) from with_atr() bars."""
    by = Window.partitionBy("asset").orderBy("h")
    b = bars.withColumns({
        "ma5": F.avg("close").over(by.rowsBetween(-4, 0)), "ma20": F.avg("close").over(by.rowsBetween(-19, 0)),
        "hi10": F.max("high").over(by.rowsBetween(-9, 0)), "lo10": F.min("low").over(by.rowsBetween(-9, 0)),
    })
    raw = {
        "trend_fast": (F.col("close") - F.col("ma5")) / F.col("atr"), "jump": (F.col("close") - F.coalesce("prev", "close")) / F.col("atr"),
        "trend_slow": (F.col("close") - F.col("ma20")) / F.col("atr"), "range_place": F.when(F.col("hi10") > F.col("lo10"), 2 * (F.col("close") - F.col("lo10")) / (F.col("hi10") - F.col("lo10")) - 1).otherwise(0),
        "cross": (F.col("ma5") - F.col("ma20")) / F.col("atr"), "expansion": (F.col("high") - F.col("low")) / F.col("atr") - 1,
    }
    return b.select("asset", "h", "close", "atr", *(discretize(v).alias(k) for k, v in raw.items()))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_atr(hourly_bars(minutes(spark, sf_dir)))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_signals(bars(spark, sf_dir))
