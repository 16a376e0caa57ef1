"""First-touch barrier labels: a range join by day buckets, then one aggregation for all levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = (0.25, 0.5, 0.75, 1.0, 1.25, 1.5)
DAY = 1440


def level_key(level: float) -> str:
    return f"{round(level * 100):03d}"


def first_touch(anchors: DataFrame, path: DataFrame, levels: tuple[float, ...] = LEVELS, window: int = 2880, offset: int = 60) -> DataFrame:
    """anchors (asset, m, ref, atr) with up_XXX, down_XXX (first minute after the anchor at ref +- level * atr, null: not
    reached), max_up, max_down in ATR and the minutes they are first attained.

    path: (asset, m, high, low). Minutes (m + offset - 1, m + offset - 1 + window] count. Anchors meet the path through
    (asset, day) keys, so a hot asset spreads over its days; anchors without path rows keep null times.
    """
    begin, end = F.col("a.m") + offset, F.col("a.m") + offset + window
    days = F.explode(F.sequence(F.floor((F.col("m") + offset) / DAY), F.floor((F.col("m") + offset + window - 1) / DAY)))
    dealt = anchors.select("asset", "m", "ref", "atr", days.alias("day")).alias("a")
    ticks = path.withColumn("day", F.floor(F.col("m") / DAY)).alias("p")
    met = dealt.join(ticks, (F.col("a.asset") == F.col("p.asset")) & (F.col("a.day") == F.col("p.day")) & (F.col("p.m") >= begin) & (F.col("p.m") < end))
    after = (F.col("p.m") - F.col("a.m") - offset + 1).cast("int")
    up, down = (F.col("p.high") - F.col("a.ref")) / F.col("a.atr"), (F.col("p.low") - F.col("a.ref")) / F.col("a.atr")
    hits = [F.min(F.when(up >= k, after)).alias(f"up_{level_key(k)}") for k in levels] + [F.min(F.when(down <= -k, after)).alias(f"down_{level_key(k)}") for k in levels]
    extremes = [F.max(up).alias("max_up"), F.min(down).alias("max_down"), F.min_by(after, F.struct(-up, after)).alias("max_up_min"), F.min_by(after, F.struct(down, after)).alias("max_down_min")]
    found = met.groupBy(F.col("a.asset").alias("asset"), F.col("a.m").alias("m")).agg(*hits, *extremes)
    return anchors.join(found, ["asset", "m"], "left")


def first_significant(levels: tuple[float, ...] = LEVELS, threshold: float = 0.75) -> tuple[Column, Column]:
    """(name, minute): the side that touches the threshold first (a tie is up) wins; its name is the highest level touched no
    later than the other side's threshold."""
    up, down = F.col(f"up_{level_key(threshold)}"), F.col(f"down_{level_key(threshold)}")
    far = 1 << 30
    wins_up = up.isNotNull() & (up <= F.coalesce(down, F.lit(far)))
    wins_down = down.isNotNull() & (down < F.coalesce(up, F.lit(far)))
    name, minute = F.when(F.lit(False), F.lit("none")), F.when(F.lit(False), F.lit(0))
    for side, wins, other in (("up", wins_up, down), ("down", wins_down, up)):
        for k in sorted((k for k in levels if k >= threshold), reverse=True):
            at = F.col(f"{side}_{level_key(k)}")
            name = name.when(wins & (at <= F.coalesce(other, F.lit(far))), F.lit(f"{side}_{level_key(k)}"))
            minute = minute.when(wins & (at <= F.coalesce(other, F.lit(far))), at)
    return name.otherwise("none"), minute


def barrier_state(name: Column, minute: Column, window: int) -> Column:
    """Five states; strong from level 1.00 on, neutral for none or beyond the window."""
    level = F.try_to_number(F.split_part(name, F.lit("_"), F.lit(2)), F.lit("999")).cast("int")
    hit = (name != "none") & (minute <= window)
    return F.when(~F.coalesce(hit, F.lit(False)), "neutral").when(name.startswith("up"), F.when(level >= 100, "up_strong").otherwise("up_weak")).otherwise(F.when(level >= 100, "down_strong").otherwise("down_weak"))


def atr_bins(ret: Column) -> Column:
    """Fixed-horizon return in ATR to -3..3, edges 0.25, 0.75, 1.25."""
    size = F.abs(ret)
    return (F.signum(ret) * F.when(size >= 1.25, 3).when(size >= 0.75, 2).when(size >= 0.25, 1).otherwise(0)).cast("int")


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """left with the last non-null value of right at or before its time: a union and a window, no theta join."""
    from pyspark.sql import Window

    both = left.withColumns({"_v": F.lit(None).cast(right.schema[value].dataType), "_left": F.lit(1)}).unionByName(right.select(by, time, F.col(value).alias("_v"), F.lit(0).alias("_left")), allowMissingColumns=True)
    seen = F.last("_v", ignorenulls=True).over(Window.partitionBy(by).orderBy(time, "_left").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, seen).where("_left = 1").drop("_v", "_left")
