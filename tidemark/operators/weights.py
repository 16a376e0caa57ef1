"""Overlap-corrected sample weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def uniqueness(rows: DataFrame, name: str = "barrier", hit: str = "hit", by: str = "asset") -> DataFrame:
    """w = 1/N for the N rows that claim one (barrier, hit time), 1 for rows without a hit."""
    n = F.count("*").over(Window.partitionBy(by, name, hit))
    return rows.withColumn("w", F.when((F.col(name) == "none") | F.col(hit).isNull(), F.lit(1.0)).otherwise(F.lit(1.0) / n))


def ida_weights(rows: DataFrame, name: str = "barrier", hit: str = "hit", score: str = "score", time: str = "m", by: str = "asset", delta: float = 0.8, level: float = 0.2, epsilon: float = 0.01, floor: float = 0.05, warn: float = 0.3) -> DataFrame:
    """ida: attribution within the cluster of rows that share (asset, barrier, hit time). Scores are flipped for down barriers,
    A = level*|s| + delta*max(0, step) + epsilon, w = A / sum A; clusters of over two rows whose effective size is under
    warn * n are floored and normalised again. Rows without a hit weigh 1."""
    cluster = Window.partitionBy(by, name, hit)
    s = F.when(F.col(name).startswith("down"), -F.col(score)).otherwise(F.col(score))
    step = F.greatest(F.lit(0.0), F.coalesce(F.col("_s") - F.lag("_s").over(cluster.orderBy(time)), F.lit(0.0)))
    out = rows.withColumn("_s", s).withColumn("_a", level * F.abs("_s") + delta * step + epsilon)
    out = out.withColumn("_w", F.col("_a") / F.sum("_a").over(cluster)).withColumns({"_n": F.count("*").over(cluster), "_e": 1 / F.sum(F.col("_w") * F.col("_w")).over(cluster)})
    thin = (F.col("_e") < warn * F.col("_n")) & (F.col("_n") > 2)
    out = out.withColumn("_f", F.when(thin, F.greatest(F.col("_w"), F.lit(floor))).otherwise(F.col("_w")))
    w = F.when((F.col(name) == "none") | F.col(hit).isNull(), F.lit(1.0)).otherwise(F.col("_f") / F.sum("_f").over(cluster))
    return out.withColumn("ida", w).drop("_s", "_a", "_w", "_n", "_e", "_f")


def effective_size(rows: DataFrame, weight: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg((F.pow(F.sum(weight), 2) / F.sum(F.col(weight) * F.col(weight))).alias("n_eff"), F.count("*").alias("n"))
