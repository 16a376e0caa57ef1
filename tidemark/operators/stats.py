"""Association statistics over weighted 2x2 tables, multiple testing, mutual information, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Z95 = 1.959963984540054


def normal_cdf(x: Column) -> Column:
    """Polynomial approximation 26.2.17 of Abramowitz and Stegun (error under 7.5e-8)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def contingency(rows: DataFrame, combo: str, hit: str, weight: Column, by: list[str]) -> DataFrame:
    """(by, combo, a, b, c, d): weighted hits and misses inside and outside each combination, from one pass over the rows."""
    inside = rows.groupBy(*by, combo).agg(F.sum(F.when(F.col(hit), weight).otherwise(0.0)).alias("a"), F.sum(F.when(F.col(hit), 0.0).otherwise(weight)).alias("b"))
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return inside.withColumns({"c": F.sum("a").over(every) - F.col("a"), "d": F.sum("b").over(every) - F.col("b")})


def table_statistics(t: DataFrame) -> DataFrame:
    """Odds ratio with 0.5 added, its interval and p, Yates chi-square, MCC, Cramer's V, information gain and rates."""
    a, b, c, d = (F.col(x) for x in "abcd")
    n = a + b + c + d
    x, y, z, w = (v + 0.5 for v in (a, b, c, d))
    log_or, se = F.log(x * w / (y * z)), F.sqrt(1 / x + 1 / y + 1 / z + 1 / w)
    marg = (a + b) * (c + d) * (a + c) * (b + d)
    yates = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    chi2 = F.when(marg > 0, n * yates * yates / marg).otherwise(0.0)
    entropy = lambda p: F.when((p > 0) & (p < 1), -p * F.log2(p) - (1 - p) * F.log2(1 - p)).otherwise(0.0)
    share = lambda top, bottom: F.when(bottom > 0, top / bottom).otherwise(0.0)
    gain = entropy((a + c) / n) - (a + b) / n * entropy(share(a, a + b)) - (c + d) / n * entropy(share(c, c + d))
    return t.withColumns({
        "odds_ratio": F.exp(log_or), "ci_low": F.exp(log_or - Z95 * se), "ci_high": F.exp(log_or + Z95 * se), "p_value": 2 * (1 - normal_cdf(F.abs(log_or / se))),
        "chi2": chi2, "mcc": F.when(marg > 0, (a * d - b * c) / F.sqrt(marg)).otherwise(0.0), "cramers_v": F.sqrt(chi2 / n), "info_gain": gain,
        "sensitivity": share(a, a + c), "specificity": share(d, b + d), "ppv": share(a, a + b), "npv": share(d, c + d),
    })


def adjusted(rows: DataFrame, p: str, by: list[str], order: str) -> DataFrame:
    """rows with bh, by_, bonferroni and holm adjusted p values; ties follow `order`."""
    part = Window.partitionBy(*by)
    up = part.orderBy(p, order)
    down = part.orderBy(F.desc(p), F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumns({"_k": F.row_number().over(up), "_m": F.count("*").over(part)})
    r = r.withColumn("_h", F.sum(1 / F.col("_k")).over(part))
    one = F.lit(1.0)
    raw = F.col(p) * F.col("_m") / F.col("_k")
    return r.withColumns({
        "bh": F.least(one, F.min(raw).over(down)), "by_": F.least(one, F.min(raw * F.col("_h")).over(down)), "bonferroni": F.least(one, F.col(p) * F.col("_m")),
        "holm": F.least(one, F.max(F.col(p) * (F.col("_m") - F.col("_k") + 1)).over(up.rowsBetween(Window.unboundedPreceding, 0))),
    }).drop("_k", "_m", "_h")


def signal_class(t: DataFrame) -> Column:
    """golden, promising or noise from odds ratio, interval, support and MCC."""
    n = F.col("a") + F.col("b")
    return F.when((F.col("odds_ratio") > 1.5) & (F.col("ci_low") > 1) & (n >= 20) & (F.col("mcc") > 0.05), "golden").when((F.col("odds_ratio") > 1) & (F.col("ci_low") > 1), "promising").otherwise("noise")


def mutual_information(rows: DataFrame, x: str, y: str, weight: Column, by: list[str], base: float = math.e) -> DataFrame:
    """(by, mi) from weighted counts; rows collapse to cells before anything else."""
    cells = rows.groupBy(*by, x, y).agg(F.sum(weight).alias("w"))
    n, wx, wy = F.sum("w").over(Window.partitionBy(*by)), F.sum("w").over(Window.partitionBy(*by, x)), F.sum("w").over(Window.partitionBy(*by, y))
    cells = cells.withColumns({"n": n, "wx": wx, "wy": wy}).where("w > 0")
    term = F.col("w") / F.col("n") * F.log(F.col("w") * F.col("n") / (F.col("wx") * F.col("wy"))) / math.log(base)
    return cells.groupBy(*by).agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))


def bootstrap_odds(t: DataFrame, key: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """(key, boot_low, boot_high): percentile interval of the odds ratio. Resampling n rows of a table is one multinomial draw, so no row is repeated; the generator is seeded by the key."""
    import zlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, *cells in pdf.itertuples(index=False):
                cells = np.rint(np.array(cells, float))
                n = int(cells.sum())
                rng = np.random.default_rng([seed, zlib.crc32(str(k).encode())])
                x = rng.multinomial(n, cells / n, size=draws) + 0.5 if n else np.full((1, 4), 0.5)
                low, high = np.percentile(x[:, 0] * x[:, 3] / (x[:, 1] * x[:, 2]), [2.5, 97.5])
                out.append((str(k), low, high))
            yield pd.DataFrame(out, columns=["k", "boot_low", "boot_high"])

    return t.select(F.col(key).cast("string").alias("k"), "a", "b", "c", "d").mapInPandas(run, "k string, boot_low double, boot_high double")


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher exact p of rounded counts."""

    def one(a, b, c, d):
        a, b, c, d = (math.floor(v + 0.5 + 1e-9) for v in (a, b, c, d))
        row, col, n = a + b, a + c, a + b + c + d
        choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        logs = np.array([choose(row, k) + choose(n - row, col - k) - choose(n, col) for k in range(max(0, row + col - n), min(row, col) + 1)])
        own = choose(row, a) + choose(n - row, col - a) - choose(n, col)
        return float(min(1.0, np.exp(logs[logs <= own + 1e-7]).sum()))

    return pd.Series([one(*v) for v in zip(a, b, c, d, strict=True)])
