"""Evidence: strength and votes over states, refinement of distributions, signal alpha, rank correlation, check verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import mutual_information


def evidence_strength(*states: Column) -> Column:
    """((1 - sd/2) + |mean|/2) / 2 of state values from -2 to 2."""
    n = len(states)
    mean = sum(states[1:], states[0]) / n
    spread = F.sqrt(sum(((s - mean) * (s - mean) for s in states[1:]), (states[0] - mean) * (states[0] - mean)) / n)
    return ((1 - spread / 2) + F.abs(mean) / 2) / 2


def weighted_vote(rows: DataFrame, by: list[str], state: str, confidence: str) -> DataFrame:
    """(by, winner, share): the state with the most summed confidence; of equals the first by name."""
    sums = rows.groupBy(*by, state).agg(F.sum(confidence).alias("w"))
    best = sums.groupBy(*by).agg(F.max_by(state, F.struct("w", F.col(state))).alias("_last"), F.min(F.struct((-F.col("w")).alias("w"), F.col(state).alias("s"))).alias("b"), F.sum("w").alias("total"))
    return best.select(*by, F.col("b.s").alias("winner"), (-F.col("b.w") / F.col("total")).alias("share"))


def shifted(high: Column, medium: Column, low: Column, derived: Column, win_rate: Column, step: float = 0.15, expected: float = 0.55, good: float = 0.58) -> dict[str, Column]:
    """Confidence distribution moved by at most `step` or half of a state: from high to medium where the win rate falls short, from medium to
    high or low to medium where it exceeds what is expected; then normalised. A null win rate moves nothing."""
    down, up, lift = (derived == "high") & (win_rate < expected), (derived == "medium") & (win_rate > good), (derived == "low") & (win_rate > expected)
    move = lambda when, p: F.when(when, F.least(F.lit(step), p * 0.5)).otherwise(0.0)
    a, b, c = move(down, high), move(up, medium), move(lift, low)
    new = {"high": high - a + b, "medium": medium + a - b + c, "low": low - c}
    total = new["high"] + new["medium"] + new["low"]
    return {k: v / total for k, v in new.items()}


def signal_alpha(rows: DataFrame, signals: dict[str, str], outcome: str, fold: str) -> DataFrame:
    """(signal, class, mi_avg, stability, oos_mi, weight): mutual information of each signal with the outcome in folds odd, even and oos.

    stability: 1 - |difference| / larger, at least 0.1; weight: mi_avg over the median of its class, times stability, from 0 to 2.5. One pass turns
    signals to long form; counts by value meet the folds after aggregation."""
    long_ = rows.select(F.col(outcome).alias("y"), F.col(fold).alias("fold"), F.explode(F.array(*(F.struct(F.lit(k).alias("signal"), F.lit(c).alias("class"), F.col(k).cast("string").alias("x")) for k, c in signals.items()))).alias("s")).select("y", "fold", "s.*")
    mi = mutual_information(long_, "x", "y", F.lit(1.0), ["signal", "class", "fold"])
    of = lambda f: F.coalesce(F.max(F.when(F.col("fold") == f, F.col("mi"))), F.lit(0.0))
    wide = mi.groupBy("signal", "class").agg(of("odd").alias("odd"), of("even").alias("even"), of("oos").alias("oos_mi"))
    wide = wide.withColumns({"mi_avg": (F.col("odd") + F.col("even")) / 2, "stability": F.greatest(F.lit(0.1), 1 - F.abs(F.col("odd") - F.col("even")) / F.greatest("odd", "even", F.lit(1e-9)))})
    middle = F.median("mi_avg").over(Window.partitionBy("class"))
    ratio = F.col("mi_avg") / F.when(middle == 0, 1e-6).otherwise(middle) * F.col("stability")
    return wide.withColumn("weight", F.when(F.col("mi_avg") == 0, 0.0).otherwise(F.least(F.lit(2.5), F.greatest(F.lit(0.0), ratio)))).drop("odd", "even")


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, rho): correlation of average ranks."""
    def rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2

    ranked = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_x": rank(x), "_y": rank(y)})
    return ranked.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"))


def shares(rows: DataFrame, state: str) -> DataFrame:
    """(state, n, share) over all rows."""
    n = rows.groupBy(state).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_all")))).select(state, "n", (F.col("n") / F.col("_all")).alias("share"))


def graded(value: Column, warn: float, fail: float, above: bool = True) -> Column:
    """FAIL, WARN or PASS of a value that is bad above (or below) its bounds; null is a FAIL."""
    over = (lambda b: value > b) if above else (lambda b: value < b)
    return F.when(value.isNull() | over(fail), "FAIL").when(over(warn), "WARN").otherwise("PASS")


def verdict(checks: DataFrame) -> DataFrame:
    """(n_checks, failed, warned, verdict) of rows with a status: GO only if nothing failed."""
    out = checks.agg(F.count("*").alias("n_checks"), F.count_if(F.col("status") == "FAIL").alias("failed"), F.count_if(F.col("status") == "WARN").alias("warned"))
    return out.withColumn("verdict", F.when(F.col("failed") > 0, "NO-GO").otherwise("GO"))
