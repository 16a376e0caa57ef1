"""Conditional probability tables in long form: (parent columns, state, prob), estimated, checked and looked up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def states_table(spark: SparkSession, name: str, states: list[str]) -> DataFrame:
    return spark.createDataFrame([(s,) for s in states], f"{name} string")


def grid(spark: SparkSession, **states: list[str]) -> DataFrame:
    """All combinations of small state lists."""
    from itertools import product

    return spark.createDataFrame(list(product(*states.values())), ", ".join(f"{k} string" for k in states))


def conditional(rows: DataFrame, parents: list[str], child: str, states: list[str], weight: Column | None = None, alpha: float = 1.0, keys: DataFrame | None = None) -> DataFrame:
    """(parents, child, prob, weight_total): Laplace-smoothed weighted shares of the listed states. Keys: those seen, or all of `keys`."""
    w = F.lit(1.0) if weight is None else weight
    counts = rows.where(F.col(child).isin(states)).groupBy(*parents, child).agg(F.sum(w).alias("w"))
    seen = keys if keys is not None else counts.select(*parents).distinct()
    full = seen.crossJoin(F.broadcast(states_table(rows.sparkSession, child, states))).join(counts, [*parents, child], "left")
    totals = counts.groupBy(*parents).agg(F.sum("w").alias("weight_total"))
    out = full.join(totals, parents, "left").withColumn("weight_total", F.coalesce("weight_total", F.lit(0.0)))
    return out.select(*parents, child, ((F.coalesce("w", F.lit(0.0)) + alpha) / (F.col("weight_total") + alpha * len(states))).alias("prob"), "weight_total")


def prior(rows: DataFrame, child: str, states: list[str], weight: Column | None = None, alpha: float = 1.0) -> DataFrame:
    """(child, prob) over all listed states."""
    w = F.lit(1.0) if weight is None else weight
    counts = rows.groupBy(child).agg(F.sum(w).alias("w"))
    full = states_table(rows.sparkSession, child, states).join(counts, child, "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    total = full.agg(F.sum("w").alias("t"))
    return full.crossJoin(F.broadcast(total)).select(child, ((F.col("w") + alpha) / (F.col("t") + alpha * len(states))).alias("prob"))


def quality(cpt: DataFrame, parents: list[str], prob: str = "prob") -> DataFrame:
    """One row: keys, mean entropy (bits), largest distance of a key's sum from one."""
    per = cpt.groupBy(*parents).agg(F.sum(F.when(F.col(prob) > 0, -F.col(prob) * F.log2(prob)).otherwise(0.0)).alias("h"), F.abs(F.sum(prob) - 1).alias("off"))
    return per.agg(F.count("*").alias("n_keys"), F.avg("h").alias("mean_entropy"), F.max("off").alias("max_off"))


def stability(a: DataFrame, b: DataFrame, parents: list[str], child: str, epsilon: float = 1e-10) -> DataFrame:
    """One row: 1 minus the mean Jensen-Shannon distance (bits) over keys in both tables."""
    common = a.select(*parents).distinct().intersect(b.select(*parents).distinct())
    both = a.select(*parents, child, F.col("prob").alias("p")).join(b.select(*parents, child, F.col("prob").alias("q")), [*parents, child], "full").join(common, parents, "left_semi")
    both = both.select(*parents, F.coalesce("p", F.lit(epsilon)).alias("p"), F.coalesce("q", F.lit(epsilon)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    js = F.sum((F.col("p") * F.log2(F.col("p") / m) + F.col("q") * F.log2(F.col("q") / m)) / 2)
    return both.groupBy(*parents).agg(F.sqrt(F.greatest(js, F.lit(0.0))).alias("d")).agg((1 - F.avg("d")).alias("stability"), F.count("*").alias("n_keys"))


def lookup(rows: DataFrame, cpt: DataFrame, parents: list[str], child: str, states: list[str], default: DataFrame | None = None, max_keys: int = 100_000) -> DataFrame:
    """rows with one probability column p_<state> each: the key's, else the default's, else uniform. Tables of at most max_keys keys are broadcast."""
    wide = cpt.groupBy(*parents).pivot(child, states).agg(F.first("prob"))
    wide = wide.select(*parents, *(F.col(s).alias(f"p_{s}") for s in states))
    small = len(wide.limit(max_keys + 1).take(max_keys + 1)) <= max_keys
    out = rows.join(F.broadcast(wide) if small else wide, parents, "left")
    if default is not None:
        one = default.groupBy().pivot(child, states).agg(F.first("prob")).select(*(F.col(s).alias(f"d_{s}") for s in states))
        out = out.crossJoin(F.broadcast(one))
        return out.withColumns({f"p_{s}": F.coalesce(f"p_{s}", f"d_{s}", F.lit(1.0 / len(states))) for s in states}).drop(*(f"d_{s}" for s in states))
    return out.fillna({f"p_{s}": 1.0 / len(states) for s in states})


def argmax(states: list[str]) -> Column:
    """Name of the most probable state; the first listed wins a tie."""
    best = F.greatest(*(F.col(f"p_{s}") for s in states))
    return reduce(lambda c, s: c.when(F.col(f"p_{s}") == best, s), states, F.when(F.lit(False), F.lit("")))


def expected_atr(states: dict[str, float]) -> Column:
    return reduce(lambda x, y: x + y, (F.col(f"p_{s}") * mid for s, mid in states.items()))


def cascade(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first table that has their key."""
    ranked = reduce(lambda x, y: x.unionByName(y), (t.withColumn("_rank", F.lit(i)) for i, t in enumerate(tables)))
    best = ranked.groupBy(*keys).agg(F.min("_rank").alias("_rank"))
    return ranked.join(best, [*keys, "_rank"], "left_semi").drop("_rank")
