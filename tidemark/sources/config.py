"""Tables as configuration and document store: thresholds with fallbacks, overrides per asset, stored conditional tables with ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key; ties by the whole row."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), *(c for c in rows.columns if c not in keys)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def mirrored_thresholds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, neutral, strong, neutral_down, strong_down) from rows (keys, name, value): a lower side that is not given mirrors the upper one."""
    names = ("neutral", "strong", "neutral_down", "strong_down")
    wide = rows.groupBy(*keys).pivot("name", list(names)).agg(F.first("value"))
    return wide.withColumns({f"{n}_down": F.coalesce(F.col(f"{n}_down"), -F.col(n)) for n in ("neutral", "strong")})


def with_overrides(assets: DataFrame, table: DataFrame, defaults: dict[str, float], key: str = "asset") -> DataFrame:
    """assets with each setting: the asset's own row (name, value), else the row without asset, else the default."""
    own, common = table.where(F.col(key).isNotNull()), table.where(F.col(key).isNull())
    wide = own.groupBy(key).pivot("name", list(defaults)).agg(F.first("value"))
    base = common.agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"_{n}") for n in defaults))
    out = assets.join(wide, key, "left").crossJoin(F.broadcast(base))
    return out.select(*assets.columns, *(F.coalesce(n, f"_{n}", F.lit(v)).alias(n) for n, v in defaults.items()))


def save_tables(tables: DataFrame, path: str) -> None:
    """Adds conditional tables (branch, node, scope, generated, ...) to the store, a folder per branch and node."""
    tables.write.mode("append").partitionBy("branch", "node").parquet(path)


def load_table(spark: SparkSession, path: str, node: str, now: Column, max_age: int, schema) -> DataFrame:
    """Rows of a node's newest table per scope that is at most max_age old; reads that node's folder only."""
    rows = spark.read.schema(schema).parquet(path).where(F.col("node") == node)
    newest = F.max("generated").over(Window.partitionBy("scope"))
    return rows.withColumn("_newest", newest).where((F.col("generated") == F.col("_newest")) & (now - F.col("generated") <= max_age)).drop("_newest")


def dynamic_select(rows: DataFrame, names: list[str], suffix: str) -> DataFrame:
    """Keys and the named columns that exist, aliased with a suffix; unknown names are left out."""
    known = [n for n in names if n in rows.columns]
    return rows.select("asset", "h", *(F.col(n).alias(f"{n}{suffix}") for n in known))


def leakage(rows: DataFrame, outcome: tuple[str, ...] = ("barrier", "hit", "max_up", "max_down", "state")) -> list[str]:
    """Columns of a feature table that give outcomes away: those named, and all that begin with outcome_."""
    return [c for c in rows.columns if c in outcome or c.startswith("outcome_")]
