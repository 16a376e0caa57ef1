"""Sources and sinks: keyed upserts, retention, partitioned and text sinks, log lines, stage gates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; without one a local folder, but only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/flow-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, for plans that meet it several times."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest_wins(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row per key, the last by `order`."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) if isinstance(c, str) else c.desc() for c in order)))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r")


def upsert_parquet(spark: SparkSession, new: DataFrame, path: str, keys: list[str], order: str, partition: str | None = None) -> DataFrame:
    """Merges rows into a Parquet folder: old and new are united, the last by `order` stays (new wins a tie), and a new version
    of the folder is written beside the old one, which readers keep until they switch. Returns the merged rows."""
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # an absent target is an empty one
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = new.limit(0)
    both = old.select(*new.columns).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    merged = latest_wins(both, keys, order, "_new").drop("_new")
    target = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    writer = merged.write.partitionBy(partition) if partition else merged.write
    writer.parquet(target)
    return spark.read.parquet(target)


def retain_runs(rows: DataFrame, run: str, keep: int) -> DataFrame:
    """Rows of the `keep` newest runs."""
    newest = rows.select(run).distinct().orderBy(F.desc(run)).limit(keep)
    return rows.join(F.broadcast(newest), run, "left_semi")


def backfill(rows: DataFrame, fresh: DataFrame, keys: list[str], column: str, overwrite: bool = False) -> DataFrame:
    """rows with `column` filled from fresh where it is null, or wherever fresh has a value."""
    new = fresh.select(*keys, F.col(column).alias("_new"))
    value = F.coalesce("_new", column) if overwrite else F.coalesce(column, "_new")
    return rows.join(new, keys, "left").withColumn(column, value).drop("_new")


def stage_gate(rows: DataFrame, least: int) -> bool:
    """Whether at least `least` rows are there, without counting all."""
    return rows.limit(least).count() >= least


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """(level, step, rows) of lines such as `INFO step=name rows=12`; other lines are left out."""
    pattern = r"^(\w+) step=(\S+) rows=(\d+)$"
    return lines.where(F.col(column).rlike(pattern)).select(F.regexp_extract(column, pattern, 1).alias("level"), F.regexp_extract(column, pattern, 2).alias("step"), F.regexp_extract(column, pattern, 3).cast("long").alias("rows"))


def range_scan(spark: SparkSession, url: str, table: str, column: str, low: str, high: str, partitions: int) -> DataFrame:
    """JDBC table read in ranges of one column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=partitions)
