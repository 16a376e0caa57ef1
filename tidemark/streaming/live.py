"""Structured Streaming: payload source, coalescing by asset, watermarked bars, current and history sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAYLOAD = "asset string, ts timestamp, value double"


def payload_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """JSON payload files as a stream."""
    return spark.readStream.schema(PAYLOAD).option("maxFilesPerTrigger", files_per_trigger).json(path)


def latest_per_asset(batch: DataFrame) -> DataFrame:
    """The newest payload of each asset: what waited meanwhile is dropped."""
    return batch.groupBy("asset").agg(F.max("ts").alias("ts"), F.max_by("value", F.struct("ts", "value")).alias("value"))


def bars_stream(events: DataFrame, horizon: str = "0 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling bars; a bar leaves once the watermark, `horizon` behind the newest event, has passed its end."""
    return events.withWatermark("ts", horizon).groupBy("asset", F.window("ts", width)).agg(F.max("value").alias("high"), F.min("value").alias("low"), F.count("*").alias("n")).select("asset", F.col("window.start").alias("start"), "high", "low", "n")


def upsert(new: DataFrame, old: DataFrame | None, keys: list[str], order: str) -> DataFrame:
    """Old and new rows, the last by `order` for each key; new rows win a tie."""
    both = new.withColumn("_new", F.lit(1)) if old is None else new.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new")))
    return both.withColumn("_r", last).where("_r = 1").drop("_r", "_new")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None] | None, target: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there and ends; rows go to a Parquet folder or to `each`."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", target).start()
    query.awaitTermination()
