"""Queries of sources, sinks and streams. Streams run over ordered files until they are read and are compared with the batch answer."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cpt
from tidemark.sources import io, market
from tidemark.streaming import live

from .market_queries import MIDPOINTS, STATES, evidence, prediction_cpt, training


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.minutes(spark, sf_dir).select("asset", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"), "value", "event_id", "h")


def a03_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice")
    base = f"{io.shared_folder(spark)}/target"
    first = io.upsert_parquet(spark, o.where("o_orderkey % 2 = 0"), base, ["o_custkey"], "o_orderkey")
    first.write.parquet(base)
    return io.upsert_parquet(spark, o.where("o_orderkey % 2 = 1"), base, ["o_custkey"], "o_orderkey")


def a05_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("v"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("v"))
    return io.backfill(o, lines, ["o_orderkey"], "v")


def a19_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{io.shared_folder(spark)}/json"
    spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy("c_mktsegment").agg(F.count("*").alias("n")).write.json(path)
    return spark.read.schema("c_mktsegment string, n long").json(path)


def a20_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{io.shared_folder(spark)}/csv"
    spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("n_nationkey int, n_name string").csv(path)


def a22_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{io.shared_folder(spark)}/log"
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    n.select(F.concat(F.lit("INFO step="), F.lower("n_name"), F.lit(" rows="), F.col("n_nationkey").cast("string"))).union(spark.createDataFrame([("noise",)], "x string")).write.text(path)
    return io.parse_log(spark.read.text(path))


def a27_retained_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.year("o_orderdate").alias("run"))
    return io.retain_runs(o, "run", 2).select("o_orderkey")


def a28_stage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = io.stage_gate(spark.read.parquet(f"{sf_dir}/orders.parquet"), 1000)
    return spark.createDataFrame([(ok,)], "ok boolean")


def a30_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.range(1000)
    return x.select(F.col("id"), *((F.pmod(F.xxhash64(F.lit(42), F.lit(c), "id"), F.lit(5)) - 2).cast("int").alias(c) for c in ("d", "q", "h")))


def _stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    base = io.shared_folder(spark)
    event_rows(spark, sf_dir).withColumn("part", F.floor(F.col("h") / 168)).select("asset", "ts", "value", "part").repartitionByRange(6, "ts").sortWithinPartitions("ts").drop("part").write.json(f"{base}/in")
    return live.payload_stream(spark, f"{base}/in", 2), base


def latest_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch is coalesced to the newest payload of each asset and merged into the current snapshot."""
    stream, base = _stream(spark, sf_dir)
    versions: list[str] = []

    def each(batch: DataFrame, number: int) -> None:
        old = spark.read.parquet(versions[-1]) if versions else None
        live.upsert(live.latest_per_asset(batch), old, ["asset"], "ts").write.mode("overwrite").parquet(f"{base}/current-{number}")
        versions.append(f"{base}/current-{number}")

    live.run_available(stream, each, "", f"{base}/check")
    return spark.read.parquet(versions[-1])


def z02_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_payloads(spark, sf_dir).select("asset", F.round("value", 6).alias("value"))


def z09_watermarked_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars that the watermark has closed; the batch answer has all hours but each run's last open ones."""
    stream, base = _stream(spark, sf_dir)
    live.run_available(live.bars_stream(stream, "2 hours"), None, f"{base}/bars", f"{base}/check")
    return spark.read.parquet(f"{base}/bars").groupBy("asset").agg(F.count("*").alias("bars"), F.round(F.max("high"), 6).alias("high"))


def z10_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the last 24 hours with an event, per asset and hour, as a sliding window."""
    from pyspark.sql import Window

    hours = market.minutes(spark, sf_dir).select("asset", "h").distinct()
    seen = F.count("*").over(Window.partitionBy("asset").orderBy("h").rangeBetween(-23, 0))
    return hours.select("asset", "h", F.round(seen / 24, 6).alias("completeness"))


def z04_stream_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-static join: the newest payload of each asset meets the asset's own regime and hypothesis of the payload's hour, or
    of the last hour before it that has them, and these the conditional table, its prior by default."""
    t = training(spark, sf_dir)
    known = evidence(spark, sf_dir).select("asset", "h", "regime", "hypothesis")
    newest = latest_payloads(spark, sf_dir).select("asset", "value", F.floor(F.unix_timestamp("ts") / 3600).alias("_now"))
    own = newest.join(known, "asset", "left").where("h is null or h <= _now").groupBy("asset").agg(F.max_by(F.struct("regime", "hypothesis"), "h").alias("_own"))
    rows = newest.join(own, "asset", "left").select("asset", "_own.*")
    found = cpt.lookup(rows, prediction_cpt(t), ["regime", "hypothesis"], "state", STATES, cpt.prior(t, "state", STATES))
    return found.select("asset", F.round(cpt.expected_atr(MIDPOINTS), 6).alias("expected_atr"))


QUERIES = {f.__name__: f for f in (a03_upsert, a05_backfill, a19_json_round_trip, a20_csv_round_trip, a22_log_lines, a27_retained_runs, a28_stage_gate, a30_synthetic, z02_latest_snapshot, z04_stream_inference, z09_watermarked_bars, z10_completeness)}
ORACLES = {
    "a03_upsert": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1",
    "a05_backfill": "SELECT o_orderkey, coalesce(CASE WHEN o_totalprice > 100000 THEN o_totalprice END, x.v) AS v FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS v FROM lineitem GROUP BY 1) x ON l_orderkey = o_orderkey",
    "a19_json_round_trip": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1",
    "a20_csv_round_trip": "SELECT n_nationkey, n_name FROM nation",
    "a22_log_lines": "SELECT 'INFO' AS level, lower(n_name) AS step, n_nationkey::BIGINT AS rows FROM nation WHERE n_name NOT LIKE '% %'",
    "a27_retained_runs": "SELECT o_orderkey FROM orders WHERE year(o_orderdate) IN (SELECT DISTINCT year(o_orderdate) FROM orders ORDER BY 1 DESC LIMIT 2)",
    "a28_stage_gate": "SELECT count(*) >= 1000 AS ok FROM orders",
    "z02_latest_snapshot": "SELECT event_type AS asset, round(arg_max(value, (ts, value)), 6) AS value FROM events GROUP BY 1",
    "z10_completeness": "WITH x AS (SELECT DISTINCT event_type AS asset, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h FROM events) SELECT asset, h, round(count(*) OVER (PARTITION BY asset ORDER BY h RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) / 24, 6) AS completeness FROM x",
}
