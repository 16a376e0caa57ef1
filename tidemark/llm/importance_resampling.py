"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_words, hash_words, mix64, pieces, stage_table

MODEL = "_bucket int, _raw long, _target long"
SCORES = ("log_weight", "sample_key", "kept")
_TAG = np.uint64(0xA24BAED4963EE407)


def features(texts: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the text) of each unigram and bigram; words are lower-cased (A-Z) and split at ASCII whitespace."""
    ids, words, counts = arrow_words(texts)
    h = hash_words(words)[ids] if len(ids) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(counts)), counts)
    same = owner[1:] == owner[:-1]
    pair = mix64(h[:-1] * _TAG + h[1:])[same]
    buckets = np.concatenate((h, pair)) % np.uint64(dim)
    return buckets.astype(np.int64), np.concatenate((owner, owner[1:][same]))


def fit_models(docs: DataFrame, text: str, target: str, dim: int) -> DataFrame:
    """A row per bucket in use: n-grams in all texts and in those of rows where target is true. All rows count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, wanted = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            target_rows = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for start, texts in pieces(batch.column(0)):
                buckets, owner = features(texts, dim)
                raw += np.bincount(buckets, minlength=dim)
                wanted += np.bincount(buckets[target_rows[start + owner]], minlength=dim)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(wanted[at])], names=["_bucket", "_raw", "_target"])

    return docs.select(text, target).mapInArrow(count, MODEL).groupBy("_bucket").agg(F.sum("_raw").alias("_raw"), F.sum("_target").alias("_target"))


def log_ratios(model: DataFrame, dim: int) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), add-one smoothed. dim numbers, whatever the corpus."""
    rows = model.toArrow()
    raw, wanted = np.zeros(dim), np.zeros(dim)
    at = rows.column("_bucket").to_numpy()
    raw[at], wanted[at] = rows.column("_raw").to_numpy(), rows.column("_target").to_numpy()
    return np.log((wanted + 1) / (wanted.sum() + dim)) - np.log((raw + 1) / (raw.sum() + dim))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1024, small: int = 10_000) -> float | None:
    """Exact k-th largest value of a double column; histograms narrow the range until at most `small` rows are in it."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    k, above = min(k, n), 0
    while n > small and low < high:
        step = (high - low) / bins
        inside = df.where(F.col(column).between(low, high))
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(step)), F.lit(bins - 1))
        rows = inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("b")).collect()
        for row in rows:
            if above + row["n"] >= k:
                break
            above += row["n"]
        if (row["low"], row["high"]) == (low, high):
            break
        low, high, n = row["low"], row["high"], row["n"]
    if low == high:
        return low
    values = sorted((r[0] for r in df.where(F.col(column).between(low, high)).select(column).collect()), reverse=True)
    return values[k - above - 1]


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", target: str = "target", share: float | None = None, dim: int = 1 << 16, seed: int = 7) -> DataFrame:
    """docs with log_weight, sample_key and kept in place of columns so named.

    labels: key and target, true for rows of the target distribution, false for others that were judged; of several rows
    for a key one that is true wins, null targets are left out. log_weight is the sum over hashed unigrams and bigrams of
    the two models' log ratio, sample_key adds Gumbel noise drawn from a hash of the key and seed, and kept marks the share of
    all rows with the largest keys (default: the share of the labels that are true; all rows without labels), rows that tie
    with the last one included. Null or empty texts weigh 0. Only `dim` counts and bounded histograms reach the driver; texts
    move between tasks once, to meet their labels. Columns of other names are left as they are.
    """
    spark = docs.sparkSession
    docs = docs.select(*(c for c in docs.columns if c not in SCORES))
    judged = labels.where(F.col(target).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(target).cast("boolean")).alias("_target"))
    counted = judged.agg(F.sum(F.col("_target").cast("long")).alias("t"), F.count("*").alias("m")).first()
    known = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(judged.hint("merge"), "_key", "left")  # labels grow with the texts
    ratios = spark.sparkContext.broadcast(log_ratios(fit_models(known, "_text", "_target", dim), dim))
    out, own = docs, list(docs.columns)
    at = own.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.zeros(batch.num_rows)
            for start, texts in pieces(batch.column(at)):
                buckets, owner = features(texts, dim)
                weight[start : start + len(texts)] = np.bincount(owner, weights=ratios.value[buckets], minlength=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight)], names=[*own, "log_weight"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    scored = out.mapInArrow(score, spark.createDataFrame([], f"{fields}, log_weight double").schema)
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    scored = scored.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform)))
    wanted = share if share is not None else (counted["t"] or 0) / counted["m"] if counted["m"] else 1.0
    keys = stage_table(scored.select("sample_key"), "sample-keys")
    last = kth_largest(keys, "sample_key", round(wanted * keys.count()))
    return scored.withColumn("kept", F.col("sample_key") >= F.lit(last) if last is not None else F.lit(False))
