"""Packing: optimal length buckets by dynamic programming over the global histogram, token-budget batches inside each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table
from .quality_rules import words_of

COLUMNS = ("piece", "start_token", "n_tokens", "bucket_tokens", "batch", "slot", "padding")


def word_tokens(text: Column) -> Column:
    """Words of the text and one end token."""
    return F.size(words_of(text)) + 1


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """Upper ends of at most k buckets over ascending distinct lengths that minimise total padding; the last is the longest."""
    n = len(lengths)
    if not n:
        return []
    c, w = np.concatenate(([0], np.cumsum(counts))).astype(np.float64), np.concatenate(([0], np.cumsum(counts * lengths))).astype(np.float64)
    best = np.concatenate(([0.0], lengths * c[1:] - w[1:]))  # one bucket for the first i lengths
    back = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(k, n)):
        now, come = best.copy(), np.arange(n + 1)
        for i in range(1, n + 1):
            j = np.arange(i)
            total = best[:i] + lengths[i - 1] * (c[i] - c[j]) - (w[i] - w[j])
            at = int(np.argmin(total))
            now[i], come[i] = (total[at], at) if total[at] < best[i] else (best[i], -1)
        best = now
        back.append(come)
    ends, i, level = [], n, len(back) - 1
    while i > 0:
        if level and back[level][i] == -1:  # one bucket fewer is as good
            level -= 1
            continue
        ends.append(int(lengths[i - 1]))
        i, level = (int(back[level][i]), level - 1) if level else (0, 0)
    return ends[::-1]


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", n_tokens: Column | None = None, buckets: int = 8, max_tokens: int = 2048, batch_tokens: int = 65_536, rows_per_shard: int = 4096) -> DataFrame:
    """(key, piece, start_token, n_tokens, bucket_tokens, batch, slot, padding): a row for each piece of each row of docs.

    A row has n_tokens tokens (default: its words and an end token, so null and empty texts have one); more than
    max_tokens are cut into pieces, none is lost. The histogram of piece lengths, at most max_tokens rows, goes to the driver,
    where the programme chooses the bucket ends. In a bucket of length b each batch has max(1, batch_tokens // b) slots; pieces
    take (batch, slot) in order of (shard of the key's hash, key, piece, length), so equal rows take neighbouring slots. Places
    are counted per shard and shards are offset by their counts: a bucket with most of the rows is no single task.
    """
    size = F.greatest(n_tokens if n_tokens is not None else word_tokens(F.col(text)), F.lit(1)).cast("long")
    sized = docs.select(F.col(key), size.alias("_n"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / max_tokens).cast("int")), lambda i: F.struct(i.alias("piece"), (i * F.lit(max_tokens).cast("long")).alias("start_token")))
    pieces = sized.select(key, "_n", F.inline(cut)).withColumn("n_tokens", F.least(F.col("_n") - F.col("start_token"), F.lit(max_tokens).cast("long"))).drop("_n")
    pieces = stage_table(pieces, "pieces")
    histogram = sorted((r["n_tokens"], r["c"]) for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("c")).collect())
    ends = optimal_buckets(np.array([x for x, _ in histogram], np.int64), np.array([c for _, c in histogram], np.int64), buckets) or [max_tokens]
    shards = sum(c for _, c in histogram) // rows_per_shard + 1
    bucket = F.lit(ends[-1])
    for end in reversed(ends[:-1]):
        bucket = F.when(F.col("n_tokens") <= end, F.lit(end)).otherwise(bucket)
    placed = pieces.withColumns({"bucket_tokens": bucket.cast("long"), "_shard": F.pmod(F.xxhash64(key), F.lit(shards))})
    counts = placed.groupBy("bucket_tokens", "_shard").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("bucket_tokens").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    rank = F.row_number().over(Window.partitionBy("bucket_tokens", "_shard").orderBy(key, "piece", "n_tokens"))
    place = placed.withColumn("_rank", rank).join(offsets, ["bucket_tokens", "_shard"]).withColumn("_at", F.col("_offset") + F.col("_rank") - 1)
    slots = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(batch_tokens) / F.col("bucket_tokens")))
    return place.select(
        key, F.col("piece").cast("int"), "start_token", "n_tokens", "bucket_tokens", F.floor(F.col("_at") / slots).alias("batch"), F.pmod(F.col("_at"), slots).alias("slot"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )
