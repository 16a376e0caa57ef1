"""Shared pieces of the corpus operators: work tables, Arrow tokenising, 64-bit hashing, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII whitespace of the word rule `[^\x20\x09-\x0D]+`.
WHITESPACE = r"[ \t\n\x0B\f\r]"


def work_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors, from spark.checkpoint.dir; a local one is made only where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = found.get() if found.isDefined() else None
    if not shared and spark.sparkContext.master.startswith("local["):
        shared = tempfile.mkdtemp(prefix="tidemark-")  # driver and executors are one process here
        spark.sparkContext.setCheckpointDir(shared)
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared.rstrip('/')}/tidemark"


_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def delete_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_tables(*tables: DataFrame) -> None:
    """Deletes work tables. Only once all that was derived from them is written itself: a lost executor must not ask for them again."""
    for t in tables:
        delete_path(t.sparkSession, t._work_path)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the work tables written inside it when it ends well; what shall stay must have been written elsewhere by then.
    The driver's JVM is asked to collect, as shuffle files go when their plans do."""
    written: list[str] = []
    token = _WRITTEN.set(written)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
    for path in written:
        delete_path(spark, path)
    free_shuffles(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Has the driver's JVM collect: shuffle files go when their plans do, which else is whenever the driver's memory is short.
    What refers to the plan of the last write goes in a first collection, the plan in a second."""
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.1)  # right after the first, a second one misses half of the plans
    spark._jvm.System.gc()


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage and survives lost executors. The shuffle files of the
    write are freed at once."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    df.write.parquet(path)
    free_shuffles(spark)
    table = spark.read.schema(df.schema).parquet(path)
    table._work_path = path
    return table


def fresh_names(columns: list[str], *names: str) -> list[str]:
    """The names, each made longer until no column is called so (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bytes of a batch that Python workers get, but for single rows that are longer. Spark itself bounds rows (10,000), not bytes.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the bytes of Arrow batches in the session, where it has not set a bound of its own: texts of any length in rows of any
    number then take the same memory of a worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions_for(spark: SparkSession, n_bytes: float, target: int = 32 << 20) -> int:
    """Partitions that hold about `target` bytes each, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_bytes // target) + 1)


def arrow_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words `[^\x20\x09-\x0D]+` of each text (null: none): id of each word, the distinct words, words per text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) and (texts.offset or np.frombuffer(texts.buffers()[1], np.int64)[0]):  # the string kernels below misread what was sliced
        texts = texts.take(pa.array(np.arange(len(texts))))
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = pc.list_flatten(lists)
    counts = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    keep = full.to_numpy(zero_copy_only=False)
    if len(keep) and not keep.all():
        owner = np.repeat(np.arange(len(counts)), counts)[keep]
        counts = np.bincount(owner, minlength=len(counts))
        flat = flat.filter(full)
    if not len(flat):
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), counts.astype(np.int64)
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, counts.astype(np.int64)


def pieces(column: pa.Array, size: int = 2 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(offset, texts) of about `size` bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + size, side="right")))
        yield start, column.slice(start, end - start)
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser over uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: The Mersenne prime that rolling hashes are taken modulo, and the base of their powers.
PRIME = (1 << 61) - 1
_BASE = 0x1B873593CC9E2D51 % PRIME
_P, _LOW, _HALF = np.uint64(PRIME), np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**64 modulo the prime."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _times_small(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime; a below it, b below 2**31."""
    high, low = (a >> np.uint64(31)) * b, (a & _HALF) * b
    return _reduced((high >> np.uint64(30)) + ((high & _LOW) << np.uint64(31)) + _reduced(low))


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, both below it."""
    high = _times_small(a, b >> np.uint64(31))
    return _reduced((high >> np.uint64(30)) + ((high & _LOW) << np.uint64(31)) + _times_small(a, b & _HALF))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of a base from the zeroth; kept and doubled as longer data comes."""
    out = _POWERS.get(base, np.ones(1, np.uint64))
    while len(out) < n:
        out = np.concatenate((out, mulmod(out, np.full(1, pow(base, len(out), PRIME), np.uint64))))
    _POWERS[base] = out
    return out[:n]


class RollingHash:
    """Hashes of all substrings of an integer array: a random value below 2**31 for each byte or number, polynomials modulo 2**61 - 1,
    then mixed with the length. Two strings of n symbols agree with a probability of about n / 2**61 whatever they are."""

    table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(33)

    def __init__(self, data: np.ndarray):
        n = len(data)
        value = self.table[data] if data.dtype == np.uint8 else mix64(data.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        terms = _times_small(_powers(_BASE, n + 1)[:n], value)
        self.inverse = _powers(pow(_BASE, -1, PRIME), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        high, low = _reduced(np.cumsum(terms >> np.uint64(31), dtype=np.uint64)), _reduced(np.cumsum(terms & _HALF, dtype=np.uint64))
        self.sums[1:] = _reduced((high >> np.uint64(30)) + ((high & _LOW) << np.uint64(31)) + low)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for arrays of bounds."""
        differ = self.sums[end] + _P - self.sums[start]
        return mix64(mulmod(_reduced(differ), self.inverse[start]) + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def planes(values: np.ndarray, kind: type) -> bytes:
    """Bytes of an array, first bytes of all values first: the equal high bytes of ids and counts then compress well."""
    values = np.ascontiguousarray(values.astype(kind))
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def values_of(data: bytes, kind: type) -> np.ndarray:
    """Array of planes()."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def trim() -> None:
    """Gives freed memory back to the machine: workers are kept and would hold the most they ever used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def split_by(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indices with it in order) for each part there is."""
    order = np.argsort(part, kind="stable")
    if len(order):
        cut = np.flatnonzero(np.diff(part[order])) + 1
        for rows in np.split(order, cut):
            yield int(part[rows[0]]), rows


def string_buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array without nulls, offsets from 0."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(words) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def hash_words(words: pa.Array | list[bytes], seed: int = 0) -> np.ndarray:
    """64-bit hash of each string: the same on every machine and in every process."""
    held = words if isinstance(words, list) else words.cast(pa.large_binary()).to_pylist()
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in held), np.uint64, len(held))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, component), component the smallest node reachable.

    Alternating large-star and small-star steps, each written to the shared folder; no edge list reaches the driver.
    Rounds grow with the logarithm of the longest path. Nodes must be orderable; nulls are dropped.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = stage_table(e, "cc")
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stage_table(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = stage_table(small, "cc")
        drop_tables(e, large)
        # Converged once every node has one parent and no parent has a parent.
        many = small.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        chain = small.join(small.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1)
        if not many.select(F.lit(1).alias("x")).unionByName(chain.select(F.lit(1).alias("x"))).take(1):
            break
        e = small
    found = small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    found._work_path = small._work_path
    return found
