"""Line dedup: segment-partition edit join of all lines, verified with banded bit-parallel edit distance.

A line is cut into max_edits + 1 segments; one of them stands unchanged in any line within max_edits edits. Segments are indexed by
number and line length, a line probes the index of its own and the next shorter lengths with the substrings that can match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh_names, mix64, partitions_for, stage_table, trim
from .links import INDEX, KEYS, PROBE, STARS, bucket_stars, key_batch, labelled, link_components, star_nodes, with_ids

CHUNK = 1 << 20
BINS = 64
NO_ID = (1 << 63) - 1
ADDED = ("n_lines", "n_removed_lines")


def line_chunks(texts: list[str | None], min_chars: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(lines, text, line number) of the lines of min_chars or more, about CHUNK code points at a time."""
    held, size = [], 0
    joined = lambda: ([x for x, _, _ in held], np.array([t for _, t, _ in held], np.int64), np.array([i for _, _, i in held], np.int64))
    for t, text in enumerate(texts):
        for i, line in enumerate((text or "").split("\n")):
            if len(line) >= min_chars and not line.isspace():
                held.append((line, t, i))
                size += len(line)
                if size >= CHUNK:
                    yield joined()
                    held, size = [], 0
    if held:
        yield joined()


def line_points(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, start of each line, length of each)."""
    n = np.array([len(x) for x in lines], np.int64)
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(n) - n, n


def line_nodes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(node, check): two halves of a 128-bit hash of each line; neither is zero."""
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines), np.int64).reshape(-1, 2) | 1
    return both[:, 0].copy(), both[:, 1].copy()


def signatures(own: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, role): each line's own segments, and its substrings that can equal a segment of a line of its length or up to
    `edits` shorter (multi-match-aware positions). A key is a hash of the substring's code points, salted by length and number."""
    k = edits + 1
    data, starts, n = line_points(own)
    lines = np.arange(len(n))
    out = []

    def add(use: np.ndarray, at: np.ndarray, size: np.ndarray, i: int, length: np.ndarray, role: int) -> None:
        salt = mix64(length[use].astype(np.uint64) * np.uint64(64) + np.uint64(i))
        begin = starts[use] + at[use]
        out.append((lines[use], begin << 32 | begin + size[use], salt, np.full(len(begin), role, np.uint8)))

    for delta in range(edits + 1):
        length = n - delta
        small, long_ones = length // k, length % k
        for i in range(k):
            size = small + (i >= k - long_ones)
            at = i * small + np.maximum(0, i - (k - long_ones))
            if not delta:
                add(n >= k, at, size, i, length, INDEX | PROBE)
            for shift in range(-edits, edits + delta + 1):
                if (not delta and not shift) or abs(shift) > i or abs(shift - delta) > k - 1 - i:
                    continue
                add((length >= k) & (at + shift >= 0) & (at + shift + size <= n), at + shift, size, i, length, PROBE)
    line, span, salt, role = (np.concatenate(x) for x in zip(*out, strict=True))
    spans, place = np.unique(span, return_inverse=True)  # segments for other lengths are often the same
    data, bounds = data.tobytes(), zip((4 * (spans >> 32)).tolist(), (4 * (spans & 0xFFFFFFFF)).tolist(), strict=True)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in bounds), np.uint64, len(spans))
    return line, mix64(hashes[place] + salt), role


def within_edits(left: list[str], right: list[str], edits: int) -> np.ndarray:
    """True where the edit distance of left[i] and right[i] is at most edits.

    State d holds, as bits, the diagonals of a band of 2 * edits + 1 that d edits reach; all pairs take a step together."""
    ok = np.zeros(len(left), bool)
    size = np.array([len(x) for x in right], np.int64)
    live = np.flatnonzero(np.abs(size - np.array([len(x) for x in left], np.int64)) <= edits)
    order = live[np.argsort(-size[live], kind="stable")]
    start = 0
    while start < len(order):
        longest = int(size[order[start]]) + 1
        group = order[start : start + max(1, min(4096, (4 << 20) // longest))]
        start += len(group)
        width = longest + 3 * edits + 1
        text, pattern = np.full((len(group), width), 0xFFFFFFFE, np.uint32), np.full((len(group), width), 0xFFFFFFFF, np.uint32)
        for row, p in enumerate(group):
            text[row, : len(right[p])] = np.frombuffer(right[p].encode("utf-32-le", "surrogatepass"), np.uint32)
            pattern[row, edits : edits + len(left[p])] = np.frombuffer(left[p].encode("utf-32-le", "surrogatepass"), np.uint32)
        text, pattern = np.ascontiguousarray(text.T), np.ascontiguousarray(pattern.T)
        n, m = size[group], np.array([len(left[p]) for p in group], np.int64)
        band = np.uint64((1 << (2 * edits + 1)) - 1)
        state = [np.full(len(group), ((1 << (d + 1)) - 1) << edits, np.uint64) & band for d in range(edits + 1)]
        alive = np.searchsorted(-n, -np.arange(longest), side="left")  # pairs whose text is longer than each position
        for j in range(longest - 1):
            c = int(alive[j])
            same = np.zeros(c, np.uint64)
            for o in range(2 * edits + 1):
                same |= (pattern[j + o, :c] == text[j, :c]).astype(np.uint64) << np.uint64(o)
            before = None
            for d in range(edits + 1):
                old = state[d][:c].copy()
                new = old & same
                if d:
                    new |= before | (before >> np.uint64(1)) | ((state[d - 1][:c] << np.uint64(1)) & band)
                state[d][:c] = new
                before = old
        ok[group] = ((state[edits] >> (m - n + edits).astype(np.uint64)) & np.uint64(1)) == 1
    return ok


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", max_edits: int = 2, min_chars: int = 24, min_equal: int | None = None) -> DataFrame:
    """docs with repeated lines taken out of the text, and n_lines, n_removed_lines in place of columns so named.

    Lines of min_chars code points or more link when they are equal or within max_edits edits; of a class of linked lines the
    one with the smallest (key, line number) stays and the others go, in whatever document. Shorter lines of min_equal code
    points or more (none where it is null) link when they are equal; yet shorter and blank lines stay.
    Null texts stay null with no lines; the empty text is one line. Repeated rows share key and line numbers, so they
    do not remove each other's lines; a null key is the largest. Keys are integers. Other columns are left as they are.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(*(c for c in docs.columns if c not in ADDED))
    source = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_key"), F.col(text).cast("string").alias("_text"))
    total = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = partitions_for(spark, total, 16 << 20)
    parts = 4 * n
    least = min_chars if min_equal is None else min(min_equal, min_chars)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, of, number in line_chunks(batch.column(1).to_pylist(), least):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column(2).take(pa.array(of)), pa.array(number, pa.int32()), *map(pa.array, line_nodes(own))], names=["_key", "_tag", "line", "node", "check"])
        trim()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.int64)  # sorted
        for batch in batches:
            for own, _, _ in line_chunks(batch.column(1).to_pylist(), min_chars):
                node, _ = line_nodes(own)
                fresh = np.unique(node, return_index=True)[1]
                at = np.searchsorted(known, node[fresh])
                fresh = fresh[np.append(known, 0)[at] != node[fresh]]  # one of a task's equal lines is enough; no node is zero
                known = np.sort(np.concatenate((known, node[fresh])), kind="stable")
                line, keys, role = signatures([own[i] for i in fresh], max_edits)
                if len(keys):
                    yield key_batch(keys, node[fresh][line], role, parts)
        trim()

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [set(x) for x in batch.column(0).to_pylist()]
            for own, of, _ in line_chunks(batch.column(1).to_pylist(), min_chars):
                node, check = line_nodes(own)
                hit = [i for i, x in enumerate(node.tolist()) if x in asked[of[i]]]
                data, starts, size = line_points([own[i] for i in hit])
                bins = [np.minimum(np.bincount(data[a : a + m] % BINS, minlength=BINS), 255).astype(np.uint8).tobytes() for a, m in zip(starts, size, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node[hit], pa.int64()), pa.array(check[hit], pa.int64()), pa.array([own[i] for i in hit], pa.string()), pa.array(size, pa.int64()), pa.array(bins, pa.binary())], names=["node", "check", "t", "n", "bins"])

    def verify(pairs: DataFrame, by: str) -> DataFrame:
        for end, line in (("a", "x"), ("b", "y")):
            pairs = pairs.join(nodes.select(F.col(by).alias(end), F.col("id").alias(f"id_{end}"), F.col("t").alias(line)), end)

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = within_edits(batch.column(2).to_pylist(), batch.column(3).to_pylist(), max_edits)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

        found = pairs.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "x", "y")
        return found.mapInArrow(check, "a long, b long")

    tagged = source.withColumn("_tag", F.xxhash64("_text"))
    where = stage_table(tagged.mapInArrow(lines, "_key long, _tag long, line int, node long, check long"), "lines")
    stars = stage_table(source.mapInArrow(sign, KEYS).repartition(n, "part").mapInArrow(bucket_stars, STARS).distinct(), "line-stars")
    first = where.groupBy("node", "check").agg(F.min(F.struct("_key", "line", "_tag")).alias("at"))
    asked = first.join(star_nodes(stars), "node", "left_semi").groupBy(F.col("at._key").alias("_key"), F.col("at._tag").alias("_tag")).agg(F.collect_set("node").alias("_asked"))
    nodes = tagged.join(asked, ["_key", "_tag"]).select("_asked", "_text").mapInArrow(wanted, "node long, check long, t string, n long, bins binary")
    nodes = stage_table(with_ids(nodes.groupBy("node", "check").agg(F.first("t").alias("t"), F.first("n").alias("n"), F.first("bins").alias("bins"))), "line-nodes")
    found = link_components(stars, nodes, verify, lambda differ, small, large: (differ <= 2 * max_edits) & (large - small <= max_edits))
    classes = labelled(first, found)
    kept = classes.groupBy("label", "part").agg(F.min("at").alias("kept"))
    keeper = classes.select("node", "check", "label", "part").join(kept, ["label", "part"]).select("node", "check", "kept")
    gone = where.join(keeper, ["node", "check"]).where((F.col("_key") != F.col("kept._key")) | (F.col("line") != F.col("kept.line")) | (F.col("_tag") != F.col("kept._tag")))
    k, t, g = fresh_names(docs.columns, "_key", "_tag", "_gone")
    gone = gone.groupBy(F.col("_key").alias(k), F.col("_tag").alias(t)).agg(F.collect_set("line").alias(g))
    out = docs.withColumns({k: F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), t: F.xxhash64(F.col(text).cast("string"))}).join(gone, [k, t], "left")
    all_lines = F.split(F.col(text), "\n")
    rest = F.array_join(F.filter(all_lines, lambda x, i: ~F.array_contains(F.col(g), i)), "\n")
    new = F.when(F.col(g).isNull(), F.col(text)).otherwise(rest)
    return out.select(
        *(new.alias(c) if c == text else F.col(c) for c in docs.columns), F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col(g).isNull(), 0).otherwise(F.size(g)).cast("long").alias("n_removed_lines"),
    )
