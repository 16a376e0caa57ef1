"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

Sets of shingles fall into size bands. Each band has one scheme: a hash deals the universe into H + 1 segments, H the largest
symmetric difference that a qualifying pair can have, so a pair agrees in at least one segment's subset. A set indexes the
subsets of its own band, and probes that band and the one below. Each set allocates its probes by cost: it leaves out as many of
its smallest (most common) subsets as its size allows, and pays for further empty ones with one-deletion neighbourhoods of a few
segments, which count two points. Candidates are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_words, bound_batches, drop_tables, hash_words, mix64, partitions_for, pieces, stage_table, trim
from .links import DELETED, INDEX, KEYS, PROBE, STARS, bucket_stars, key_batch, labelled, link_components, star_nodes, with_ids

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: Bins of a set's sketch: what two sketches differ by, two sets differ by at least.
BINS = 128


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, shingle) sorted and distinct: 64-bit hashes of `size` words in a row, of the whole text where it has fewer."""
    ids, words, counts = arrow_words(texts)
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = hash_words(words)[ids]
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.repeat(counts, counts) - place
    total = np.zeros(len(ids), np.uint64)
    for j in range(size):
        here = np.flatnonzero(left > j)
        total[here] += h[here + j] * mix64(_ODD[j % len(_ODD)] + np.full(1, j, np.uint64))
    use = (left >= size) | ((place == 0) & (left < size))
    short = np.minimum(left[use], size).astype(np.uint64)
    shingle, owner = mix64(total[use] ^ (short * _ODD[7])), owner[use]
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (np.diff(owner) != 0) | (shingle[1:] != shingle[:-1])
    return owner[new], shingle[new]


def set_nodes(owner: np.ndarray, shingle: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, check, size) of each text: node and check are hashes of the set, so texts with one set are one node. 0 for empty sets."""
    size = np.bincount(owner, minlength=n)
    out = np.zeros((4, n), np.uint64)
    if len(owner):
        head = np.flatnonzero(np.concatenate(([True], np.diff(owner) != 0)))
        for k in range(4):
            out[k, owner[head]] = np.add.reduceat(mix64(shingle ^ _ODD[k]), head)
    some = (size > 0).astype(np.uint64)
    node, check = (mix64(out[k] ^ mix64(out[k + 1] + _ODD[k])) * some | some for k in (0, 2))
    return node.view(np.int64), check.view(np.int64), size


class Scheme:
    """Bands, segments and bounds for Jaccard similarity of `percent` hundredths or more."""

    def __init__(self, percent: int):
        self.percent, self.low = percent, [1]

    def grow(self, size: int) -> np.ndarray:
        while self.low[-1] <= size:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * 100 // self.percent)))
        return np.array(self.low, np.int64)

    def difference(self, total: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of a qualifying pair whose sizes sum to total."""
        return (100 - self.percent) * total // (100 + self.percent)

    def signatures(self, owner: np.ndarray, shingle: np.ndarray, size: np.ndarray, below: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, 64-bit key, role) of the signatures of each text in its own band's scheme, or as a probe in the one below."""
        low = self.grow(int(size.max(initial=1)))
        band = np.searchsorted(low, size, side="right") - 1 - below
        high = low[np.clip(band + 1, 0, len(low) - 1)] - 1
        live = (size > 0) & (band >= 0)
        segments = np.where(live, self.difference(high + high * 100 // self.percent) + 1, 0)
        spare = segments - (self.difference(np.minimum(high, size) + size) + 1)
        # So many segments of the band have deletion neighbourhoods that they pay for the empty ones all but a few sets have.
        empties = segments * np.exp(-low[np.clip(band, 0, len(low) - 1)] / np.maximum(segments, 1))
        deletable = np.maximum(segments // 32, 1 + np.ceil(empties + 2 * np.sqrt(empties)).astype(np.int64))
        deletable = np.where(segments > 1, np.minimum(deletable, segments), 0)
        keep = live[owner]
        owner, shingle = owner[keep], shingle[keep]
        base = np.cumsum(segments) - segments
        segment = (mix64(shingle ^ _ODD[3]) % np.maximum(segments[owner], 1).astype(np.uint64)).astype(np.int64)
        flat, value = base[owner] + segment, mix64(shingle ^ _ODD[4])
        total = int(segments.sum())
        sums, count = np.zeros(total, np.uint64), np.bincount(flat, minlength=total)
        np.add.at(sums, flat, value)
        of = np.repeat(np.arange(len(size)), segments)
        index = np.arange(total) - base[of]
        salt = mix64(index.astype(np.uint64) * _ODD[5] + (band[of].astype(np.uint64) + np.uint64(1)) * _ODD[6])
        # Allocation: skip the smallest subsets; empty ones beyond the spare points are paid by deletion neighbourhoods.
        empty = np.bincount(of, weights=count == 0, minlength=len(size)).astype(np.int64)
        full = (index < deletable[of]) & (count > 0)
        extra = np.minimum(np.bincount(of, weights=full, minlength=len(size)).astype(np.int64), np.maximum(0, empty - spare))
        order = np.lexsort((index, count, of))
        rank = np.empty(total, np.int64)
        rank[order] = np.arange(total) - base[of[order]]
        skipped = rank < (spare + extra)[of]
        nth = np.cumsum(full) - np.concatenate(([0], np.cumsum(full)))[base[of]]
        upgraded = full & (nth <= extra[of])
        role = np.where(skipped, 0, PROBE) | (0 if below else INDEX)
        out = [(of, mix64(sums + salt), role)]
        expand = (upgraded if below else index < deletable[of])[flat]
        f = flat[expand]
        gone = np.where(upgraded[f], PROBE, 0) | (0 if below else INDEX) | DELETED
        out.append((owner[expand], mix64(sums[f] - value[expand] + salt[f]), gone))
        text, key, role = (np.concatenate(x) for x in zip(*out, strict=True))
        used = (role & (INDEX | PROBE)) > 0
        return text[used], key[used], role[used].astype(np.uint8)


def similar_pairs(pairs: DataFrame, sets: DataFrame, by: str, percent: int) -> DataFrame:
    """(a, b) of the pairs whose whole sets reach the similarity, as ids. Both joins are on nodes and can be split where one is hot."""
    for end, items in (("a", "x"), ("b", "y")):
        pairs = pairs.join(sets.select(F.col(by).alias(end), F.col("id").alias(f"id_{end}"), F.col("items").alias(items)), end)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n = (len(x) + len(y)) // 8
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = np.sort(np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * shared >= percent * (n - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    found = pairs.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "x", "y")
    return found.mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4, percent: int = 85) -> DataFrame:
    """(key, n_shingles, component_id) for each row of docs; other columns are left out.

    A row's set: its distinct `size`-word shingles (A-Z lower-cased), with fewer words the whole sequence; null and wordless
    texts have none. Rows link when 100 * intersection >= percent * union of non-empty sets; component_id is the smallest
    key reachable by links, the row's own included. Rows with one set are one node from the start. Each bucket links its members
    to a centre; where verified links leave a bucket in several components, pairs across them are verified too, so
    no link is lost, and within a component no further pair is. Keys are integers; a null key is never a component_id of others.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"))
    # A row without a key is found again by its text.
    source = source.withColumns({"_null": F.col("_key").isNull(), "_at": F.coalesce("_key", F.xxhash64("_text"))})
    total = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = partitions_for(spark, total, 16 << 20)
    parts = 4 * n

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in pieces(batch.column(1)):
                owner, shingle = shingle_sets(texts, size)
                node, check, sizes = set_nodes(owner, shingle, len(texts))
                bins = np.bincount(owner * BINS + (shingle % np.uint64(BINS)).astype(np.int64), minlength=len(texts) * BINS)
                bins = np.minimum(bins, 255).astype(np.uint8).reshape(-1, BINS)
                bins = pa.array([x.tobytes() for x in bins], pa.binary())
                own = [batch.column(i).slice(start, len(texts)) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), bins], names=["_key", "_null", "_at", "n_shingles", "node", "check", "bins"])
        trim()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, known = Scheme(percent), np.zeros(0, np.int64)
        for batch in batches:
            for _, texts in pieces(batch.column(1)):
                owner, shingle = shingle_sets(texts, size)
                node, _, sizes = set_nodes(owner, shingle, len(texts))
                fresh = np.zeros(len(texts), bool)
                fresh[np.unique(node, return_index=True)[1]] = True
                fresh &= ~np.isin(node, known) & (sizes > 0)  # one of a task's texts with the same set is enough
                known = np.concatenate((known, node[fresh]))
                sizes = np.where(fresh, sizes, 0)
                use = fresh[owner]
                found = [scheme.signatures(owner[use], shingle[use], sizes, below) for below in (False, True)]
                of, keys, role = (np.concatenate(x) for x in zip(*found, strict=True))
                if len(keys):
                    yield key_batch(keys, node[of], role, parts)
        trim()

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in pieces(batch.column(2)):
                owner, shingle = shingle_sets(texts, size)
                node, check, _ = set_nodes(owner, shingle, len(texts))
                want = [batch.column(i).slice(start, len(texts)).to_numpy() for i in (0, 1)]
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
                good = np.flatnonzero((node == want[0]) & (check == want[1]))
                yield pa.RecordBatch.from_arrays([pa.array(node[good], pa.int64()), pa.array(check[good], pa.int64()), pa.array([shingle[ends[i] : ends[i + 1]].tobytes() for i in good], pa.binary())], names=["node", "check", "items"])

    rows = stage_table(source.mapInArrow(describe, "_key long, _null boolean, _at long, n_shingles long, node long, check long, bins binary"), "sets")
    stars = stage_table(source.mapInArrow(sign, KEYS).repartition(n, "part").mapInArrow(bucket_stars, STARS).distinct(), "stars")
    nodes = rows.join(star_nodes(stars), "node", "left_semi").groupBy("node", "check").agg(F.min(F.struct("_null", "_at")).alias("_place"), F.first("bins").alias("bins"), F.first("n_shingles").alias("n"))
    nodes = stage_table(with_ids(nodes.select("node", "check", "_place.*", "bins", "n")), "nodes")
    sets = source.join(nodes.select("_null", "_at", "node", "check").hint("merge"), ["_null", "_at"]).select("node", "check", "_text").mapInArrow(shingles, "node long, check long, items binary")
    sets = sets.groupBy("node", "check").agg(F.first("items").alias("items")).join(nodes.select("node", "check", "id"), ["node", "check"])
    sets = stage_table(sets.select("node", "id", "items"), "shingles")

    def allowed(differ: np.ndarray, small: np.ndarray, large: np.ndarray) -> np.ndarray:
        return ((100 + percent) * differ <= (100 - percent) * (small + large)) & (100 * small >= percent * large)

    found = link_components(stars, nodes, lambda pairs, by: similar_pairs(pairs, sets, by, percent), allowed)
    drop_tables(sets)
    label = labelled(rows, found)
    smallest = label.where("n_shingles > 0").groupBy("label", "part").agg(F.min("_key").alias("component_id"))
    out = label.join(smallest, ["label", "part"], "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_key")))
    return out.select(F.col("_key").alias(key), "n_shingles", "component_id")
