"""From candidate buckets to classes: stars around a centre first, then pairs across what verified stars leave apart."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, drop_tables, mix64, stage_table

#: Roles of a signature: in the index, a probe, with one element deleted.
INDEX, PROBE, DELETED = 1, 2, 4
KEYS = "part int, key binary, node binary, role binary"
STARS = "h long, c long, x long"


def key_batch(keys: np.ndarray, nodes: np.ndarray, roles: np.ndarray, parts: int) -> pa.RecordBatch:
    """Signatures as a row per part, their values as bytes."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    runs = [r for r in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(r)]
    rows = [(int(part[r[0]]), keys[r].tobytes(), nodes[r].tobytes(), roles[r].tobytes()) for r in runs]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], names=["part", "key", "node", "role"])


def star_rows(key: np.ndarray, node: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, centre, member): each bucket's members around one that is both indexed and probing; where there is none, its
    (indexed, probing) pairs. Buckets with the same members give one. Bucket 0: pairs that need no completion."""
    order = np.lexsort((role & DELETED, node, key))
    key, node, role = key[order], node[order], role[order]
    cut = np.concatenate(([True], key[1:] != key[:-1]))
    head = np.flatnonzero(cut)
    size = np.diff(np.append(head, len(key)))
    group = np.repeat(np.arange(len(head)), size)
    varied = np.zeros(len(head), bool)
    np.logical_or.at(varied, group[1:], (node[1:] != node[:-1]) & ~cut[1:])
    probes = np.zeros(len(head), bool)
    np.logical_or.at(probes, group, (role & PROBE) > 0)
    indexed = np.zeros(len(head), bool)
    np.logical_or.at(indexed, group, (role & INDEX) > 0)
    keep = (varied & probes & indexed)[group]
    if not keep.any():
        return (np.zeros(0, np.int64),) * 3
    key, node, role, group = key[keep], node[keep], role[keep], group[keep]
    able = (role & (INDEX | PROBE | DELETED)) == (INDEX | PROBE)
    centre = np.full(len(head), np.iinfo(np.int64).max)
    np.minimum.at(centre, group[able], node[able])
    lone = centre[group] == np.iinfo(np.int64).max
    rest = defaultdict(lambda: ([], []))
    for g, x, r in zip(group[lone].tolist(), node[lone].tolist(), role[lone].tolist(), strict=True):
        rest[g][0].append((x, r)) if r & INDEX else None
        rest[g][1].append((x, r)) if r & PROBE else None
    direct = {(min(x, y), max(x, y)) for i, p in rest.values() for x, r in i for y, s in p if x != y and not (r & s & DELETED)}
    group, node = group[~lone], node[~lone]
    c = centre[group]
    first = np.ones(len(node), bool)
    first[1:] = (group[1:] != group[:-1]) | (node[1:] != node[:-1])
    group, node, c = group[first], node[first], c[first]
    mark = np.zeros(len(head), np.uint64)
    np.add.at(mark, group, mix64(node.view(np.uint64)))
    mark = mark.view(np.int64)[group]
    other = node != c
    rows = np.unique(np.stack((mark[other], c[other], node[other]), axis=1), axis=0)
    extra = np.array([(0, x, y) for x, y in direct], np.int64).reshape(-1, 3)
    rows = np.concatenate((rows, extra))
    return rows[:, 0], rows[:, 1], rows[:, 2]


def bucket_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of key_batch(), dealt by part, to stars."""
    held = defaultdict(list)
    for batch in batches:
        for r in batch.to_pylist():
            held[r["part"]].append(r)
    for part in list(held):
        rows = held.pop(part)
        got = [np.frombuffer(b"".join(r[f] for r in rows), t) for f, t in (("key", np.uint64), ("node", np.int64), ("role", np.uint8))]
        h, c, x = star_rows(*got)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (h, c, x)], names=["h", "c", "x"])


def pairs_across(members: pa.Table, allowed: Callable, block: int = 64) -> pa.Table:
    """(a, b): pairs of a bucket's members in different components that sizes (n) and sketches (bins) allow; of two blocks (at:
    i, j) of a large bucket those across them. A pair that shares several buckets (hs) comes from the one with the smallest number only.

    allowed(differ, n of the smaller, n of the larger) judges the L1 distance of the sketches and the sizes; arrays."""
    n = members.column("n").to_numpy()
    order = np.argsort(n, kind="stable")
    n, ids, component, at = (members.column(c).to_numpy()[order] for c in ("n", "id", "component", "at"))
    one = members.column("i")[0].as_py() == members.column("j")[0].as_py() if len(n) else True
    bins, h = members.column("bins").to_pylist(), members.column("h")[0].as_py() if len(n) else 0
    shared = members.column("hs").to_pylist()
    before = [{z for z in shared[i] if z < h} for i in order]
    sketch = np.frombuffer(b"".join(bins), np.uint8).reshape(len(n), -1)[order].astype(np.int16)
    out = []
    for start in range(0, len(n), block):
        i = np.arange(start, min(start + block, len(n)))
        fits = allowed(np.zeros(len(n) - start, np.int64), np.full(len(n) - start, n[i[-1]]), n[start:])
        j = start + np.flatnonzero(fits | (n[start:] <= n[i[-1]]))
        x, y = np.nonzero((component[i][:, None] != component[j][None, :]) & (i[:, None] < j[None, :]) & (one | (at[i][:, None] != at[j][None, :])))
        for part in range(0, len(x), 1 << 16):
            u, v = i[x[part : part + (1 << 16)]], j[y[part : part + (1 << 16)]]
            ok = allowed(np.abs(sketch[u] - sketch[v]).sum(axis=1, dtype=np.int64), n[u], n[v])
            first = np.array([before[p].isdisjoint(before[q]) for p, q in zip(u[ok].tolist(), v[ok].tolist(), strict=True)], bool)
            u, v = u[ok][first], v[ok][first]
            out.append(np.sort(np.stack((ids[u], ids[v])), axis=0))
    a, b = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def star_nodes(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("c").alias("node")).unionByName(stars.select(F.col("x").alias("node"))).distinct()


def with_ids(nodes: DataFrame) -> DataFrame:
    """Nodes (node, check: two independent 64-bit hashes of a row each) with an id of their own: the node, or for texts that
    share it by chance another number each."""
    return nodes.withColumn("id", F.when(F.col("check") == F.min("check").over(Window.partitionBy("node")), F.col("node")).otherwise(F.xxhash64("node", "check")))


def blocks_across(members: DataFrame, allowed: Callable, rows: int) -> DataFrame:
    """Members (h, id, n) with the block pair (i, j) and own block `at` of each task that compares them. A bucket of up to
    `rows` members is one block; a larger one is cut by size, and blocks meet whose sizes allow links."""
    rank = F.row_number().over(Window.partitionBy("h").orderBy("n", "id"))
    placed = members.withColumn("at", F.floor((rank - 1) / rows).cast("int"))
    bounds = placed.groupBy("h", "at").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left, right = (bounds.select("h", F.col("at").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")) for x in "ij")
    pairs = left.where(F.col("high_i").isNotNull()).join(right, "h").where("i < j")
    pairs = pairs.where(allowed(F.lit(0), F.least("high_i", "low_j"), F.col("low_j"))).select("h", "i", "j")
    across = pairs.select("h", "i", "j", F.explode(F.array("i", "j")).alias("at"))
    return placed.withColumns({"i": F.col("at"), "j": F.col("at")}).unionByName(placed.join(across, ["h", "at"]))


def link_components(stars: DataFrame, nodes: DataFrame, verify: Callable[[DataFrame, str], DataFrame], allowed: Callable, rows: int = 4096) -> DataFrame:
    """(node, check, component) of all nodes (node, check, id, n, bins). verify: pairs (a, b) of nodes or of ids, as told, to pairs of ids that link.

    Every pair of a star is verified. Buckets in which a star's centre and member are then in different components get the
    pairs across components verified, where sketches allow the link. Pairs inside a component are left: they change no class.
    """
    pairs = stars.select(F.least("c", "x").alias("a"), F.greatest("c", "x").alias("b")).distinct()
    pairs = stage_table(pairs, "pairs")
    twins = nodes.where("id <> node").select(F.col("node").alias("a"), F.col("node").alias("b")).distinct()
    edges = stage_table(verify(pairs.unionByName(twins), "node"), "links")
    found = components(edges)
    known = stage_table(nodes.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "known")
    failed = pairs.join(edges, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        failed = failed.join(known.select(F.col("node").alias(end), F.col("component").alias(f"in_{end}")), end)
    apart = failed.where("in_a <> in_b").select("a", "b").distinct()
    own = stars.where("h <> 0").withColumns({"a": F.least("c", "x"), "b": F.greatest("c", "x")})
    own = stars.join(own.join(apart, ["a", "b"], "left_semi").select("h").distinct(), "h", "left_semi")
    members = own.select("h", F.col("c").alias("node")).unionByName(own.select("h", F.col("x").alias("node"))).distinct()
    members = stage_table(members.join(known.select("node", "id", "component"), "node").drop("node"), "members")
    drop_tables(stars, found, known)
    # Blocks are laid out on narrow rows; sketches and buckets (at most the signatures of one text) join the tasks, and move once.
    wide = members.groupBy("id").agg(F.first("component").alias("component"), F.collect_list("h").alias("hs")).join(nodes.select("id", "bins"), "id")
    placed = blocks_across(members.select("h", "id").join(nodes.select("id", "n"), "id"), allowed, rows)
    tasks = placed.join(wide, "id").groupBy("h", "i", "j")
    more = tasks.applyInArrow(lambda t: pairs_across(t, allowed), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
    more = stage_table(more, "pairs")
    drop_tables(members, pairs)
    classes = components(edges.unionByName(verify(more, "id"))).withColumnRenamed("node", "id")
    drop_tables(edges, more)
    return nodes.select("node", "check", "id").join(classes, "id", "left").select("node", "check", F.coalesce("component", "id").alias("component"))


def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (node, check and more) with the class they are of as columns label and part; a row in no star is its own text's."""
    out = rows.join(found, ["node", "check"], "left")
    return out.withColumns({"label": F.coalesce("component", "node"), "part": F.when(F.col("component").isNull(), F.col("check")).otherwise(F.lit(0).cast("long"))}).drop("component")
