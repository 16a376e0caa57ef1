"""Suffix-array dedup: removes every byte of a long string that also starts earlier, by a logarithmic family of sparse suffix arrays.

Suffixes are sampled at minimizers: of every window of `length` bytes the start of its smallest k-gram. Equal windows pick the
same sample, so a repeated string always meets its earlier copy in the shard of that k-gram. Each task keeps a logarithmic
index: a batch of sampled suffixes becomes a sorted array, is merge-scanned against the levels, and levels of equal size merge.
Order in an array is that of 64-bit fingerprints of the suffix run (only equality of fixed-length strings is asked for).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, partitions_for, planes, split_by, stage_table, values_of

GRAM = 32
CHUNK = 2 << 20
#: Samples of one key beyond which its windows travel alone, dealt by their own fingerprints, instead of meeting in the key's task.
HOT = 64
FIELDS = {"fp": np.uint64, "key": np.uint32, "doc": np.int64, "tag": np.int32, "block": np.int32, "a": np.int64, "n": np.int32}
BLOBS = "kind int, part int, " + ", ".join(f"{f} binary" for f in FIELDS) + ", data binary"
#: Kinds of rows: samples, removed runs, samples to be compared byte by byte, their bytes, single windows.
SAMPLES, RUNS, MIXED, BYTES, WINDOWS = range(5)
NO_ID = np.iinfo(np.int64).max
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class LogIndex:
    """Fingerprints seen with the earliest (doc, position) of each, in sorted arrays whose sizes grow geometrically."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, fp: np.ndarray, doc: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Adds a batch; True where an earlier start of the same fingerprint is in the batch or in a level."""
        order = np.lexsort((a, doc, fp))
        f, d, p = fp[order], doc[order], a[order]
        head = np.ones(len(f), bool)
        head[1:] = f[1:] != f[:-1]
        first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(f) else np.zeros(0, np.int64)
        late = (d[first] != d) | (p[first] != p)
        for lf, ld, lp in self.levels:
            at = np.minimum(np.searchsorted(lf, f), len(lf) - 1)
            late |= (lf[at] == f) & ((ld[at] < d) | ((ld[at] == d) & (lp[at] < p)))
        self._push(f[head], d[head], p[head])
        out = np.empty(len(f), bool)
        out[order] = late
        return out

    def _push(self, f: np.ndarray, d: np.ndarray, p: np.ndarray) -> None:
        if not len(f):
            return
        while self.levels and len(self.levels[-1][0]) <= 2 * len(f):
            g, e, q = self.levels.pop()
            f, d, p = np.concatenate((f, g)), np.concatenate((d, e)), np.concatenate((p, q))
            order = np.lexsort((p, d, f))
            f, d, p = f[order], d[order], p[order]
            head = np.ones(len(f), bool)
            head[1:] = f[1:] != f[:-1]
            f, d, p = f[head], d[head], p[head]
        self.levels.append((f, d, p))


def fixed_hashes(data: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length, a 64-bit hash of every window of so many bytes: halves are mixed pair by pair, so equal strings hash alike anywhere."""

    def both(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        x = left * np.uint64(0x9FB21C651E98DF25)
        x += right
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        return x

    level, size, out, done = _BYTES[data], 1, [None] * len(lengths), [0] * len(lengths)
    while size <= max(lengths):
        for k, n in enumerate(lengths):
            if n & size:
                # The low powers of a length come first in its windows.
                out[k] = level if out[k] is None else both(out[k][: len(data) - done[k] - size + 1], level[done[k] :])
                done[k] += size
        level = both(level[:-size], level[size:]) if len(level) > size else level[:0]
        size *= 2
    return out


def sample(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, k-gram hash, run fingerprint) of each run of windows that share a minimizer; windows stay inside texts."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(data) < length:
        return none
    h, window = fixed_hashes(data, (GRAM, length))
    i = np.arange(len(h))
    low = (h & np.uint64(0xFFFFFFFF00000000)) | i.astype(np.uint64)  # ties go to the leftmost
    span, size = 1, length - GRAM + 1
    while span * 2 <= size:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if size > span:
        low = np.minimum(low[: span - size], low[size - span :])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    text = np.repeat(np.arange(len(ends)), ends - starts)
    inside = np.flatnonzero(text[: len(low)] == text[length - 1 : length - 1 + len(low)])
    if not len(inside):
        return none
    new = np.ones(len(inside), bool)
    new[1:] = (np.diff(inside) != 1) | (np.diff(at[inside]) != 0)
    head = np.flatnonzero(new)
    a, n = inside[head], np.diff(np.append(head, len(inside)))
    # A run is shorter than two windows: its first and last cover it.
    return text[a], a, n, h[at[a]], mix64(mix64(window[a] + n.astype(np.uint64)) ^ window[a + n - 1])


def sample_key(gram: np.ndarray) -> np.ndarray:
    """32 bits of a k-gram's hash by which samples meet inside a part. Not the high ones: minimizers have small values there, so
    from some GB on nearly all samples would share them with other k-grams."""
    return gram & np.uint64(0xFFFFFFFF)


def sample_part(gram: np.ndarray, parts: int) -> np.ndarray:
    """Part of a k-gram's samples, by all its bits: parts grow with the input, so part and key together tell k-grams apart at any size."""
    return ((mix64(gram) >> np.uint64(8)) % np.uint64(parts)).astype(np.int64)


def chunks(raws: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, index of the text, offset in it) of pieces of about CHUNK bytes; pieces of a longer text overlap so that each window is in one."""
    held, size = [], 0

    def joined():
        return np.frombuffer(b"".join(p for p, _, _ in held), np.uint8), np.cumsum([len(p) for p, _, _ in held]), np.array([i for _, i, _ in held]), np.array([o for _, _, o in held])

    for i, raw in enumerate(raws):
        for offset in range(0, max(1, len(raw) - length + 1), CHUNK):
            piece = raw[offset : offset + CHUNK + length - 1]
            if len(piece) < length:
                continue
            held.append((piece, i, offset))
            size += len(piece)
            if size >= CHUNK:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def _rows(kind: int, part: np.ndarray, fields: dict[str, np.ndarray], data: dict[int, bytes] | None = None) -> list[dict]:
    """A row per part with the part's values of each field as bytes."""
    out = []
    for p, rows in split_by(part):
        out.append({"kind": kind, "part": p, "data": data[p] if data else b""} | {f: planes(fields[f][rows], t) if f in fields else b"" for f, t in FIELDS.items()})
    return out


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("kind", pa.int32()), ("part", pa.int32()), *((f, pa.binary()) for f in FIELDS), ("data", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds], names=[k for k, _ in kinds])


def _joined(rows: list[dict], *fields: str) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, FIELDS[f]), *(values_of(r[f], FIELDS[f]) for r in rows)]) for f in fields]


def _raw(texts: pa.Array) -> list[bytes]:
    return [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def window_hits(fp: np.ndarray, doc: np.ndarray, tag: np.ndarray, block: np.ndarray, a: np.ndarray, length: int) -> list[dict]:
    """Rows of removed runs: windows that also start earlier, neighbours joined."""
    late = LogIndex().add(fp, doc, a)
    doc, tag, block, a = doc[late], tag[late], block[late], a[late]
    order = np.lexsort((a, tag, doc))
    doc, tag, block, a = doc[order], tag[order], block[order], a[order]
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(tag) != 0) | (np.diff(a) > 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(a)) - 1
    return _rows(RUNS, block[head], {"doc": doc[head], "tag": tag[head], "a": a[head], "n": a[last] - a[head] + length}) if len(head) else []


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 100) -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept): a row for each row of docs, other columns left out.

    spans are the maximal removed runs of the text's UTF-8 bytes (0-based start, end), kept the bytes that remain. A byte goes
    if a string of `length` bytes over it also starts earlier: at a smaller key, or in the same text at an earlier byte. Strings
    are judged on the input and never cross texts. Null and short texts lose nothing; a null key (integers only) is the largest.
    Rows that share a key and a start are equally early, so repeated rows do not remove each other.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = partitions_for(spark, total, 16 << 20)
    parts = 4 * n
    source = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"))
    source = source.withColumns({"_block": F.pmod(F.xxhash64("_key"), F.lit(n)).cast("int"), "_tag": F.hash("_text")})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LogIndex()
        for batch in batches:
            ids, block, tag = _ids(batch.column(0)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for data, ends, of, offset in chunks(_raw(batch.column(1)), length):
                piece, a, m, gram, run = sample(data, ends, length)
                if not len(a):
                    continue
                row = of[piece]
                a = a - np.concatenate(([0], ends[:-1]))[piece] + offset[piece]
                fields = {"fp": mix64(gram ^ mix64(run)), "key": sample_key(gram), "doc": ids[row], "tag": tag[row], "block": block[row], "a": a, "n": m}
                late = index.add(fields["fp"], fields["doc"], fields["a"])
                sent = {f: v[~late] for f, v in fields.items()}
                gone = {f: v[late] for f, v in fields.items()}
                gone["n"] = gone["n"] + length - 1
                rows = _rows(SAMPLES, sample_part(gram[~late], parts), sent)
                yield _batch(rows + _rows(RUNS, gone["block"], {f: gone[f] for f in ("doc", "tag", "a", "n")}))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for batch in batches:
            for r in batch.to_pylist():
                held[r["part"]].append(r)
        for part in list(held):
            fp, gram, doc, tag, block, a, m = _joined(held.pop(part), *FIELDS)
            late = LogIndex().add(fp, doc, a)
            out = _rows(RUNS, block[late], {"doc": doc[late], "tag": tag[late], "a": a[late], "n": m[late] + length - 1})
            fp, gram, doc, tag, block, a, m = (x[~late] for x in (fp, gram, doc, tag, block, a, m))
            order = np.argsort(gram, kind="stable")
            _, where, runs = np.unique(gram[order], return_index=True, return_counts=True)
            low, high = np.minimum.reduceat(fp[order], where), np.maximum.reduceat(fp[order], where)
            mixed = order[np.repeat(low != high, runs)]
            hot = np.repeat(runs > HOT, runs)[np.repeat(low != high, runs)]
            yield _batch(out + _rows(MIXED, block[mixed], {"doc": doc[mixed], "tag": tag[mixed], "a": a[mixed], "n": m[mixed], "key": gram[mixed], "fp": hot.astype(np.uint64)}))

    def rows_of(table: pa.Table) -> tuple[dict, np.ndarray, list[bytes], np.ndarray]:
        ids, raws, tags = _ids(table.column("_key").combine_chunks()), _raw(table.column("_text").combine_chunks()), table.column("_tag").to_numpy()
        return {(int(d), int(t)): i for i, (d, t) in enumerate(zip(ids, tags, strict=True))}, ids, raws, tags

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        if not rows or not left.num_rows:
            return pa.Table.from_batches([_batch([])])
        at, _, raws, _ = rows_of(left)
        doc, tag, a, m, gram, hot = _joined(rows, "doc", "tag", "a", "n", "key", "fp")
        text_of = np.array([at[d, t] for d, t in zip(doc.tolist(), tag.tolist(), strict=True)], np.int64)
        block = np.full(len(doc), rows[0]["part"], np.int32)
        out, cold = [], hot == 0
        part = (gram.astype(np.int64) * 0x85EBCA77 >> 9) % parts
        got = {f: v[cold] for f, v in {"doc": doc, "tag": tag, "a": a, "n": m, "block": block}.items()}
        pieces = {p: b"".join(raws[text_of[cold][i]][got["a"][i] : got["a"][i] + got["n"][i] + length - 1] for i in r) for p, r in split_by(part[cold])}
        out += _rows(BYTES, part[cold], got, pieces)
        if (~cold).any():
            got = [(raws[i][s : s + k + length - 1], k) for i, s, k in zip(text_of[~cold], a[~cold], m[~cold], strict=True)]
            fp, rep, step = windows_of(b"".join(p for p, _ in got), np.array([k for _, k in got]), length)
            fields = {"fp": fp, "doc": doc[~cold][rep], "tag": tag[~cold][rep], "block": block[~cold][rep], "a": a[~cold][rep] + step}
            index = LogIndex()
            late = index.add(fields["fp"], fields["doc"], fields["a"])
            out += _rows(WINDOWS, (fields["fp"][~late] % np.uint64(parts)).astype(np.int64), {f: v[~late] for f, v in fields.items()})
            gone = {f: v[late] for f, v in fields.items()}
            out += _rows(RUNS, gone["block"], {"doc": gone["doc"], "tag": gone["tag"], "a": gone["a"], "n": np.full(late.sum(), length)})
        return pa.Table.from_batches([_batch(out)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for batch in batches:
            for r in batch.to_pylist():
                held[r["part"]].append(r)
        for part in list(held):
            rows = held.pop(part)
            yield _batch([r for r in rows if r["kind"] == RUNS])
            cold = [r for r in rows if r["kind"] == BYTES]
            doc, tag, block, a, m = _joined(cold, "doc", "tag", "block", "a", "n")
            fp, rep, step = windows_of(b"".join(r["data"] for r in cold), m.astype(np.int64), length)
            single = _joined([r for r in rows if r["kind"] == WINDOWS], "fp", "doc", "tag", "block", "a")
            both = [np.concatenate(x) for x in zip((fp, doc[rep], tag[rep], block[rep], a[rep] + step), single, strict=True)]
            yield _batch(window_hits(*both, length))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, raws, tags = _ids(left.column("_key").combine_chunks()), _raw(left.column("_text").combine_chunks()), left.column("_tag").to_numpy()
        doc, tag, a, m = _joined(right.select(["doc", "tag", "a", "n"]).to_pylist(), "doc", "tag", "a", "n")
        order = np.lexsort((a, tag, doc))
        doc, tag, a, end = doc[order], tag[order], a[order], (a + m)[order]
        new = np.ones(len(doc), bool)
        new[1:] = (np.diff(doc) != 0) | (np.diff(tag) != 0)
        heads = np.flatnonzero(new)
        of = {(int(doc[s]), int(tag[s])): (s, e) for s, e in zip(heads, np.append(heads[1:], len(doc)), strict=True)}
        removed, spans, kept = [], [], []
        for d, t, raw in zip(ids.tolist(), tags.tolist(), raws, strict=True):
            s, e = of.get((d, t), (0, 0))
            runs, rest, done = [], [], 0
            if e > s:
                reach = np.maximum.accumulate(end[s:e])
                cut = np.flatnonzero(a[s + 1 : e] > reach[:-1]) + 1
                for lo, hi in zip(a[s:e][np.concatenate(([0], cut))].tolist(), reach[np.append(cut - 1, e - s - 1)].tolist(), strict=True):
                    runs.append({"start": lo, "end": hi})
                    rest.append(raw[done:lo])
                    done = hi
            rest.append(raw[done:])
            removed.append(sum(r["end"] - r["start"] for r in runs))
            spans.append(runs)
            kept.append(b"".join(rest))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"_key": left.column("_key"), "n_bytes": pa.array([len(r) for r in raws], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    first = stage_table(source.mapInArrow(gather, BLOBS), "suffixes")
    second = stage_table(first.where(F.col("kind") == SAMPLES).repartition(n, "part").mapInArrow(meet, BLOBS), "suffix-matches")
    blocks = source.repartition(n, "_block")
    mixed = second.where(F.col("kind") == MIXED).withColumn("_block", F.col("part"))
    third = blocks.groupBy("_block").cogroup(mixed.groupBy("_block")).applyInArrow(lambda x, y: fetch(x, y.drop_columns(["_block"])), BLOBS)
    fourth = third.repartition(n, "part").mapInArrow(compare, BLOBS)
    runs = first.unionByName(second).where(F.col("kind") == RUNS).unionByName(fourth).withColumn("_block", F.col("part"))
    out = blocks.groupBy("_block").cogroup(runs.groupBy("_block")).applyInArrow(finish, "_key long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("_key", key)


def windows_of(data: bytes, m: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, run, step) of each of the m windows of each run; data holds the runs' bytes, m + length - 1 each."""
    buffer = np.frombuffer(data, np.uint8)
    starts = np.cumsum(m + length - 1) - (m + length - 1)
    rep = np.repeat(np.arange(len(m)), m)
    step = np.arange(len(rep)) - np.repeat(np.cumsum(m) - m, m)
    at = starts[rep] + step
    return (fixed_hashes(buffer, (length,))[0][at] if len(at) else np.zeros(0, np.uint64)), rep, step
