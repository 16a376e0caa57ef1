"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts, each text scanned once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, stage_table

#: Bytes that separate words once A-Z are lower-cased: all ASCII but digits and a-z. Others, UTF-8 sequences included, are word bytes.
_DELIMITERS = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90))
_NORMAL = bytes.maketrans(_DELIMITERS + bytes(range(65, 91)), b" " * len(_DELIMITERS) + bytes(range(97, 123)))

SPANS = "n_words long, n_hit long, item_ids array<long>, spans array<struct<start:int,end:int>>"


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class Known:
    """Automaton over the items: pieces of half a window of longer items, and shorter items as they are.

    Any window of `size` words holds one of its item's pieces of (size + 1) // 2 words, cut from the item's start on; so a piece
    that occurs is followed to both sides, and a run of `size` equal words or more is a run of windows. Patterns are about as long as the items."""

    def __init__(self, items: list[tuple[int, str | None]], size: int):
        import ahocorasick

        self.size, self.piece, self.vocabulary = size, (size + 1) // 2, {}
        numbers, stream, owner, self.whole, self.starts = {}, [-2], [-1], [], []

        def pattern(words: list[bytes]) -> int:
            at = numbers.setdefault(f" {b' '.join(words).decode('latin-1')} ", len(numbers))
            if at == len(self.whole):
                self.whole.append([])
                self.starts.append([])
            return at

        for item, text in items:
            words = normal_words(text)
            if 0 < len(words) < size:
                self.whole[pattern(words)].append((len(words), item))
            elif words:
                for k in range(0, len(words) - self.piece + 1, self.piece):
                    self.starts[pattern(words[k : k + self.piece])].append(len(stream) + k)
                stream += [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] + [-2]
                owner += [item] * len(words) + [-1]
        self.stream, self.owner, self.starts = np.array(stream, np.int64), owner, [np.array(x, np.int64) for x in self.starts]
        self.automaton = ahocorasick.Automaton() if numbers else None
        for text, at in numbers.items():
            self.automaton.add_word(text, at)
        if numbers:
            self.automaton.make_automaton()

    def reach(self, at: np.ndarray, ids: np.ndarray, place: int, step: int) -> np.ndarray:
        """How many words beyond each place of the stream equal those beyond a place of the text."""
        out, live, j = np.zeros(len(at), np.int64), np.arange(len(at)), step
        while len(live):
            live = live[self.stream[at[live] + j] == ids[place + 1 + j]]
            out[live] += 1
            j += step
        return out


_BUILT: dict[tuple, Known] = {}


def known_of(shared, size: int) -> Known:
    """Of a broadcast list of items; built once in a worker, which holds one at a time."""
    at = (shared._path, size)
    if at not in _BUILT:
        _BUILT.clear()
        _BUILT[at] = Known(shared.value, size)
    return _BUILT[at]


def scan(known: Known, text: str | None) -> tuple[int, np.ndarray, set]:
    """Words of the text, index of each hit word, ids of items with an occurring window."""
    words = normal_words(text)
    none = len(words), np.zeros(0, np.int64), set()
    if not words or known.automaton is None:
        return none
    joined = b" " + b" ".join(words) + b" "
    hits = list(known.automaton.iter(joined.decode("latin-1")))
    if not hits:
        return none
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    cover, items, followed, ids = np.zeros(len(words) + 1, np.int64), set(), {}, None
    for end, pattern in hits:
        last = int(np.searchsorted(blanks, end))  # a pattern that ends at blank k ends with word k - 1
        for n, item in known.whole[pattern]:
            cover[last - n] += 1
            cover[last] -= 1
            items.add(item)
        first = last - known.piece
        at = known.starts[pattern]
        # Of a run that was followed already, nothing new.
        at = at[[followed.get(d, -1) < last for d in (at - first).tolist()]] if len(at) else at
        if not len(at):
            continue
        if ids is None:
            ids = np.array([-3, *(known.vocabulary.get(w, -1) for w in words), -3], np.int64)
        left, right = known.reach(at, ids, first, -1), known.reach(at + known.piece - 1, ids, last - 1, 1)
        for start, before, after in zip(at.tolist(), left.tolist(), right.tolist(), strict=True):
            followed[start - first] = last + after
            if before + known.piece + after >= known.size:
                cover[first - before] += 1
                cover[last + after] -= 1
                items.add(known.owner[start])
    return len(words), np.flatnonzero(np.cumsum(cover[:-1]) > 0), items


def original_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as code-point offsets [start, end) of the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    word = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return [{"start": int(chars[starts[r[0]]]), "end": int(chars[ends[r[-1]]])} for r in runs if len(r)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_item_bytes: int = 2 << 20) -> DataFrame:
    """docs with n_words, n_hit, item_ids (distinct, ascending) and spans (hit runs in the original text) in place of columns so named.

    Items of at most max_item_bytes text (some 120 MB as an automaton) go to the executors as one. A larger benchmark is cut by a
    hash of the item into as many parts; texts are then written out with a row number, scanned once per part, one part after
    another, and what the parts found is put together. A window is `window` consecutive item words; an item with fewer words is one
    window; an item without words has none. Null or empty texts have no words and no hits. Repeated rows each get their own
    result; other columns, in any number, are left as they are.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = int(2 * total // max_item_bytes) + 1 if total > max_item_bytes else 1
    added = ["n_words", "n_hit", "item_ids", "spans"]
    if text in added:
        raise ValueError(f"the text column cannot be named {text}")
    own = docs.select(*(c for c in docs.columns if c not in added))

    def share(k: int):
        some = items if parts == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k)
        return spark.sparkContext.broadcast([(x["i"], x["t"]) for x in some.select("i", "t").toArrow().to_pylist()])

    if parts == 1:
        shared, kept = share(0), own.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = known_of(shared, window)
            for batch in batches:
                texts = batch.column(kept.index(text)).to_pylist()
                found = [scan(known, t) for t in texts]
                span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                spans = [original_spans(t, hit) if len(hit) else [] for t, (_, hit, _) in zip(texts, found, strict=True)]
                more = [pa.array([n for n, _, _ in found], pa.int64()), pa.array([len(h) for _, h, _ in found], pa.int64()), pa.array([sorted(i) for *_, i in found], pa.list_(pa.int64())), pa.array(spans, span)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*kept, *added])

        return own.mapInArrow(run, spark.createDataFrame([], f"{fields_of(own)}, {SPANS}").schema)
    (row,) = fresh_names(own.columns, "_row")
    held = stage_table(own.withColumn(row, F.monotonically_increasing_id()), "scanned")
    found = None
    for k in range(parts):
        shared = share(k)

        def hits(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = known_of(shared, window)
            for batch in batches:
                out = [(r, h.tolist(), sorted(i)) for r, (_, h, i) in ((r, scan(known, t)) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) if len(h)]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["r", "hit", "item_ids"])

        part = stage_table(held.select(row, text).mapInArrow(hits, "r long, hit array<long>, item_ids array<long>"), "part-hits")
        found = part if found is None else found.unionByName(part)
    found = found.groupBy(F.col("r").alias(row)).agg(F.flatten(F.collect_list("hit")).alias("_hit"), F.array_sort(F.flatten(F.collect_list("item_ids"))).alias("_ids"))
    (hit, ids), kept = fresh_names([*own.columns, row], "_hit", "_ids"), own.columns
    both = held.join(found.select(row, F.col("_hit").alias(hit), F.col("_ids").alias(ids)), row, "left").drop(row)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists, item_ids = (batch.column(i).to_pylist() for i in (kept.index(text), len(kept), len(kept) + 1))
            runs = [np.unique(np.array(x or [], np.int64)) for x in lists]
            spans = [original_spans(t, h) if len(h) else [] for t, h in zip(texts, runs, strict=True)]
            more = [pa.array([len(normal_words(t)) for t in texts], pa.int64()), pa.array([len(h) for h in runs], pa.int64()), pa.array([x or [] for x in item_ids], pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *more], names=[*kept, *added])

    return both.mapInArrow(put_together, spark.createDataFrame([], f"{fields_of(own)}, {SPANS}").schema)


def fields_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without rows that hold a benchmark window; columns as in docs."""
    clash = [c for c in docs.columns if c in ("n_words", "n_hit", "item_ids", "spans")]
    other = dict(zip(clash, fresh_names(docs.columns, *(f"_{c}" for c in clash)), strict=True))
    found = find_contamination(docs.withColumnsRenamed(other), benchmark, other.get(text, text), **options)
    return found.where("n_hit = 0").select(*(F.col(other[c]).alias(c) if c in other else F.col(c) for c in docs.columns))
