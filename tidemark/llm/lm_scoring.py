"""LM scoring by online logistic context mixing: hashed-context bit predictors, gated weights, adaptive refinement.

A text is its lower-cased words and one end. Each token is coded by binary decisions: was it seen in training after the two words
before it, else after the one word before, else at all; the first yes leaves a choice among the words so seen, paid by their
counts; a word never seen is spelled, eight decisions a byte and a closing blank. Every decision's probability comes from several
predictors (counts of earlier outcomes in hashed contexts: how often the words before were seen, the word before, the last
outcomes of the text; for bytes the last 1 to 6 bytes), mixed in the logistic domain by weights chosen by a gate, and then refined.

Counts of one, two and three words in a row cover all training rows in any number: each block of texts asks the parts of a
hash for the counts of its distinct sequences, so a sequence reaches its part once a block, however common it is.
Predictors' tables have a fixed number of slots. Weights and refinement learn online in text order, each occurrence left out of
its own prediction; tasks' results are averaged by the decisions they saw, in fixed order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_words, hash_words, mix64, partitions_for, pieces, planes, stage_table, string_buffers, trim, values_of

BLOCK = 3 << 20
END = b"\xff"
STEPS = 33
#: Log2 of the slots of the tables of word decisions, and of the byte predictors with the lengths of their contexts.
WORD_BITS, BYTE_BITS, BYTE_ORDERS = (12, 12, 14, 12, 14), (16, 16, 18, 18, 18), (1, 2, 3, 4, 6)
WORD_GATES, BYTE_GATES = 3 * 4 * 3, 8 * 6
SPAN = 1 << 14
FOLD = 256
CHUNK, TEXTS_AT_ONCE = 1 << 15, 1 << 17
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_START = np.uint64(0x8EBC6AF09C88C6E3)
BLOCKS = "block long, keys binary, nulls binary, held binary, counts binary, ids binary, words binary, sizes binary, texts long, tokens long"
FEATURES = "block long, keys binary, nulls binary, held binary, counts binary, base binary, known binary, choice binary, bytes binary, seen binary, after2 binary, after1 binary, before binary, single binary, single_sizes binary, novel binary, novel_sizes binary, novel_text binary, novel_word binary"


def zipped(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unzipped(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def squeezed(numbers: np.ndarray, kind: type) -> bytes:
    return zipped(planes(numbers, kind))


def values(data: bytes, kind: type) -> np.ndarray:
    return values_of(unzipped(data), kind)


class Words:
    """Flat bytes of words with the blank after each, and the context hashes of every byte."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        out = np.full(len(data) + len(sizes), 32, np.int64)
        out[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = data
        n = sizes + 1
        self.bytes, self.word, self.n = out, np.repeat(np.arange(len(n)), n), len(n)
        place = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
        value, self.contexts = np.zeros(len(out), np.uint64), []
        for k in range(1, BYTE_ORDERS[-1] + 1):
            before = np.where(place >= k, np.concatenate((np.zeros(min(k, len(out)), np.int64), out[:-k]))[: len(out)] + 1, 0)
            value = value * np.uint64(257) + before.astype(np.uint64)
            if k in BYTE_ORDERS:
                self.contexts.append(mix64(value * _C[k % 6] + np.uint64(k)))

    def decisions(self) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """For each bit of the bytes, the highest first: its value, the slot of each predictor, and its place in the byte."""
        for i in range(8):
            node = (1 << i) | (self.bytes >> (8 - i))
            salt = mix64(node.astype(np.uint64) * _C[4])
            yield (self.bytes >> (7 - i)) & 1, [((c ^ salt) * _C[0] >> np.uint64(64 - b)).astype(np.int64) for c, b in zip(self.contexts, BYTE_BITS, strict=True)], np.full(len(self.bytes), i)


def levels(n: np.ndarray) -> np.ndarray:
    """Count to a level: exact to 3, then by powers of two."""
    return np.where(n < 4, n, np.minimum(np.frexp(np.maximum(n, 1).astype(np.float64))[1] + 1, 15)).astype(np.int64)


def token_decisions(seen: np.ndarray, after2: np.ndarray, after1: np.ndarray, before: np.ndarray, place: np.ndarray, left_out: np.ndarray):
    """(value, slots, gate, token) of the word decisions in text order, and the path of each token: 0 seen after two words, 1 after
    one, 2 at all, 3 never. left_out: True where the token's own occurrence is taken out of the counts."""
    out = left_out.astype(np.int64)
    n3, n2, n1 = ((seen >> s & 3).astype(np.int64) - out > 0 for s in (0, 2, 4))
    path = np.where(n3, 0, np.where(n2, 1, np.where(n1, 2, 3)))
    many2, many1 = after2.astype(np.int64) - out, after1.astype(np.int64) - out
    l2, l1 = levels(many2), levels(many1)
    hit, far = n3.astype(np.int64), path > 1
    last = [np.where(place >= j, np.concatenate((np.zeros(min(j, len(hit)), np.int64), hit[:-j]))[: len(hit)], 0) for j in range(1, 7)]
    was_far = np.where(place >= 1, np.concatenate((np.zeros(min(1, len(hit)), np.int64), far[:-1])), 0)
    run = sum(x << j for j, x in enumerate(last))
    parts = []
    for d, ask in enumerate((many2 > 0, (path > 0) & (many1 > 0), path > 1)):
        at = np.flatnonzero(ask)
        contexts = (l2 * 8 + (run & 7), l1 * 8 + (run & 3) * 2 + was_far, before.astype(np.int64) * 16 + l1, run * 2 + was_far, (l2 * 16 + l1) * 4 + (run & 3))
        slots = [((c[at] * 3 + d).astype(np.uint64) * _C[k] >> np.uint64(64 - b)).astype(np.int64) for k, (c, b) in enumerate(zip(contexts, WORD_BITS, strict=True))]
        sure = np.where(d == 0, l2[at] > 2, l1[at] > 2).astype(np.int64) + (np.where(d == 0, l2[at], l1[at]) > 6)
        parts.append(((path[at] == d).astype(np.int64), slots, (d * 4 + (run[at] & 3)) * 3 + sure, at))
    order = np.argsort(np.concatenate([p[3] for p in parts]), kind="stable")
    joined = lambda f: np.concatenate([f(p) for p in parts])[order]
    return (joined(lambda p: p[0]), [joined(lambda p, k=k: p[1][k]) for k in range(len(WORD_BITS))], joined(lambda p: p[2]), joined(lambda p: p[3])), path


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class Mixer:
    """Predictor tables (counts of zeros and ones), gated weights and the refinement of the mixed probability."""

    def __init__(self, tables: list[np.ndarray], gates: int, state: np.ndarray | None = None):
        k = len(tables)
        self.tables, self.gates = tables, gates
        self.plain = [np.log((ones + 0.3) / (zeros + 0.3)) for zeros, ones in tables]
        # A zero's or a one's own occurrence taken out.
        self.without = [np.log(np.concatenate(((ones + 0.3) / (np.maximum(zeros - 1, 0) + 0.3), (np.maximum(ones - 1, 0) + 0.3) / (zeros + 0.3)))) for zeros, ones in tables]
        self.weights, self.refined = np.full((gates, k), 1.5 / k), np.tile(squash(np.linspace(-12, 12, STEPS)), (gates, 1))
        self.pace, self.mass, self.hits = np.zeros((gates, k)), np.zeros(gates), np.full((gates, STEPS), 40.0)
        if state is not None:
            sums = self.unpack(state)
            self.weights = np.where(sums[1][:, None] > 0, sums[0] / np.maximum(sums[1], 1)[:, None], self.weights)
            self.refined = np.where(sums[3] > 0, sums[2] / np.maximum(sums[3], 1e-9), self.refined)

    def pack(self) -> np.ndarray:
        """What tasks add up: weights and refinement times the decisions behind them, and these."""
        hits = self.hits - 40.0
        return np.concatenate([(self.weights * self.mass[:, None]).ravel(), self.mass, (self.refined * hits).ravel(), hits.ravel()])

    def unpack(self, state: np.ndarray) -> list[np.ndarray]:
        shapes, out, at = ((self.gates, len(self.tables)), (self.gates,), (self.gates, STEPS), (self.gates, STEPS)), [], 0
        for shape in shapes:
            size = int(np.prod(shape))
            out.append(state[at : at + size].reshape(shape))
            at += size
        return out

    def mixed(self, value: np.ndarray | None, slots: list[np.ndarray], gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Predictors' inputs and the mix; with a value, its own outcome is left out of the counts."""
        s = np.empty((len(gate), len(slots)))
        for k, at in enumerate(slots):
            s[:, k] = self.plain[k][at] if value is None else self.without[k][value * len(self.plain[k]) + at]
        return s, np.clip(np.einsum("ij,ij->i", s, self.weights[gate]), -12, 12)

    def final(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        place = (x + 12) * ((STEPS - 1) / 24)
        low = np.minimum(place.astype(np.int64), STEPS - 2)
        part = place - low
        return np.clip((squash(x) + self.refined[gate, low] * (1 - part) + self.refined[gate, low + 1] * part) / 2, 1e-9, 1 - 1e-9)

    def log10(self, value: np.ndarray, slots: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """Log10 probability of each decision's value."""
        p = self.final(self.mixed(None, slots, gate)[1], gate)
        return np.log10(np.where(value == 1, p, 1 - p))

    def learn(self, value: np.ndarray, slots: list[np.ndarray], gate: np.ndarray, rate: float = 0.1) -> None:
        """One online step: weights move against the error, refinement towards what happened."""
        s, x = self.mixed(value, slots, gate)
        error = value - squash(x)
        n = np.bincount(gate, minlength=self.gates)
        used = n > 0
        for k in range(s.shape[1]):
            step = np.bincount(gate, weights=error * s[:, k], minlength=self.gates)[used] / n[used]
            self.pace[used, k] += step * step
            self.weights[used, k] += rate * step / np.sqrt(self.pace[used, k] + 1e-6)
        self.mass += n
        cell = gate * STEPS + np.rint((x + 12) * ((STEPS - 1) / 24)).astype(np.int64)
        got = np.bincount(cell, minlength=self.hits.size).reshape(self.hits.shape)
        ones = np.bincount(cell, weights=value, minlength=self.hits.size).reshape(self.hits.shape)
        self.hits += got
        self.refined += (ones - got * self.refined) / self.hits


def byte_gate(tables: list[np.ndarray], slots: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
    """Place in the byte and how much the contexts of two and four bytes have seen."""
    seen = lambda k: tables[k][0][slots[k]].astype(np.int64) + tables[k][1][slots[k]]
    return bit * 6 + np.minimum(levels(seen(3)), 4) // 2 * 2 + (seen(1) > 30)


def spelled(mixer: Mixer, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """Log10 probability of each word's bytes and the blank."""
    total, ends = np.zeros(len(sizes)), np.concatenate(([0], np.cumsum(sizes)))
    raw = np.frombuffer(data, np.uint8)
    for start in range(0, len(sizes), 4096):
        part = sizes[start : start + 4096]
        words = Words(raw[ends[start] : ends[start + len(part)]], part)
        for value, slots, bit in words.decisions():
            total[start : start + len(part)] += np.bincount(words.word, weights=mixer.log10(value, slots, byte_gate(mixer.tables, slots, bit)), minlength=len(part))
    return total


class Block:
    """A row of the blocks table: its tokens' sequences of one, two and three words as keys."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.keys, self.nulls, self.held = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["nulls"], bool), np.frombuffer(row["held"], bool)
        words, ids = values(row["counts"], np.int32).astype(np.int64), values(row["ids"], np.int32).astype(np.int64)
        self.data, self.sizes = unzipped(row["words"]) + END, np.append(values(row["sizes"], np.int32), len(END)).astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(self.sizes)))
        self.texts = [self.data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        # One end after the words of each text; its id is the last.
        self.n = words + 1
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.place = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.ids = np.full(len(self.doc), len(self.sizes) - 1)
        self.ids[self.place < np.repeat(words, self.n)] = ids
        self.train = ~self.held[self.doc]

    def sequences(self, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(distinct keys in order, the key of each token by number, training tokens of each key) for one, two and three words; `bits` of the hash of two and three are compared."""
        one = hash_words(self.texts)
        order = np.argsort(one)
        rank = np.empty(len(one), np.int64)
        rank[order] = np.arange(len(one))
        yield one[order], rank[self.ids], np.bincount(rank[self.ids[self.train]], minlength=len(one))
        one = one[self.ids]
        back = lambda j: np.where(self.place >= j, np.concatenate((np.full(min(j, len(one)), _START), one[:-j]))[: len(one)], _START)
        two = mix64(back(1) * _C[0] + one)
        three = mix64(back(2) * _C[1] + two)
        for key in (two, three):
            distinct, number = numbered(key >> np.uint64(64 - bits), bits)
            yield distinct, number, np.bincount(number[self.train], minlength=len(distinct))


def numbered(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below 2**bits in order, and the number of each key among them."""
    room = np.uint64(64 - bits)
    if len(keys) >> int(room):
        distinct, number = np.unique(keys, return_inverse=True)
        return distinct, number
    both = np.sort(keys << room | np.arange(len(keys), dtype=np.uint64))  # key and place in one number sort fast
    at, both = (both & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64), both >> room
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    number = np.empty(len(keys), np.int64)
    number[at] = np.cumsum(new) - 1
    return both[new], number


def part_bounds(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Where each of `parts` equal ranges of keys of so many bits begins among sorted keys, and the end."""
    starts = np.array([min(p * (1 << bits) // parts, (1 << bits) - 1) for p in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, starts), [len(keys)]))


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as steps between them."""
    return squeezed(np.diff(keys, prepend=np.uint64(0)), np.uint64)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(values(data, np.uint64), dtype=np.uint64)


def tree_sum(rows: DataFrame, tasks: int, count: str) -> list:
    """Rows (g, k, data: numbers of type `count` as bytes) added up by k, at most FOLD rows of a k in one group at a time."""

    def add(table: pa.Table) -> pa.Table:
        held = sorted(table.to_pylist(), key=lambda r: r["g"])
        total = np.frombuffer(held[0]["data"], count).copy()
        for r in held[1:]:
            total += np.frombuffer(r["data"], count)
        return pa.table({"g": pa.array([held[0]["g"] // FOLD], pa.int64()), "k": pa.array([held[0]["k"]], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    while True:
        rows = rows.groupBy("k", F.floor(F.col("g") / FOLD).alias("_to")).applyInArrow(add, "g long, k int, data binary")
        if tasks <= FOLD:
            return sorted(rows.select("k", "data").collect(), key=lambda r: r["k"])
        tasks = tasks // FOLD + 1


def score_texts(docs: DataFrame, held_out, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of docs; other columns are left out.

    Rows where held_out (a column expression, null: false) is false train the model. Tokens: words of the lower-cased (A-Z)
    text and one end. base_score: add-half unigram log10 probability of the tokens; score: the model's log10 probability of
    the whole text, words never seen spelled out; bits_per_byte: its cost over the bytes of the words, a blank after each and the end. Null and empty texts are
    one end token; repeated rows each count. Keys are integers or null. Only tables of fixed size, weights and totals reach the driver or are broadcast.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_held"))
    total = source.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = partitions_for(spark, total, 16 << 20)
    parts = n
    bits = min(56, max(40, int(total).bit_length() + 10))  # some thousand times the sequences there can be

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, texts in pieces(batch.column(1), BLOCK):
                ids, words, counts = arrow_words(texts)
                data, offsets = string_buffers(words)
                own = [batch.column(i).slice(start, len(texts)) for i in (0, 2)]
                held = own[1].to_numpy(zero_copy_only=False)
                cells = [block, own[0].fill_null(0).to_numpy().tobytes(), own[0].is_null().to_numpy(zero_copy_only=False).tobytes(), held.tobytes(), squeezed(counts, np.int32), squeezed(ids, np.int32), zipped(data.tobytes()), squeezed(np.diff(offsets), np.int32), int((~held).sum()), int((counts + 1)[~held].sum())]
                yield pa.RecordBatch.from_pylist([dict(zip(names, cells, strict=True))], pa.schema([(f, pa.int64() if f in ("block", "texts", "tokens") else pa.binary()) for f in names]))
                block += 1
            trim()

    names = [x.split()[0] for x in BLOCKS.split(", ")]
    blocks = stage_table(source.mapInArrow(tokenize, BLOCKS), "lm-blocks")


    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                asked = [(keys, count, part_bounds(keys, parts, b)) for (keys, _, count), b in zip(block.sequences(bits), (64, bits, bits), strict=True)]
                cells = [[(packed(keys[at[p] : at[p + 1]]), squeezed(count[at[p] : at[p + 1]], np.int32)) for p in range(parts)] for keys, count, at in asked]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts), pa.int32()), pa.array([block.block] * parts, pa.int64()), *(pa.array([x[j] for x in c], pa.binary()) for c in cells for j in (0, 1))], names=["part", "block", "k1", "c1", "k2", "c2", "k3", "c3"])
                trim()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(list)
        for batch in batches:
            for r in batch.to_pylist():
                held[r["part"]].append(r)
        for part in sorted(held):
            rows = held.pop(part)
            out, new = [], 0
            for j in (1, 2, 3):
                keys = [unpacked(r[f"k{j}"]) for r in rows]
                distinct, number = numbered(np.concatenate(keys), bits) if j > 1 else np.unique(np.concatenate(keys), return_inverse=True)
                sums = np.bincount(number, weights=np.concatenate([values(r[f"c{j}"], np.int32) for r in rows]), minlength=len(distinct)).astype(np.int64)
                new += int((sums > 0).sum()) if j == 1 else 0
                ends = np.cumsum([len(k) for k in keys])
                out.append(pa.array([squeezed(sums[number[e - len(k) : e]], np.int64) for k, e in zip(keys, ends, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([r["block"] for r in rows], pa.int64()), pa.array([part] * len(rows), pa.int32()), *out, pa.array([new if not i else 0 for i in range(len(rows))], pa.int64())], names=["block", "part", "n1", "n2", "n3", "new"])
            trim()

    asked = blocks.mapInArrow(ask, "part int, block long, " + ", ".join(f"k{j} binary, c{j} binary" for j in (1, 2, 3))).repartition(n, "part")
    counts = stage_table(asked.mapInArrow(count, "block long, part int, n1 binary, n2 binary, n3 binary, new long"), "lm-counts")
    distinct = counts.agg(F.coalesce(F.sum("new"), F.lit(0))).first()[0]
    all_tokens, ends = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()

    def describe(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [features(Block(row), right.to_pylist()) for row in left.to_pylist()]
        trim()
        return pa.Table.from_pylist(out, pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.binary()) for x in FEATURES.split(", ")]))

    def features(block: Block, answers: list[dict]) -> dict:
        found = []
        answers = sorted(answers, key=lambda r: r["part"])  # in the order of the keys
        for j, (_, number, _) in enumerate(block.sequences(bits), 1):
            got = np.concatenate([values(r[f"n{j}"], np.int64) for r in answers])
            found.append(got[number])
            if j == 1:
                each = np.zeros(len(block.sizes), np.int64)
                each[block.ids] = found[0]
        n1, n2, n3 = found
        one = np.append(ends, n1)[np.where(block.place > 0, np.arange(len(n1)), 0)]
        two = np.append(ends, n2)[np.where(block.place > 0, np.arange(len(n2)), 0)]
        choice = np.log10(np.where(n3 > 0, n3 / np.maximum(two, 1), np.where(n2 > 0, n2 / np.maximum(one, 1), np.where(n1 > 0, n1 / max(all_tokens, 1), 1.0))))
        base = np.log10(n1 + 0.5) - np.log10(all_tokens + 0.5 * (distinct + 1))
        sums = lambda w: np.bincount(block.doc, weights=w, minlength=len(block.n))
        seen = np.minimum(n3, 2) | np.minimum(n2, 2) << 2 | np.minimum(n1, 2) << 4
        used = np.zeros(len(each), bool)
        used[block.ids[block.train]] = True
        single, never = np.flatnonzero((each == 1) & used), np.flatnonzero(n1 == 0)
        novel, word = np.unique(block.ids[never], return_inverse=True)
        code = lambda x: np.where(x < 128, x, np.minimum(128 + np.frexp(x.astype(np.float64))[1], 255)).astype(np.uint8).tobytes()
        before = np.concatenate(([0], block.ids[:-1]))[: len(n1)]
        low = (hash_words(block.texts) & np.uint64(255)).astype(np.uint8)
        return {
            "block": block.block, "keys": block.keys.tobytes(), "nulls": block.nulls.tobytes(), "held": block.held.tobytes(), "counts": squeezed(block.n, np.int64),
            "base": sums(base).tobytes(), "known": sums(n1 > 0).astype(np.int64).tobytes(), "choice": sums(choice).tobytes(), "bytes": sums(block.sizes[block.ids] + (block.ids < len(block.sizes) - 1)).astype(np.int64).tobytes(),
            "seen": zipped(seen.astype(np.uint8).tobytes()), "after2": zipped(code(two)), "after1": zipped(code(one)), "before": zipped(np.where(block.place > 0, low[before], 0).astype(np.uint8).tobytes()),
            "single": zipped(b"".join(block.texts[i] for i in single)), "single_sizes": squeezed(block.sizes[single], np.int32), "novel": zipped(b"".join(block.texts[i] for i in novel)), "novel_sizes": squeezed(block.sizes[novel], np.int32),
            "novel_text": squeezed(block.doc[never], np.int32), "novel_word": squeezed(word, np.int32),
        }

    both = blocks.repartition(n, "block").groupBy("block").cogroup(counts.repartition(n, "block").groupBy("block"))
    table = stage_table(both.applyInArrow(lambda x, y: describe(x, y), FEATURES), "lm-features")
    tasks = table.rdd.getNumPartitions()

    def decisions_of(row: dict, learning: bool) -> Iterator[tuple]:
        """Word decisions of a block, of some texts at a time, with the text of each; learning: of training tokens, left out of the counts."""
        size, held = values(row["counts"], np.int64), np.frombuffer(row["held"], bool)
        ends = np.cumsum(size)
        wide = lambda x: np.where(x < 128, x, 1 << np.clip(x.astype(np.int64) - 129, 0, 62))
        codes = [np.frombuffer(unzipped(row[f]), np.uint8) for f in ("seen", "after2", "after1", "before")]
        first = 0
        while first < len(size):
            after = max(first + 1, int(np.searchsorted(ends, ends[first] - size[first] + TEXTS_AT_ONCE, side="right")))
            own, part = size[first:after], slice(int(ends[first] - size[first]), int(ends[after - 1]))
            doc = np.repeat(np.arange(first, after), own)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own)
            seen, after2, after1, before = (x[part] for x in codes)
            keep = ~held[doc] if learning else slice(None)
            doc = doc[keep]
            (value, slots, gate, token), _ = token_decisions(seen[keep], wide(after2[keep]), wide(after1[keep]), before[keep], place[keep], np.full(len(doc), learning))
            for start in range(0, len(value), CHUNK):
                some = slice(start, start + CHUNK)
                yield value[some], [x[some] for x in slots], gate[some], doc[token[some]]
            first = after

    def singles(row: dict) -> Iterator[Words]:
        sizes, raw = values(row["single_sizes"], np.int32).astype(np.int64), np.frombuffer(unzipped(row["single"]), np.uint8)
        at = np.concatenate(([0], np.cumsum(sizes)))
        for start in range(0, len(sizes), 4096):
            part = sizes[start : start + 4096]
            yield Words(raw[at[start] : at[start + len(part)]], part)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros((2, 1 << b), np.int64) for b in WORD_BITS + BYTE_BITS]

        def add(k: int, value: np.ndarray, slots: np.ndarray) -> None:
            got = np.bincount(slots * 2 + value, minlength=2 << (WORD_BITS + BYTE_BITS)[k])
            tables[k] += got.reshape(-1, 2).T

        for batch in batches:
            for row in batch.to_pylist():
                for value, slots, _, _ in decisions_of(row, True):
                    for k, at in enumerate(slots):
                        add(k, value, at)
                for words in singles(row):
                    for value, slots, _ in words.decisions():
                        for k, at in enumerate(slots):
                            add(len(WORD_BITS) + k, value, at)
                trim()
        flat = np.concatenate([t.ravel() for t in tables])
        for k, start in enumerate(range(0, len(flat), SPAN)):
            if (span := flat[start : start + SPAN]).any():
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([k], pa.int32()), pa.array([span.tobytes()], pa.binary())], names=["g", "k", "data"])

    sizes = [2 << b for b in WORD_BITS + BYTE_BITS]
    flat = np.zeros(sum(sizes), np.int64)
    for r in tree_sum(table.select("held", "counts", "seen", "after2", "after1", "before", "single", "single_sizes").mapInArrow(gather, "g long, k int, data binary"), tasks, "int64"):
        got = np.frombuffer(bytes(r["data"]), np.int64)
        flat[r["k"] * SPAN : r["k"] * SPAN + len(got)] = got
    shared = spark.sparkContext.broadcast([x.reshape(2, -1).astype(np.float32) for x in np.split(flat, np.cumsum(sizes)[:-1])])

    def mixers(state: list[np.ndarray] | None = None) -> tuple[Mixer, Mixer]:
        k = len(WORD_BITS)
        return Mixer(shared.value[:k], WORD_GATES, state and state[0]), Mixer(shared.value[k:], BYTE_GATES, state and state[1])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, byte = mixers()
        for batch in batches:
            for row in batch.to_pylist():
                for value, slots, gate, _ in decisions_of(row, True):
                    word.learn(value, slots, gate)
                for words in singles(row):
                    for value, slots, bit in words.decisions():
                        byte.learn(value, slots, byte_gate(byte.tables, slots, bit))
                trim()
        g = TaskContext.get().partitionId()
        for k, m in enumerate((word, byte)):
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int64()), pa.array([k], pa.int32()), pa.array([m.pack().tobytes()], pa.binary())], names=["g", "k", "data"])

    learned = tree_sum(table.select("held", "counts", "seen", "after2", "after1", "before", "single", "single_sizes").mapInArrow(learn, "g long, k int, data binary"), tasks, "float64")
    state = spark.sparkContext.broadcast([np.frombuffer(bytes(r["data"])) for r in learned] or None)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, byte = mixers(state.value)
        for batch in batches:
            for row in batch.to_pylist():
                size, held = values(row["counts"], np.int64), np.frombuffer(row["held"], bool)
                got = np.frombuffer(row["choice"]).copy()
                for value, slots, gate, doc in decisions_of(row, False):
                    got += np.bincount(doc, weights=word.log10(value, slots, gate), minlength=len(size))
                each = spelled(byte, unzipped(row["novel"]), values(row["novel_sizes"], np.int32).astype(np.int64))
                got += np.bincount(values(row["novel_text"], np.int32), weights=each[values(row["novel_word"], np.int32)], minlength=len(size))
                keys = pa.array(np.frombuffer(row["keys"], np.int64), pa.int64(), mask=np.frombuffer(row["nulls"], bool))
                columns = [keys, pa.array(held), pa.array(size), pa.array(np.frombuffer(row["known"], np.int64)), pa.array(np.full(len(size), all_tokens, np.int64)), pa.array(np.frombuffer(row["base"])), pa.array(got), pa.array(-got / np.log10(2) / np.frombuffer(row["bytes"], np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["_key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])
                trim()

    kinds = "_key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return table.drop("single", "single_sizes").mapInArrow(score, kinds).withColumnRenamed("_key", key)
