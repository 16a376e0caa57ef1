"""Each corpus operator against a plain version of its definition, edge cases included."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, common, decontaminate, importance_resampling, license_scan, line_dedup, lm_scoring, ngram_join, packing, quality_rules, suffix_dedup

EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One  two\nthree"), (5, "One  two\nthree")]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "x", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, spans int").repartition(parts)


def union_find(n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    return parent, find


def mutate(rnd, items, k, pool):
    items = list(items)
    for _ in range(k):
        i, q = rnd.randrange(len(items)) if items else 0, rnd.random()
        if q < 0.4 and items:
            items[i] = rnd.choice(pool)
        elif q < 0.7 or not items:
            items.insert(i, rnd.choice(pool))
        else:
            del items[i]
    return items


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    parent, find = union_find(130)
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges for v in e if e[0] != e[1]}


def test_ngram_join(spark):
    rnd = random.Random(4)
    pool, docs, rows = [f"w{i}" for i in range(200)], [], list(EDGE)
    for i in range(10, 160):
        docs.append(mutate(rnd, rnd.choice(docs[-20:]), rnd.choice([0, 1, 2, 4]), pool) if docs and rnd.random() < 0.7 else [rnd.choice(pool) for _ in range(rnd.choice([3, 6, 9, 20, 60, 200]))])
        rows.append((i, " ".join(docs[-1])))
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    parent, find = union_find(len(rows))
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            parent[find(j)] = find(i)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    want = sorted((d, len(sets[i]), min(low[find(i)]) if sets[i] else d) for i, (d, _) in enumerate(rows))
    assert sorted(tuple(r) for r in ngram_join.near_duplicates(frame(spark, rows)).collect()) == want


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [0, 1, 2, 3])
def test_banded_distance(edits):
    rnd = random.Random(edits)
    left = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(12))) for _ in range(400)]
    right = ["".join(mutate(rnd, x, rnd.randrange(5), "ab")) for x in left]
    assert line_dedup.within_edits(left, right, edits).tolist() == [edit_distance(a, b) <= edits for a, b in zip(left, right, strict=True)]


def test_line_dedup(spark):
    rnd, seen, rows = random.Random(5), [], list(EDGE)
    for i in range(10, 50):
        new = ["".join(mutate(rnd, rnd.choice(seen), rnd.choice([0, 1, 2, 3]), "abcdé ")) if seen and rnd.random() < 0.5 else "".join(rnd.choice("abcdé ") for _ in range(rnd.choice([5, 12, 20, 31]))) for _ in range(rnd.randint(1, 4))]
        seen += new
        rows.append((i, "\n".join(new)))
    lines = [(d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if len(x) >= 10 and not x.isspace()]
    texts = sorted({x for *_, x in lines})
    parent, find = union_find(len(texts))
    for i, j in combinations(range(len(texts)), 2):
        if edit_distance(texts[i], texts[j]) <= 2:
            parent[find(j)] = find(i)
    place, first = {x: i for i, x in enumerate(texts)}, {}
    for d, i, x in lines:
        c = find(place[x])
        first[c] = min(first.get(c, (d, i)), (d, i))
    want = []
    for d, t in rows:
        parts = t.split("\n") if t is not None else []
        kept = [x for i, x in enumerate(parts) if x not in place or first[find(place[x])] == (d, i)]
        want.append((d, None if t is None else "\n".join(kept), len(parts), len(parts) - len(kept)))
    got = line_dedup.dedup_lines(frame(spark, rows), min_chars=10).select("doc_id", "text", "n_lines", "n_removed_lines").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


@pytest.mark.parametrize("chunk", [150, 1 << 20])
def test_suffix_dedup(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    rnd = random.Random(6)
    words = lambda n: " ".join(rnd.choice(["alpha", "bêta", "gamma\n"]) + str(rnd.randrange(99)) for _ in range(n))
    shared, rows = [words(30) for _ in range(3)], [*EDGE, (6, "x" * 350), (7, "ab" * 200)]
    for i in range(10, 40):
        p = rnd.choice(shared)
        rows.append((i, words(rnd.randrange(30)) + (p[rnd.randrange(40) :] + words(9) if rnd.random() < 0.6 else "")))
    rows.append((12, rows[10][1]))
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 99):
            first[b[i : i + 100]] = min(first.get(b[i : i + 100], (d, i)), (d, i))
    want = []
    for d, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - 99):
            if first[b[i : i + 100]] < (d, i):
                cover[i : i + 100] = b"\1" * 100
        want.append((d, len(b), sum(cover), bytes(x for x, y in zip(b, cover, strict=True) if not y)))
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == sorted(want)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_log_index_levels():
    index, seen = suffix_dedup.LogIndex(), {}
    rng = np.random.default_rng(0)
    for _ in range(40):
        fp, doc, a = (rng.integers(0, 50, 30).astype(t) for t in (np.uint64, np.int64, np.int64))
        late = index.add(fp, doc, a)
        for f, d, p in zip(fp, doc, a, strict=True):
            seen[f] = min(seen.get(f, (d, p)), (d, p))
        assert [seen[f] < (d, p) for f, d, p in zip(fp, doc, a, strict=True)] == late.tolist()
        sizes = [len(x[0]) for x in index.levels]
        assert all(x > 2 * y for x, y in zip(sizes, sizes[1:]))


def test_decontamination_spans(spark):
    bench = spark.createDataFrame([(1, "Alpha beta, gamma DELTA"), (2, "one two"), (3, None), (4, "??")], "item_id long, text string")
    rows = [*EDGE, (9, "x ÄLPHA alpha--Beta gamma. delta beta gamma delta"), (10, "say one\ntwo two one two!")]
    got = {r.doc_id: r for r in decontaminate.find_contamination(frame(spark, rows), bench, window=3).collect()}
    assert [(got[9].n_words, got[9].n_hit, got[9].item_ids), (got[10].n_hit, got[10].item_ids), got[1].n_words] == [(9, 7, [1]), (4, [2]), 0]
    assert [rows[-1][1][s.start : s.end] for s in got[10].spans] == ["one\ntwo", "one two"]
    assert [rows[-2][1][s.start : s.end] for s in got[9].spans] == ["alpha--Beta gamma. delta beta gamma delta"]
    small = {r.doc_id: (r.n_hit, r.item_ids) for r in decontaminate.find_contamination(frame(spark, rows), bench, window=3, max_item_bytes=9).collect()}
    assert small == {k: (r.n_hit, r.item_ids) for k, r in got.items()}


def test_chat_fold_and_round_trip(spark):
    hard = "a & b &lt;| <|im_end|>\n<|im_start|>assistant &amp;"
    log = [(1, 1, 1, "message", "user", hard), (1, 2, 2, "message", "assistant", "dra"), (1, 2, 3, "delta", None, "ft"), (1, 2, 4, "regenerate", None, None), (1, 2, 5, "delta", None, hard), (1, 1, 6, "edit", None, "new"), (1, 3, 7, "message", "user", "gone"), (1, 3, 8, "delete", None, None), (2, 1, 1, "message", None, None), (2, 2, 1, "odd", "user", "x")]
    events = spark.createDataFrame(log, "conv_id long, message_id long, seq long, kind string, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(events)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "new"), ("assistant", hard)] and got[1].loss_text == hard
    assert [(t.role, t.text) for t in got[2].turns] == [("", "")] and got[2].loss_text == ""


def test_quality_counts(spark):
    rnd = random.Random(8)
    rows = [*EDGE, (6, "a b c d e a b c d e x y z 1 2 3 4 a b c d e"), (7, "# same line\n# same line\n \n" + " ".join(f"w{i}" for i in range(90)))]
    rows += [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randrange(40)))) for i in range(10, 40)]
    for r in quality_rules.quality_rules(frame(spark, rows)).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        repeat = len({j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)})
        lines = [x for x in (r.text or "").split("\n") if x.split()]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), repeat)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "") and r.base_failed == (len(w) < 10 or 100 * repeat > 20 * len(w))


def test_packing_is_optimal_and_whole(spark):
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.choice(60, 9, replace=False) + 1)
    counts = rng.integers(1, 30, 9)
    cost = lambda ends: sum(int(c) * (min(e for e in ends if e >= n) - int(n)) for n, c in zip(lengths, counts, strict=True))
    for k in (1, 2, 3, 4):
        best = min(cost([*map(int, e), int(lengths[-1])]) for e in combinations(lengths[:-1], k - 1))
        ends = packing.optimal_buckets(lengths, counts, k)
        assert len(ends) <= k and cost(ends) == best
    rows = [*EDGE, *((i, "w " * (i * 7 % 50)) for i in range(10, 80))]
    got = packing.pack(frame(spark, rows), max_tokens=16, batch_tokens=64, buckets=3, rows_per_shard=8).collect()
    total = sum(len((t or "").split()) + 1 for _, t in rows)
    assert sum(r.n_tokens for r in got) == total and all(0 <= r.padding for r in got)
    batches = Counter((r.bucket_tokens, r.batch) for r in got)
    assert all(n * b <= 64 for (b, _), n in batches.items()) and len({(r.bucket_tokens, r.batch, r.slot) for r in got}) == len(got)


def test_resampling(spark):
    rows = [*EDGE, *((i, "good fine words here " * 5 if i % 2 else "bad worse junk there " * 5) for i in range(10, 90))]
    labels = spark.createDataFrame([(i, bool(i % 2)) for i in range(10, 60)], "doc_id long, target boolean")
    got = importance_resampling.resample(frame(spark, rows), labels, share=0.4).collect()
    assert sum(r.kept for r in got) == round(0.4 * len(rows))
    assert all(r.doc_id % 2 for r in got if r.kept and r.doc_id >= 60)
    values = spark.createDataFrame([(float(v % 37),) for v in range(500)], "x double")
    assert importance_resampling.kth_largest(values, "x", 120, bins=4, small=10) == sorted((float(v % 37) for v in range(500)), reverse=True)[119]


def test_license_inheritance(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "code"), ("a/b/y.py", "text\nLicensed under CC BY-NC 4.0.\nmore"), ("z.py", None), ("q/COPYING", ""), (None, "Released under the MIT License.")]
    got = {r.path: (r.license, r.license_origin, r.license_from) for r in license_scan.scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["a/b/c/x.py"] == ("MIT", "inherited", "a/LICENSE") and got["a/b/y.py"] == ("CC-BY-NC-4.0", "own", "a/b/y.py")
    assert got["z.py"] == (None, "none", None) and got["q/COPYING"] == (None, "none", None) and got["a/LICENSE"][0] == "MIT"


def test_lm_scores(spark):
    rnd = random.Random(9)
    rows = [*EDGE, *((i, " ".join(rnd.choice(["the", "of", "And", "río"]) + rnd.choice(["", "ing", "s"]) for _ in range(rnd.randrange(60)))) for i in range(10, 120))]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = lm_scoring.score_texts(frame(spark, rows), held).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    train = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    want = sorted((d, len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, round(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for d, t in rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    unseen = [r for r in got if r.held_out and r.n_tokens > 20]
    assert unseen and all(r.score < 0 and r.bits_per_byte < 4 for r in unseen)


def test_lm_is_a_distribution():
    """The probabilities of all continuations of a byte sum to one."""
    rng = np.random.default_rng(0)
    mixer = lm_scoring.Mixer([rng.integers(0, 9, (2, 1 << b)).astype(np.float32) for b in lm_scoring.BYTE_BITS], lm_scoring.BYTE_GATES)
    words = lm_scoring.Words(np.array([(98, b) for b in range(256)], np.uint8).reshape(-1), np.full(256, 2))
    total = np.zeros((256, 3))
    for value, slots, bit in words.decisions():
        total += mixer.log10(value, slots, lm_scoring.byte_gate(mixer.tables, slots, bit)).reshape(256, 3)
    assert (10 ** total[:, 1]).sum() == pytest.approx(1, abs=1e-6)


def test_lm_mixing_against_plain_loop():
    """Inputs, mix, refinement and one online step, decision by decision."""
    rng = np.random.default_rng(1)
    tables = [rng.integers(0, 20, (2, 8)).astype(np.float32) for _ in range(3)]
    value, gate, slots = rng.integers(0, 2, 40), rng.integers(0, 4, 40), [rng.integers(0, 8, 40) for _ in tables]
    mixer = lm_scoring.Mixer(tables, 4)
    weights, refined, hits = mixer.weights.copy(), mixer.refined.copy(), mixer.hits.copy()
    squash = lambda x: 1 / (1 + math.exp(-x))

    def mix(j, leave):
        s = []
        for t, at in zip(tables, slots, strict=True):
            zeros, ones = float(t[0][at[j]]), float(t[1][at[j]])
            if leave:
                zeros, ones = max(zeros - (1 - value[j]), 0), max(ones - value[j], 0)
            s.append(math.log((ones + 0.3) / (zeros + 0.3)))
        return s, min(12, max(-12, sum(a * w for a, w in zip(s, weights[gate[j]], strict=True))))

    for j, got in enumerate(mixer.log10(value, slots, gate)):
        _, x = mix(j, False)
        place = (x + 12) * 32 / 24
        low = min(int(place), 31)
        p = (squash(x) + refined[gate[j]][low] * (1 - place + low) + refined[gate[j]][low + 1] * (place - low)) / 2
        assert got == pytest.approx(math.log10(p if value[j] else 1 - p))
    mixer.learn(value, slots, gate)
    for g in range(4):
        own = [(j, *mix(j, True)) for j in range(40) if gate[j] == g]
        for k in range(3):
            step = sum((value[j] - squash(x)) * s[k] for j, s, x in own) / len(own)
            assert mixer.weights[g, k] == pytest.approx(weights[g, k] + 0.1 * step / math.sqrt(step * step + 1e-6))
        for cell in range(33):
            bits = [value[j] for j, _, x in own if round((x + 12) * 32 / 24) == cell]
            want = refined[g, cell] + (sum(bits) - len(bits) * refined[g, cell]) / (hits[g, cell] + len(bits))
            assert mixer.refined[g, cell] == pytest.approx(want)
    again = lm_scoring.Mixer(tables, 4, mixer.pack() * 2)
    assert np.allclose(again.weights, mixer.weights) and np.allclose(again.refined, mixer.refined)


def test_lm_word_decisions():
    """Paths of tokens from counts of sequences, with and without the token's own occurrence."""
    seen = np.array([2 | 2 << 2 | 2 << 4, 1 | 1 << 2 | 2 << 4, 1 << 4, 0], np.uint8)
    after = np.array([5, 1, 0, 0])
    for leave, want, asked in ((False, [0, 0, 2, 3], {0: [1], 1: [1], 2: [1], 3: [0]}), (True, [0, 2, 3, 3], {0: [1], 1: [1], 2: [0], 3: [0]})):
        (value, _, _, token), path = lm_scoring.token_decisions(seen, after, np.array([9, 1, 0, 0]), np.zeros(4, np.int64), np.arange(4), np.full(4, leave))
        assert path.tolist() == want
        assert {t: value[token == t].tolist() for t in range(4)} == asked


def test_lm_beats_its_base_and_repeats(spark):
    """Held-out texts that share passages with training texts score above their base; two runs agree."""
    rnd = random.Random(12)
    words = ["".join(rnd.choice(["an", "be", "ti", "on", "er"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    passages = [[rnd.choice(words) for _ in range(30)] for _ in range(12)]
    rows = [(i, " ".join(rnd.choice(passages) + [rnd.choice(words) for _ in range(20)])) for i in range(200)]
    held = F.col("doc_id") % 5 == 1
    runs = [sorted(tuple(r) for r in lm_scoring.score_texts(frame(spark, rows).coalesce(1), held).collect()) for _ in range(2)]
    assert runs[0] == runs[1]
    out = [r for r in runs[0] if r[1]]
    assert sum(r[6] for r in out) > sum(r[5] for r in out) + 0.3 * sum(r[2] for r in out)


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).where("doc_id < 0")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, target boolean")
    for out in (
        ngram_join.near_duplicates(none), line_dedup.dedup_lines(none), suffix_dedup.remove_repeats(none), decontaminate.find_contamination(none, bench), quality_rules.quality_rules(none), packing.pack(none),
        importance_resampling.resample(none, labels), lm_scoring.score_texts(none, F.lit(False)), license_scan.scan_licenses(none.withColumn("path", F.lit("a"))),
    ):
        assert out.count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
