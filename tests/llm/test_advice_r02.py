"""Findings of the first verdict on the corpus operators; each failed before its change."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tidemark.llm import common, decontaminate, importance_resampling, license_scan, line_dedup, links, ngram_join, quality_rules


def thue_morse(n, a, b):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join(a if x else b for x in bits[:n]), "".join(b if x else a for x in bits[:n])


def test_thue_morse_texts_are_not_equal(spark):
    for n in (1024, 4096):
        one, two = thue_morse(n, "a", "b")
        docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
        assert {r.doc_id: r.n_removed_lines for r in line_dedup.dedup_lines(docs).collect()} == {1: 0, 2: 0, 3: 1}


def test_rolling_hash_against_plain_arithmetic():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 300).astype(np.uint8)
    rolling = common.RollingHash(data)
    value = [int(x) for x in rolling.table[data]]
    for start, end in ((0, 300), (7, 7), (20, 180), (299, 300)):
        plain = sum(v * pow(common._BASE, i, common.PRIME) for i, v in enumerate(value[start:end])) % common.PRIME
        want = common.mix64(np.array([(plain + (end - start) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))
        assert rolling.of(np.array([start]), np.array([end]))[0] == want[0]


def test_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    """Many near copies of one line, and buckets cut into blocks of a few rows: one class as by brute force."""
    rnd = random.Random(11)
    base = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(i, base[: (k := rnd.randrange(len(base)))] + rnd.choice("abcdefgh") + base[k + 1 :]) for i in range(300)]
    rows += [(1000 + i, "".join(rnd.choice("abcdefgh ") for _ in range(40)) + base[:20]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = links.blocks_across
    monkeypatch.setattr(links, "blocks_across", lambda members, allowed, n: whole(members, allowed, 8))
    got = {r.doc_id: r.n_removed_lines for r in line_dedup.dedup_lines(docs).collect()}
    assert sum(got[i] for i in range(300)) == 299 and got[0] == 0
    assert all(got[i] == 0 for i in range(1000, 1030))


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "some words of a text " * 4, "en", "l", "w", "k", "t")], "doc_id long, text string, lang string, _lang string, _words string, _key string, _tag string")
    for out in (quality_rules.quality_rules(docs), line_dedup.dedup_lines(docs)):
        row = out.collect()[0]
        assert (row["_lang"], row["_words"], row["_key"], row["_tag"]) == ("l", "w", "k", "t")
    bench = spark.createDataFrame([(1, "not in there")], "item_id long, text string")
    kept = decontaminate.remove_contamination(docs.withColumnRenamed("_key", "n_words"), bench).collect()[0]
    assert kept["n_words"] == "k"


def test_decontamination_against_windows():
    """Pieces followed to both sides find what all windows find."""
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcd")
    items = [(i, " ".join(word() for _ in range(rnd.randrange(1, 16)))) for i in range(12)]
    for size in (3, 4, 5):
        known = decontaminate.Known(items, size)
        for _ in range(60):
            text = " ".join(word() for _ in range(rnd.randrange(0, 40)))
            w = text.split()
            hit, found = set(), set()
            for item, t in items:
                x = t.split()
                n = min(size, len(x))
                have = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) in have:
                        hit |= set(range(i, i + n))
                        found.add(item)
            n_words, at, ids = decontaminate.scan(known, text)
            assert (n_words, at.tolist(), ids) == (len(w), sorted(hit), found)


def test_resampling_weights_against_plain_sums(spark):
    dim, rows = 64, [(i, " ".join(random.Random(i).choice(["good", "bad", "word"]) for _ in range(i % 9))) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 3 == 0) for i in range(0, 40, 2)], "doc_id long, target boolean")
    got = {r.doc_id: r.log_weight for r in importance_resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), labels, dim=dim).collect()}
    grams = {}
    for i, t in rows:
        buckets, _ = importance_resampling.features(pa.array([t]), dim)
        grams[i] = Counter(buckets.tolist())
        words = t.split()
        assert sum(grams[i].values()) == max(0, 2 * len(words) - 1)
    raw, target = sum(grams.values(), Counter()), sum((g for i, g in grams.items() if i % 6 == 0), Counter())
    n, m = sum(raw.values()) + dim, sum(target.values()) + dim
    for i, g in grams.items():
        assert math.isclose(got[i], sum(c * (math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n)) for b, c in g.items()), abs_tol=1e-9)


def test_license_cosine_against_plain_vectors(spark):
    """Score of a file that is one line, by its own TF-IDF arithmetic."""
    texts = ["Released under the MIT License today", "plain words of a text", "the text of the words"]
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, text string")
    templates = (("MIT", "Released under the MIT License"), ("Other", "Some other words entirely"))
    row = next(r for r in license_scan.scan_licenses(files, templates=templates, min_score=0.5).collect() if r.path == "f0")
    blocks = [t.lower().split() for t in texts]
    known = {w for _, t in templates for w in t.lower().split()}
    idf = lambda w: math.log((1 + len(blocks)) / (1 + (sum(w in b for b in blocks) if w in known else 0))) + 1
    other = math.log(1 + len(blocks)) + 1
    vector = lambda ws: {w: c * (idf(w) if w in known else other) for w, c in Counter(ws).items()}

    def cosine(a, b):
        return sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    template = vector(templates[0][1].lower().split())
    spans = [blocks[0][i:j] for i in range(6) for j in range(i + 1, 7) if j - i == 5 or j - i == 6]
    assert row.license == "MIT" and abs(row.license_score - max(cosine(vector(x), template) for x in spans)) < 1e-6
