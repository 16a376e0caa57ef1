"""The whole pipeline against a plain one, stage by stage as the docstrings define them."""

import math
import random
import re
from collections import Counter
from itertools import combinations

import corpus_pipeline

WORD, BLANK = r"[^\x20\x09-\x0D]+", re.compile(r"[ \t\n\x0B\f\r]*")


def classes_of(w):
    out = [0] * 5
    for c in w:
        out[0 if c.isascii() and c.isupper() else 1 if c in "0123456789" else 3 if ord(c) > 127 else 2 if c.isprintable() and not c.isalpha() else 4] += 1
    return out


def shares(counts):
    return [c / max(1, sum(counts)) for c in counts]


def distance(p, q):
    half = lambda x, m: x * math.log2(x / m) / 2 if x > 0 else 0.0
    return math.sqrt(max(0.0, sum(half(a, (a + b) / 2) + half(b, (a + b) / 2) for a, b in zip(p, q, strict=True))))


def quality(rows):
    words = [re.findall(WORD, t or "") for _, t, _ in rows]
    known = {}
    for lang in {x[2] for x in rows}:
        seen = Counter(w for ws, x in zip(words, rows, strict=True) if x[2] == lang for w in ws)
        total = sum(seen.values())
        top = sorted((-c, w) for w, c in seen.items() if c >= 0.004 * total)[:40]
        ref = shares([-c for c, _ in top] + [total + sum(c for c, _ in top)])
        classes = [sum(c * classes_of(w)[i] for w, c in seen.items()) for i in range(5)]
        known[lang] = [w for _, w in top], ref, shares(classes), 0.9 * distance([0.0] * len(top) + [1.0], ref)
    out = []
    for row, ws in zip(rows, words, strict=True):
        common, ref, class_ref, bound = known[row[2]]
        seen = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        repeat = len({j for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)})
        hits = [ws.count(w) for w in common]
        far = distance(shares([*hits, len(ws) - sum(hits)]), ref)
        odd = distance(shares(list(map(sum, zip(*map(classes_of, ws)))) or [0] * 5), class_ref)
        if len(ws) >= 10 and 100 * repeat <= 20 * len(ws) and (len(ws) < 60 or (odd <= 0.30 and far <= min(0.65, bound))):
            out.append(row)
    return out


def near(a, b):
    if abs(len(a) - len(b)) > 2 or sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values()) > 4:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= 2


def classes(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def place(row):
    return (row[0] is None, row[0] or 0)


def unique_lines(rows):
    at = [(place(r), i, r[1], x) for r in rows for i, x in enumerate((r[1] or "").split("\n")) if not BLANK.fullmatch(x)]
    texts = sorted({x for *_, x in at})
    long = [i for i, x in enumerate(texts) if len(x) >= 24]
    of = dict(zip(texts, classes(len(texts), ((i, j) for i, j in combinations(long, 2) if near(texts[i], texts[j]))), strict=True))
    first = {}
    for x in at:
        first[of[x[3]]] = min(first.get(of[x[3]], x[:3]), x[:3])
    out = []
    for d, t, lang in rows:
        lines = (t or "").split("\n")
        kept = [x for i, x in enumerate(lines) if x not in of or first[of[x]] == (place((d,)), i, t)]
        if len(kept) == len(lines) or not BLANK.fullmatch("".join(kept)):
            out.append((d, t if len(kept) == len(lines) else "\n".join(kept), lang))
    return out


def one_of_each(rows):
    rows = sorted(set(rows), key=lambda r: (place(r), r[1] or ""))
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    found = classes(len(rows), ((i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])))
    return [r for i, r in enumerate(rows) if found[i] == i]


def normal(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def decontaminated(rows, items):
    windows = set()
    for t in items:
        w = normal(t)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} or ({tuple(w)} - {()})
    sizes = {len(w) for w in windows}
    return [r for r in rows for w in [normal(r[1])] if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))]


def least_padding(lengths, k):
    seen = sorted(Counter(lengths).items())
    best = [0.0] + [math.inf] * len(seen)
    for _ in range(k):
        best = [min([best[i]] + [best[j] + sum(c * (seen[i - 1][0] - n) for n, c in seen[j:i]) for j in range(i)]) for i in range(len(seen) + 1)]
    return best[-1]


def test_pipeline(spark, tmp_path):
    rnd = random.Random(11)
    vocabulary = {lang: [f"{lang}{''.join(rnd.choice('aeiouklmnrst') for _ in range(rnd.randint(2, 8)))}" for _ in range(220)] for lang in ("x", "y")}
    weight = [1 / (i + 1) for i in range(220)]
    line = lambda lang: " ".join(rnd.choices(vocabulary[lang], weight, k=rnd.randint(4, 12))).capitalize() + "."
    text = lambda lang: "\n".join(line(lang) for _ in range(rnd.randint(2, 16)))
    items = [" ".join(rnd.choices(vocabulary["x"], k=n)) for n in (10, 14, 25)] + ["Only three words", "??", None]
    common, rows = line("x"), []
    for i in range(70):
        lang = "x" if i % 3 else "y"
        t = text(lang)
        if i % 9 == 4:
            t += "\n" + (common if i % 2 else common[:-1] + "!") + "\nshort one"
        if i % 11 == 5:
            t += " " + items[i % 3].replace(" ", ", ", 3).upper()
        rows.append((i, t, lang))
    rows += [(100 + i, rows[3 * i + 1][1] + " more", "x") for i in range(4)]  # copies: the lines go
    rows += [(200 + i, rows[3 * i + 2][1].replace("\n", " "), "x") for i in range(4)]  # copies on one line: near duplicates
    rows += [(220 + i, "\n".join(" ".join(f"{rnd.randrange(10**6)}" for _ in range(9)) for _ in range(9)), "x") for i in range(2)]  # digits
    rows += [(240, " ".join(f"zz{rnd.choice('abcdefgh')}{rnd.choice('abcdefgh')}{rnd.choice('abcdefgh')}" for _ in range(90)), "y")]  # no common word
    rows += [(300, None, "x"), (301, "", "x"), (302, " \n ", "x"), (303, "one two", "y"), (304, "same words here and there " * 9, "x")]
    rows += [(400, text("x"), "x")] * 2 + [(None, text("y"), "y"), (None, text("x"), "x"), (7, text("x"), "x"), (500, text("x") + "\nonly three words", "x")]
    rnd.shuffle(rows)
    spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    want, docs = rows, spark.read.parquet(f"{tmp_path}/documents.parquet")
    plain = [quality, unique_lines, one_of_each, lambda r: decontaminated(r, items)]
    text_of = lambda r: (place(r), r[1] or "")
    for k, ((_, stage), step) in enumerate(zip(corpus_pipeline.STAGES, plain)):
        before, want = len(want), step(want)
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(((r.doc_id, r.text, r.lang) for r in docs.collect()), key=text_of) == sorted(want, key=text_of)
        assert k == 1 or len(want) < before  # each rule has something to do
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = [(d, len(re.findall(WORD, t or "")) + 1) for d, t, _ in want]
    pieces = [(d, p, 2048 * p, min(2048, n - 2048 * p)) for d, n in sizes for p in range((n + 2047) // 2048)]
    assert sorted(map(str, ((r.doc_id, r.piece, r.start_token, r.n_tokens) for r in got))) == sorted(map(str, pieces))
    assert sum(r.padding for r in got) == least_padding([n for *_, n in pieces], 8) and all(r.bucket_tokens - r.n_tokens == r.padding for r in got)
    assert len({(r.bucket_tokens, r.batch, r.slot) for r in got}) == len(got)
