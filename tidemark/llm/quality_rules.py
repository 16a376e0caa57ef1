"""Quality rules: counts of words, symbols and repeats, and divergence from language references. Native operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, drop_tables, fresh_names, stage_table

#: Character classes of word characters, and the symbols among the last of them; what is beyond ASCII is a class, and so is the
#: rest (lower-case ASCII, control characters).
UPPER, DIGITS, SYMBOLS, OTHER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>", "!\"'()+,-./:;=?@[\\]^_`{}~"
REST = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, (*range(1, 32), 127)))
RULE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept")


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WHITESPACE}+"), "")


def marks(text: Column) -> Column:
    """A text without whitespace as its marked characters: A, 0, # and ! for upper case, digits, symbols and other punctuation, and those beyond ASCII."""
    return F.translate(text, UPPER + DIGITS + SYMBOLS + OTHER + REST, "A" * len(UPPER) + "0" * len(DIGITS) + "#" * len(SYMBOLS) + "!" * len(OTHER))


def count_of(text: Column, mark: Column) -> Column:
    """How often a character stands in a text."""
    return (F.length(text) - F.length(F.replace(text, mark, F.lit("")))).cast("long")


def class_counts(marked: Column, length: Column) -> Column:
    """Upper case, digits, punctuation, characters beyond ASCII, the rest; of marks() and the length of the text."""
    nul = F.lit("\0")  # translate() cannot take it out
    upper, digits, punctuation = (count_of(marked, F.lit(c)) for c in "A0!")
    punctuation = punctuation + count_of(marked, F.lit("#"))
    known = F.length(F.replace(F.translate(marked, "A0!#", ""), nul, F.lit(""))).cast("long")
    return F.array(upper, digits, punctuation, known, length.cast("long") - F.length(marked) + count_of(marked, nul))


def repeats_in_order(windows: Column) -> Column:
    """(value, place) of windows in order of value; empty where no value occurs twice."""
    order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), order).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def repeated_places(order: Column) -> Column:
    """Places of windows that occur twice or more, ascending; of repeats_in_order()."""
    twice = F.zip_with(order, F.slice(order, 2, F.greatest(F.size(order), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull()))))


def covered_words(places: Column, window: int) -> Column:
    """Words under windows that begin at the places."""
    gaps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of two probability arrays; 0 where p is all zero."""
    half = lambda x, m: F.when(x > 0, x * F.log2(x / m) / 2).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)))


def shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang", min_share: float = 0.004, max_words: int = 40) -> DataFrame:
    """A row per language: _lang, its common words (share of all words at least min_share, most frequent first, at most
    max_words; ties by the word), their shares with the rest last, and the shares of character classes. Counts cover every
    row; a language has at most 1/min_share words of that share, so no list grows with the data. A null language is ''.
    """
    if max_words > 250:
        raise ValueError("max_words is at most 250")
    vocabulary = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang"), F.explode(words_of(F.col(text))).alias("w")).groupBy("_lang", "w").agg(F.count("*").alias("c"))
    vocabulary = stage_table(vocabulary, "vocabulary")
    bins = class_counts(F.col("m"), F.length("w"))
    vocabulary_marks = vocabulary.withColumn("m", marks(F.col("w")))
    totals = vocabulary_marks.select("_lang", "c", bins.alias("k")).groupBy("_lang").agg(F.sum("c").alias("total"), *(F.sum(F.col("c") * F.col("k")[i]).alias(f"k{i}") for i in range(5)))
    totals = stage_table(totals, "totals")
    common = vocabulary.join(totals.select("_lang", "total"), "_lang").where(F.col("c") >= min_share * F.col("total"))
    lists = common.groupBy("_lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "w"))), 1, max_words).alias("top"))
    none = F.array().cast("array<struct<c:bigint,w:string>>")
    top = totals.join(lists, "_lang", "left").withColumn("top", F.coalesce("top", none)).withColumn("n", F.transform("top", lambda x: -x["c"]))
    rest = F.col("total") - F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)
    out = top.select(
        "_lang", F.transform("top", lambda x: x["w"]).alias("_common"), shares(F.concat("n", F.array(rest)), F.col("total")).alias("_word_ref"),
        shares(F.array(*(F.col(f"k{i}") for i in range(5))), sum((F.col(f"k{i}") for i in range(1, 5)), F.col("k0"))).alias("_class_ref"),
    )
    out = stage_table(out, "references")
    drop_tables(vocabulary, totals)
    return out


def quality_rules(docs: DataFrame, references: DataFrame | None = None, text: str = "text", lang: str = "lang", window: int = 5, guard_words: int = 60, max_class_distance: float = 0.30, max_word_distance: float = 0.65, max_word_share: float | None = None, max_reference_rows: int = 10_000, **reference_options) -> DataFrame:
    """docs with RULE_COLUMNS (in place of columns so named).

    base_failed: fewer than 10 words, or over 20 % of the words in repeated windows. kept: not base_failed and, where the
    document has guard_words words or more, both Jensen-Shannon distances to its language's reference within bounds; shorter
    ones are too few words for a histogram and pass that rule. max_word_share, where given, bounds the word distance by that
    share of what a text without any common word has in its language, besides max_word_distance. Null text has no words; a language without reference passes.
    At most max_reference_rows references are broadcast, more are joined. No row is dropped, repeated or moved between tasks.
    A filter on the verdict would be merged with the projections and work them out anew: write the rows out before it, or make
    the verdict count as not deterministic.
    """
    spark = docs.sparkSession
    docs = docs.select(*(c for c in docs.columns if c not in RULE_COLUMNS))
    refs = references if references is not None else language_references(docs, text, lang, **reference_options)
    if max_word_share is not None:
        absent = F.transform("_word_ref", lambda q, i: F.when(i == F.size("_word_ref") - 1, 1.0).otherwise(0.0))
        refs = refs.withColumn("_word_bound", max_word_share * js_distance(absent, F.col("_word_ref")))
    refs = F.broadcast(refs) if len(refs.limit(max_reference_rows + 1).take(max_reference_rows + 1)) <= max_reference_rows else refs
    own = list(docs.columns)
    names = ("_lang", "_common", "_word_ref", "_class_ref", "_word_bound", "_words", "_packed", "_marks", "_lines", "_hashes", "_windows", "_order", "_places", "_codes", "_hits", "_rest", "_classes")
    n = dict(zip(names, fresh_names(own, *names), strict=True))
    c = {k: F.col(v) for k, v in n.items()}
    refs = refs.select(*(F.col(x).alias(n[x]) for x in refs.columns if x in n))
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn(n["_lang"], F.coalesce(F.col(lang).cast("string"), F.lit(""))).join(refs, n["_lang"], "left")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    d = d.withColumns({n["_words"]: words_of(F.col(text)), n["_packed"]: F.translate(t, " \t\n\x0B\f\r", ""), n["_lines"]: lines, n["_common"]: F.transform(c["_common"], lambda w: F.xxhash64(w))})
    d = d.withColumns({"n_words": F.size(c["_words"]).cast("long"), "word_chars": F.length(c["_packed"]).cast("long"), n["_marks"]: marks(c["_packed"]), n["_hashes"]: F.transform(c["_words"], lambda w: F.xxhash64(w))})
    starts = F.when(F.col("n_words") >= window, F.sequence(F.lit(0), F.size(c["_hashes"]) - window)).otherwise(F.array().cast("array<int>"))
    # A word's place among the common ones as a character, the first for all others.
    code = F.transform(c["_hashes"], lambda h: F.char(F.coalesce(F.array_position(c["_common"], h), F.lit(0)) + 1))
    d = d.withColumns({
        n["_windows"]: F.transform(starts, lambda i: F.xxhash64(*(F.get(c["_hashes"], i + j) for j in range(window)))), n["_codes"]: F.array_join(code, ""),
        n["_classes"]: class_counts(c["_marks"], F.col("word_chars")), "n_symbols": count_of(c["_marks"], F.lit("#")),
        "n_dup_lines": (F.size(c["_lines"]) - F.size(F.array_distinct(c["_lines"]))).cast("long"),
    })
    counts = F.concat(F.transform(c["_common"], lambda _, j: count_of(c["_codes"], F.char(j + 2))), F.array(count_of(c["_codes"], F.char(F.lit(1)))))
    d = d.withColumns({n["_order"]: repeats_in_order(c["_windows"]), n["_hits"]: counts})
    d = d.withColumn(n["_places"], repeated_places(c["_order"]))
    d = d.withColumn("n_repeat_words", covered_words(c["_places"], window))
    d = d.withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "class_distance": F.round(F.coalesce(js_distance(shares(c["_classes"], F.col("word_chars")), c["_class_ref"]), F.lit(0.0)), 6),
        "word_distance": F.round(F.coalesce(js_distance(shares(c["_hits"], F.col("n_words")), c["_word_ref"]), F.lit(0.0)), 6),
    })
    far = F.col("word_distance") > max_word_distance
    if max_word_share is not None:
        far = far | F.coalesce(F.col("word_distance") > c["_word_bound"], F.lit(False))
    odd = (F.col("n_words") >= guard_words) & ((F.col("class_distance") > max_class_distance) | far)
    return d.withColumn("kept", ~F.col("base_failed") & ~odd).select(*own, *RULE_COLUMNS)
