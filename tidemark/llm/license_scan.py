"""License scans: sparse TF-IDF cosine of header blocks and licence files to templates, then nearest-ancestor inheritance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_words, hash_words, pieces, stage_table

#: Licence ids and the phrases by which files declare them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
PUNCTUATION = ".,;:!?()[]{}<>\"'*#/\\|-"
MATCH = "_license string, _score double, _block string"
ADDED = ("license", "license_score", "license_origin", "license_from")


def terms_of(words: pa.Array) -> pa.Array:
    """Words without the punctuation around them; lower-cased already."""
    return pc.utf8_trim(words, characters=PUNCTUATION)


class Templates:
    """Sparse template vectors over their own terms. df: blocks that hold a term, n: blocks of the corpus."""

    def __init__(self, templates, df: np.ndarray | None = None, n: int = 0):
        self.names = [name for name, _ in templates]
        ids, words, counts = arrow_words(pa.array([t for _, t in templates]))
        hashes = hash_words(terms_of(words))[ids]
        self.terms = np.unique(hashes)
        tf = np.zeros((len(templates), len(self.terms)))
        np.add.at(tf, (np.repeat(np.arange(len(counts)), counts), np.searchsorted(self.terms, hashes)), 1)
        df = np.zeros(len(self.terms)) if df is None else df
        self.idf = np.log((1 + n) / (1 + df)) + 1
        self.other_idf = np.log(1 + n) + 1  # a term of no template weighs as one that the corpus lacks
        weight = tf * self.idf
        self.weight = weight / np.linalg.norm(weight, axis=1, keepdims=True)
        self.lengths = tf.sum(axis=1).astype(np.int64)
        shared = np.array([[any(tf[j, i] for j in range(len(tf)) if self.names[j] != name) for i in range(len(self.terms))] for name in self.names])
        self.named = np.where(shared, 0, self.weight**2)  # of terms that no other licence's template has

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each term, -1 for those of no template."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)


def blocks_of(texts: pa.Array, block_words: int):
    """(text of each token, block of each token, id of its distinct word, distinct terms' hashes, text of each block, line of each block, lines).

    A block is a line; a longer line is cut every block_words words."""
    lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    flat = pc.list_flatten(lines)
    line_text = np.repeat(np.arange(len(lines)), np.diff(lines.offsets.to_numpy()))
    ids, words, counts = arrow_words(flat)
    line = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (place % block_words == 0).astype(np.int64)
    block = np.cumsum(start) - 1
    block_line = line[start == 1]
    hashes = hash_words(terms_of(words)) if len(words) else np.zeros(0, np.uint64)
    return block, ids, hashes, line_text[block_line], block_line, flat


def window_matches(known: Templates, ids: np.ndarray, hashes: np.ndarray, text: np.ndarray, min_score: float, at_once: int = 2000):
    """(first token, tokens, template, cosine) of all windows of a template's length, across line ends, that reach min_score.

    Tokens that are punctuation only count in no window. A window holds half, by weight, of the terms that tell its
    template's licence from others. Sums over windows bound the cosine; only windows within the bound are computed."""
    token = np.flatnonzero(hashes[ids] != hash_words(pa.array([""], pa.large_string()))[0])
    term_of, same = known.find(hashes), np.unique(hashes, return_inverse=True)[1]
    term, word = term_of[ids[token]], same[ids[token]]
    idf = np.where(term >= 0, known.idf[term], known.other_idf)
    squares = np.concatenate(([0.0], np.cumsum(idf * idf)))
    n = np.bincount(text[token], minlength=1)
    last = np.repeat(np.cumsum(n), n)
    places = np.arange(len(token))
    out = []
    for t, v in enumerate(known.weight):
        own = np.where(term >= 0, idf * v[term], 0)
        sums = np.concatenate(([0.0], np.cumsum(own)))
        end = np.minimum(places + known.lengths[t], last)
        near = np.flatnonzero((own > 0) & (sums[end] - sums[:-1] >= (min_score - 1e-6) * np.sqrt(squares[end] - squares[:-1])))
        for start in np.split(near, range(at_once, len(near), at_once)):
            at = start[:, None] + np.arange(known.lengths[t])
            inside = at < end[start][:, None]
            at = np.minimum(at, len(token) - 1)
            w, x = np.where(inside, idf[at], 0), word[at]
            norm = np.sqrt(np.einsum("ri,rij,rj->r", w, x[:, :, None] == x[:, None, :], w))
            score = np.round(np.where(inside, own[at], 0).sum(axis=1) / np.maximum(norm, 1e-300), 9)
            held = np.zeros((len(start), len(v) + 1), bool)
            np.put_along_axis(held, np.where(inside, term[at], -1) % (len(v) + 1), True, axis=1)
            good = (score >= min_score) & (2 * (held[:, :-1] @ known.named[t]) >= known.named[t].sum())
            begin = start[good]
            out.append((token[begin], token[end[begin] - 1] + 1 - token[begin], np.full(len(begin), t), score[good]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def license_matches(files: DataFrame, path: str, text: str, templates, min_score: float, block_words: int) -> DataFrame:
    """(path, _license, _score, _block) of the best block or window of each row with a cosine of min_score or more (_block: the line it begins in); block counts and
    document frequencies of the template terms cover every block of every row."""
    spark = files.sparkSession
    bare = Templates(templates)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(bare.terms), np.int64), 0
        for batch in batches:
            block, ids, hashes, block_text, _, _ = blocks_of(batch.column(0), block_words)
            if len(ids):
                term = bare.find(hashes)[ids]
                pairs = np.unique(block[term >= 0] * len(bare.terms) + term[term >= 0])
                df += np.bincount(pairs % len(bare.terms), minlength=len(bare.terms))
            n += len(block_text)
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(df)), -1], pa.int32()), pa.array([*df.tolist(), n], pa.int64())], names=["term", "n"])

    sums = {r["term"]: r["n"] for r in files.select(text).mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    known = Templates(templates, np.array([sums.get(i, 0) for i in range(len(bare.terms))], float), sums.get(-1, 0))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in pieces(batch.column(1)):
                block, ids, hashes, block_text, block_line, lines = blocks_of(texts, block_words)
                rows = np.zeros(0, np.int64)
                if len(ids):
                    term = known.find(hashes)[ids]
                    seen = np.zeros(len(block_text), bool)
                    seen[block[term >= 0]] = True
                    use = seen[block]
                    pair, tf = np.unique(block[use] * np.int64(len(hashes) + 1) + ids[use], return_counts=True)
                    b, word = pair // (len(hashes) + 1), pair % (len(hashes) + 1)
                    t = known.find(hashes)[word]
                    w = tf * np.where(t >= 0, known.idf[t], known.other_idf)
                    norm = np.sqrt(np.bincount(b, weights=w * w, minlength=len(block_text)))
                    near = np.sqrt(np.bincount(b, weights=np.where(t >= 0, w * w, 0), minlength=len(block_text))) >= min_score * norm  # cosine is at most that share
                    b, t, w = (x[near[b] & (t >= 0)] for x in (b, t, w))
                    cosine = np.stack([np.bincount(b, weights=w * v[t], minlength=len(block_text)) for v in known.weight]) / np.maximum(norm, 1e-300)
                    best, score = cosine.argmax(axis=0), np.round(cosine.max(axis=0), 9)
                    good = np.flatnonzero(score >= min_score)
                    first = np.searchsorted(block, good)
                    wide = window_matches(known, ids, hashes, block_text[block], min_score)
                    found = [np.concatenate(x) for x in zip((first, np.searchsorted(block, good, side="right") - first, best[good], score[good]), wide, strict=True)]
                    begin, size, best, score = found
                    of = block[begin]
                    order = np.lexsort((best, -size, begin, -score, block_text[of]))
                    rows = order[np.concatenate(([True], np.diff(block_text[of[order]]) != 0))] if len(order) else rows
                held = of[rows] if len(rows) else np.zeros(0, np.int64)
                names = [known.names[best[i]] for i in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(block_text[held] + at, pa.int64())), pa.array(names, pa.string()), pa.array(score[rows] if len(rows) else [], pa.float64()), lines.take(pa.array(block_line[held], pa.int64())).cast(pa.string())],
                    names=[path, "_license", "_score", "_block"],
                )

    kind = files.schema[path].dataType.simpleString()
    return files.select(path, text).mapInArrow(match, f"`{path}` {kind}, {MATCH}")


def scan_licenses(files: DataFrame, path: str = "path", text: str = "text", license_file: str = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$", templates=TEMPLATES, min_score: float = 0.75, block_words: int = 200) -> DataFrame:
    """files with license, license_score, license_origin (`own`, `inherited`, `none`) and license_from in place of columns so named.

    own: the best block or window of the file reaches min_score (ties: the one that begins first, the longest, the first template). A file whose path
    matches license_file speaks for its directory; of several in one, the best score, then the smallest path. Other files
    take the licence of the nearest directory above them that has one, the path's root '' included. Null or empty texts
    match nothing; a null path has no directory; rows that share a path share the best match. Whole texts are read.
    Joins are on distinct directories; files meet their own directory only, and a full one is a plain key that can be split.
    """
    files = files.select(*(c for c in files.columns if c not in ADDED))
    found = stage_table(license_matches(files, path, text, templates, min_score, block_words), "licenses")
    best = found.where(F.col(path).isNotNull()).groupBy(path).agg(F.max_by(F.struct("_license", "_score"), F.struct("_score", "_license")).alias("_own"))
    directory = F.regexp_replace(F.col(path), r"/?[^/]*$", "")
    files = files.withColumn("_dir", directory)
    spoken = best.where(F.col(path).rlike(license_file)).withColumn("_dir", directory)
    speaking = spoken.groupBy("_dir").agg(F.min_by(F.struct(F.col("_own._license").alias("l"), F.col("_own._score").alias("s"), F.col(path).alias("p")), F.struct(-F.col("_own._score"), F.col(path))).alias("_said"))
    parts = F.split("_dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("up")))
    dirs = files.where("_dir is not null").select("_dir").distinct().select("_dir", F.inline(F.array_distinct(ups)))
    near = dirs.join(speaking.withColumnRenamed("_dir", "up"), "up").groupBy("_dir").agg(F.max_by("_said", "depth").alias("_near"))
    out = files.join(best, path, "left").join(near, "_dir", "left")
    own, given = F.col("_own").isNotNull(), F.col("_near").isNotNull()
    return out.select(
        *(c for c in files.columns if c != "_dir"), F.when(own, F.col("_own._license")).otherwise(F.col("_near.l")).alias("license"),
        F.when(own, F.col("_own._score")).otherwise(F.col("_near.s")).alias("license_score"),
        F.when(own, "own").when(given, "inherited").otherwise("none").alias("license_origin"), F.when(own, F.col(path)).otherwise(F.col("_near.p")).alias("license_from"),
    )
