
import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from tidemark.llm import license_scan, line_dedup, ngram_join, queries


def test_quality_stage_rejects_texts_without_common_words(spark):
    rnd = random.Random(1)
    text = lambda common: " ".join(rnd.choice(["the", "of", "and", "to"]) if rnd.random() < common else f"w{rnd.choice('abcdefgh')}{''.join(rnd.choice('aeiou') for _ in range(6))}" for _ in range(90))
    rows = [(i, text(0.25), "en") for i in range(60)] + [(100, text(0.0), "en"), (101, text(1.0), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, "").collect()}
    assert kept == set(range(60))


def test_one_of_each_keeps_rows_of_null_and_repeated_ids(spark):
    rnd = random.Random(2)
    text = lambda: " ".join(f"w{rnd.randrange(10_000)}" for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d), (3, e), (9, e), (None, e), (None, ""), (None, None), (5, " "), (5, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    want = [(None, a), (None, b), (7, c), (7, d), (3, e), (None, ""), (None, None), (5, " "), (5, " ")]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_short_equal_lines_go(spark, tmp_path):
    long_one = "a line of more than twenty-four code points"
    rows = [(1, "All rights reserved.\nx\n \nab"), (2, f"{long_one}\nAll rights reserved.\n\nab"), (3, f"{long_one}!\nAll rights reserved!\n \n\nx")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in line_dedup.dedup_lines(docs, min_equal=1).collect()}
    assert got == {1: (rows[0][1], 0), 2: (f"{long_one}\n", 2), 3: ("All rights reserved!\n \n", 2)}
    assert {r.doc_id: r.n_removed_lines for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 2, 3: 2}


GPL = """# This program is free software{0} you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation{1} either version {2} of the License, or
# (at your option) any later version.
code"""
LICENSED = {
    "gpl3.py": (GPL.format(":", ",", 3), "GPL-3.0"), "gpl2.py": (GPL.format(";", ";", 2), "GPL-2.0"),
    "bsd.c": ("/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n */\nint x;", "BSD-3-Clause"),
    "mit.txt": ("MIT License\n\nCopyright (c) 2020 Jane Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "MIT"),
    "line.py": ("Copyright (c) 2020 Jane Doe and contributors. All rights reserved. Released under the MIT License, see the LICENSE file for details.", "MIT"),
    "corp.py": ("Copyright 2019 Example Corp. All rights reserved. Licensed under the Apache License, Version 2.0. See the file for details and more words.", "Apache-2.0"),
    "none.py": ("The film was released under the old title, and the license of the cinema was granted free of charge to any person.", None),
    "other.py": ("It was released under the Foobar license in the end, as we all know by now.", None),
}


def test_license_windows(spark):
    files = [(path, text) for path, (text, _) in LICENSED.items()] + [(f"n{i}.py", "plain words of a text\nand a second line") for i in range(30)]
    got = {r.path: r.license for r in license_scan.scan_licenses(spark.createDataFrame(files, "path string, text string"), license_file="^$").collect()}
    assert {path: got[path] for path in LICENSED} == {path: name for path, (_, name) in LICENSED.items()}
    assert all(got[f"n{i}.py"] is None for i in range(30))


def test_ngram_join_links_through_rows_without_id(spark):
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(w[:40])), (None, " ".join(w[3:43])), (None, " ".join(w[3:43])), (2, " ".join(w[6:46])), (None, "alone " * 3)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got if r.n_shingles > 1) == [("1", 1), ("2", 1), ("None", 1), ("None", 1)]
