import zlib

import brute as by_definition
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_codec_packing_media import check_packing
from test_simhash_urls import brute_near
from tokenizers import Tokenizer

import corpus_pipeline
from inkfathom.llm import licenses, rangejoin
from inkfathom.llm.common import spool

VECTORS = "vec_id bigint, embedding array<float>, label int, n_links string"


def brute(rows):
    ok = {}
    for n, (i, v, label, _) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            ok[n] = (label, x / np.linalg.norm(x))
    links = {n: [m for m in ok if m != n and ok[m][0] == ok[n][0] and len(ok[m][1]) == len(ok[n][1]) and ok[n][1] @ ok[m][1] >= 0.93] for n in ok}
    out = []
    for n, row in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in links.get(todo.pop(), []):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out.append((row[0], len(links.get(n, [])), min(rows[m][0] for m in seen)))
    return sorted(out)


def test_join_of_extreme_magnitudes(spark):
    rows = [(1, [1e-200, 1e-200]), (2, [0.1, 0.995]), (3, [1e200, 0.0]), (4, [2e200, 0.0]), (5, [5e-324, 0.0]), (6, [1e-200, 1.1e-200]), (7, [1e308, 1e308]), (8, [1e300, -1e300])]
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rangejoin.join(d).collect()}
    assert got == {1: (2, 1), 6: (2, 1), 7: (2, 1), 2: (0, 2), 3: (2, 3), 4: (2, 3), 5: (2, 3), 8: (0, 8)}


def vectors():
    rng = np.random.default_rng(7)
    rows = []
    for c in range(12):
        centre = rng.normal(size=8)
        for _ in range(12):
            rows.append([float(x) for x in centre + rng.normal(scale=rng.choice([0.05, 0.2, 0.6]), size=8)])
    rows = [(i * 2, v, i % 3 if i % 17 else None, "x") for i, v in enumerate(rows)]
    v = rows[1][1]
    rows += [(900 + i, v, 1, "x") for i in range(30)] + [(950, [2 * x for x in v], 1, "x")]
    rows += [(960, None, 1, "x"), (961, [0.0] * 8, 1, "x"), (962, [float("nan")] * 8, 1, "x"), (963, [None] + v[1:], 1, "x"), (964, v[:4], 1, "x"), (965, [], 1, "x"), (966, [float("inf")] + v[1:], 1, "x")]
    return rows


@pytest.mark.parametrize("settings", [{}, {"cell": 10, "block": 5}, {"cell": 4, "block": 64}, {"cell": 60, "block": 7}])
def test_join_against_brute_force(spark, settings):
    rows = vectors()
    got = rangejoin.join(spark.createDataFrame(rows, VECTORS), **settings).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_join_in_many_dimensions_with_text_labels(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 64))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(scale=0.25, size=64)], "ab"[i % 5 == 0], "x") for i in range(400)]
    d = spark.createDataFrame(rows, VECTORS.replace("label int", "label string"))
    for settings in ({}, {"cell": 40, "block": 25}):
        got = rangejoin.join(d, **settings).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)


def test_pivots_grow_with_the_label(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)], "a", 4) for i in range(900)]
    d = spark.createDataFrame(rows, "rid bigint, vector array<double>, label string, dim int")
    assert len(rangejoin.pick_pivots(d, 100)["a", 4]) == 9
    assert len(rangejoin.pick_pivots(d, 10)["a", 4]) == 90
    assert rangejoin.pick_pivots(d, 900) == {}


def test_join_of_nothing(spark):
    assert rangejoin.join(spark.createDataFrame([], VECTORS)).count() == 0
    one = rangejoin.join(spark.createDataFrame([(None, [1.0], 1, ""), (None, [1.0], 1, "")], VECTORS)).collect()
    assert [r["n_links"] for r in one] == [1, 1] and one[0]["component_id"] is None


FILES = [
    ("a/LICENSE", "Released under the MIT License.\n"),
    ("a/b/x.txt", "nothing"),
    ("a/b/c/COPYING.md", "This work is licensed under the GNU General Public License, version 3."),
    ("a/b/c/y.txt", None),
    ("a/b/c/d/z.txt", "prose\nLicensed under CC BY-NC 4.0.\nprose"),
    ("q/x.txt", ""),
    ("LICENSE-top", "word " * 50_000 + "\nLicensed under the Apache License, Version 2.0."),
    (None, "no path"),
    ("ab/x.txt", "the licensee's prose about many things that are no licence text at all, at some length"),
]


def test_licences(spark):
    d = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(FILES)] + [(1, *FILES[1], "x")], "doc_id bigint, path string, text string, license string")
    got = sorted({(r["doc_id"], r["license"], r["origin"], r["licensed_by"]) for r in licenses.scan(d, "doc_id", F.col("path")).collect()})
    assert got == [
        (0, "MIT", "own", "a/LICENSE"), (1, "MIT", "inherited", "a/LICENSE"), (2, "GPL-3.0", "own", "a/b/c/COPYING.md"),
        (3, "GPL-3.0", "inherited", "a/b/c/COPYING.md"), (4, "CC-BY-NC-4.0", "own", "a/b/c/d/z.txt"),
        (5, "Apache-2.0", "inherited", "LICENSE-top"), (6, "Apache-2.0", "own", "LICENSE-top"), (7, None, "none", None),
        (8, "Apache-2.0", "inherited", "LICENSE-top"),
    ]
    assert licenses.scan(d, "doc_id", F.col("path")).count() == len(FILES) + 1
    assert licenses.scan(d.where("false"), "doc_id", F.col("path")).count() == 0


MIT_FILE = """The MIT License (MIT)

Copyright (c) 2019 Ada Bystander <ada@example.org>

""" + (licenses.TEXTS / "MIT.txt").read_text()
BSD_3_FILE = "Copyright 2021, Some Company. All rights reserved.\n\n" + (licenses.TEXTS / "BSD-3-Clause.txt").read_text().replace("the copyright holder nor", "Some Company nor")
APACHE_HEADER = """#!/usr/bin/env python
# Copyright 2022 The Example Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     https://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
import os
""" + "x = os.getcwd()\n" * 500
GPL_HEADER = """/* frob.c
 * This file is part of Frob.
 * Frob is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * Frob is distributed in the hope that it will be useful, but WITHOUT
 * ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
 * FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License
 * for more details. */
int main(void) { return 0; }
"""
MPL_HEADER = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
let x = 1;
"""
WHOLE = [
    (MIT_FILE, "MIT"), (BSD_3_FILE, "BSD-3-Clause"), (APACHE_HEADER, "Apache-2.0"), (GPL_HEADER, "GPL-2.0"), (MPL_HEADER, "MPL-2.0"),
    ("// SPDX-License-Identifier: MIT\nint x;", "MIT"), ("/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */", "GPL-2.0"),
    ("<!-- SPDX-License-Identifier: (Apache-2.0 OR BSD-3-Clause) -->", "BSD-3-Clause"),
    ("Copyright (c) 2020 Foo Inc. Released under the MIT License.", "MIT"),
    ("word " * 300 + "and so on. This work is licensed under a Creative Commons Attribution 4.0 International License. " + "word " * 300, "CC-BY-4.0"),
    ("word " * 300 + "Released under\n * the MIT\n * License. more", "MIT"),
    ("a driver needs a licence and a fishing license is sold at the counter, as permission is hereby asked for", None),
    ("the licence of poets; redistribution and use in source and binary forms are discussed in the next chapter of the book", None),
]


def test_headers_and_whole_licence_files(spark):
    d = spark.createDataFrame([(i, f"d{i}/x", t) for i, (t, _) in enumerate(WHOLE)], "doc_id bigint, path string, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(d, "doc_id", F.col("path")).collect()}
    assert got == {i: name for i, (_, name) in enumerate(WHOLE)}


def test_each_licence_text_is_its_own(spark):
    files = sorted(licenses.TEXTS.glob("*.txt"))
    # another layout, with a comment mark on each line, and a holder before it
    texts = [(i, f"d{i}/x", "Copyright 2024 Someone Else\n" + "\n".join(f" * {x.strip()}" for x in p.read_text().split("\n"))) for i, p in enumerate(files)]
    d = spark.createDataFrame(texts, "doc_id bigint, path string, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(d, "doc_id", F.col("path")).collect()}
    assert len(files) >= 12 and got == {i: p.stem for i, p in enumerate(files)}


def test_pipeline_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "near_dedup", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rows = [tuple(r) for r in docs.collect()]

    def after(name):
        nonlocal docs
        docs = spool(stage[name](spark, docs, sf), name)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        return sorted(tuple(r) for r in docs.collect())

    said = by_definition.languages([r[:3] for r in rows], lambda i: zlib.crc32(str(i).encode()) % 4 != 2)
    rows = sorted(r for r, (_, _, rejected) in zip(rows, said) if not rejected)
    assert after("language_id") == rows

    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect()]
    scores = by_definition.toxic([r[:2] for r in rows], labels, lambda i: zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [r for r, s in zip(rows, scores) if s < 0.7]
    assert after("toxicity") == rows

    groups = brute_near([r[1] for r in rows])
    least = {g: min(r[0] for r, x in zip(rows, groups) if x == g) for g in set(groups)}
    rows = [r for r, g in zip(rows, groups) if r[0] == least[g]]
    assert after("near_dedup") == rows

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    reference.no_truncation(), reference.no_padding()
    ids = [(r[0], [*reference.encode(r[1], add_special_tokens=False).ids, 0]) for r in rows]
    check_packing(stage["packing"](spark, docs, sf).toPandas(), ids, 1024)


def test_pipeline_tells_rows_of_one_id_apart(spark):
    """An id that two rows of other texts share, and an empty table."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    a, b = "first words of a text that is here", "other words which have nothing in common"
    docs = spark.createDataFrame([(5, a, "en", "s", 1), (5, b, "en", "s", 1), (6, b, "en", "s", 1)], schema)
    kept = corpus_pipeline.unique(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(5, a), (5, b)])
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = spool(stage(spark, empty, "/root/testdata/sf0.001"), "empty")
    assert empty.count() == 0


def test_pipeline_on_nulls(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        docs = spool(stage(spark, docs, "/root/testdata/sf0.001"), "nulls")
    assert docs.count() == 0
