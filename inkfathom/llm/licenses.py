"""Licence scan in DataFrame functions alone.

A text's segments are of three kinds. Each line that speaks of a licence is
compared with the one-sentence notices. The text as a stream of words, whatever
its lines and comment marks, gives windows of each notice's and header's length
laid over each word that speaks of a licence, and windows of each licence text's
length from each place where its first words stand; they are compared with that
notice, header or text, and the whole text with each licence text. An SPDX tag
names its licences outright, with a score of 1.

Segments and templates are sparse TF-IDF vectors over distinct lower-case words.
For lines the document frequencies of the templates' words are those over all
such lines of the corpus, and any other word weighs as one never seen; for
windows and whole texts they are those over the templates, and any other word
(a holder's name, a year) weighs as one that all templates have. A file's own
licence is that of the template of largest cosine, from ``threshold`` up. A file
without one takes that of the nearest directory at or above its own that holds
an identified licence file (by name LICENSE, COPYING, NOTICE and the like), by a
join on directories.

Templates and their words are fixed; nothing else leaves the executors but one
count for each word of the one-sentence notices.

The comparisons of all texts are written once to the shared folder, as three
joins read them.

Defined cases: null and empty texts have no licence of their own; a null path
inherits nothing; of equal cosines the licence later by name wins, of several
licence files in a directory the one of largest cosine, then path; repeated
rows give repeated results; only the named columns are read.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import spool

#: Licence notices as they are commonly written.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal license public domain dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
)

#: Headers of source files.
_GNU = (
    "{it} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License"
    " as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    " {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
    " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."
)
HEADERS = (
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed"
        ' to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF'
        " ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("AGPL-3.0", _GNU.format(it="This program", kind="Affero ", version="3")),
    ("GPL-2.0", _GNU.format(it="This program", kind="", version="2")),
    ("GPL-3.0", _GNU.format(it="This program", kind="", version="3")),
    ("LGPL-2.1", _GNU.format(it="This library", kind="Lesser ", version="2.1")),
    ("LGPL-3.0", _GNU.format(it="This library", kind="Lesser ", version="3")),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"
        " with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
)
#: Whole licence texts, each named after its licence.
TEXTS = Path(__file__).with_name("license_texts")

THRESHOLD = 0.75
WORD = "([a-z0-9]+)"
CUE = "licens|licenc"
#: What any text with a notice, a header, a licence text or an SPDX tag has.
ANY_CUE = rf"{CUE}|permission\W+(is\W+hereby|to\W+use)|redistribution\W+and\W+use|free\W+and\W+unencumbered"
_ID = r"[a-zA-Z0-9]+(?:[.-][a-zA-Z0-9]+)*\+?"
SPDX = rf"(?i)spdx-license-identifier:[ \t]*(\(*{_ID}\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*{_ID}\)*)*)"
BUCKETS, FIRST = 1024, 4
LICENCE_FILE = r"(?i)^(un)?(licen[cs]e|copying|notice)s?([-._].*)?$"


def template_words() -> list[tuple[str, list[str]]]:
    return [(name, sorted(set(re.findall(WORD, text.lower())))) for name, text in TEMPLATES]


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1)))


def segments(files: DataFrame, text_col: str) -> Column:
    """Lines that speak of a licence, as an array; empty for other texts."""
    text = F.col(text_col)
    lines = F.filter(F.split(text, "\n"), lambda line: F.lower(line).rlike(CUE))
    return F.when(F.lower(text).rlike(CUE), lines).otherwise(F.array().cast("array<string>"))


def word_weights(files: DataFrame, text_col: str) -> tuple[dict[str, float], float]:
    """Squared idf of each template word, and of any other, over all segments."""
    vocabulary = sorted({w for _, ws in template_words() for w in ws})
    found = files.select(F.explode(segments(files, text_col)).alias("line")).select(words(F.col("line")).alias("words"))
    counted = found.select(
        F.explode(F.concat(F.array(F.lit("")), F.array_intersect("words", F.array(*map(F.lit, vocabulary))))).alias("w")
    )
    seen = {r["w"]: r["count"] for r in counted.groupBy("w").count().collect()}
    total = seen.get("", 0)
    weight = {w: (math.log((1 + total) / (1 + seen.get(w, 0))) + 1) ** 2 for w in vocabulary}
    return weight, (math.log(1 + total) + 1) ** 2


def best_template(line_words: Column, weight: dict[str, float], other: float) -> Column:
    """struct(score, license) of the largest cosine."""

    def total(items: Column) -> Column:
        table = F.create_map(*(x for w in sorted(weight) for x in (F.lit(w), F.lit(weight[w]))))
        return F.aggregate(items, F.lit(0.0), lambda s, w: s + table[w])

    known = F.array_intersect(line_words, F.array(*map(F.lit, sorted(weight))))
    norm = F.sqrt(total(known) + F.lit(other) * (F.size(line_words) - F.size(known)))
    scored = []
    for name, own in template_words():
        length = math.sqrt(sum(weight[w] for w in own))
        dot = total(F.array_intersect(known, F.array(*map(F.lit, own))))
        scored.append(F.struct((F.round(dot / (norm * length), 9)).alias("score"), F.lit(name).alias("license")))
    return F.array_max(F.array(*scored))


@cache
def whole_templates() -> tuple[str, str, str, str, str]:
    """JSON of the vocabulary's words and their numbers by bucket of crc32, of
    the words' squared idf, of the notices and headers, and of the licence texts."""
    texts = [(p.stem, p.read_text()) for p in sorted(TEXTS.glob("*.txt"))]
    parts = [[(name, re.findall(WORD, text.lower())) for name, text in kind] for kind in (TEMPLATES + HEADERS, texts)]
    every = [set(ws) for part in parts for _, ws in part]
    number = {w: i for i, w in enumerate(sorted(set().union(*every)))}
    square = [(math.log((1 + len(every)) / (1 + sum(w in ws for ws in every))) + 1) ** 2 for w in number]
    words: list[list[str]] = [[] for _ in range(BUCKETS)]
    for w in number:
        words[zlib.crc32(w.encode()) % BUCKETS].append(w)
    packed = [
        [
            {
                "license": name,
                "n": len(ws),
                "at": next((i for i, w in enumerate(ws) if re.search(CUE, w)), 0),
                "first": [number[w] for w in ws[:FIRST]],
                "ids": sorted({number[w] for w in ws}),
                "norm": math.sqrt(sum(square[number[w]] for w in set(ws))),
            }
            for name, ws in part
        ]
        for part in parts
    ]
    numbers = [[number[w] for w in ws] for ws in words]
    return tuple(json.dumps(x) for x in (words, numbers, square, *packed))


def _let(value: Column, f) -> Column:
    """f(value), with the value made once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def best_whole(text: Column) -> Column:
    """struct(score, license) of the largest cosine of the text's windows and of the whole text."""
    kind = "array<struct<license:string,n:int,at:int,first:array<bigint>,ids:array<bigint>,norm:double>>"
    types = ("array<array<string>>", "array<array<bigint>>", "array<double>", kind, kind)
    words_of, numbers_of, square, notices, texts = (F.from_json(F.lit(x), t) for x, t in zip(whole_templates(), types))

    def number(word: Column) -> Column:
        """A word's number in the vocabulary, or a negative one of its own."""
        bucket = (F.crc32(word.cast("binary")) % BUCKETS).cast("int")
        place = F.array_position(F.get(words_of, bucket), word).cast("int")
        own = F.xxhash64(word).bitwiseOR(F.lit(-(2**63)))
        return F.when(place > 0, F.get(F.get(numbers_of, bucket), place - 1)).otherwise(own)

    def total(ids: Column) -> Column:
        weight = lambda i: F.when(i >= 0, F.get(square, i.cast("int"))).otherwise(1.0)
        return F.aggregate(ids, F.lit(0.0), lambda s, i: s + weight(i))

    def cosine(distinct: Column, t: Column) -> Column:
        near = _let(distinct, lambda ids: total(F.array_intersect(ids, t["ids"])) / (F.sqrt(total(ids)) * t["norm"]))
        return F.struct(F.round(near, 9).alias("score"), t["license"].alias("license"))

    def window(ids: Column, at: Column, t: Column) -> Column:
        return cosine(F.array_distinct(F.slice(ids, F.greatest(at, F.lit(1)), t["n"])), t)

    def compared(found: Column, ids: Column) -> Column:
        cues = F.filter(F.transform(found, lambda w, i: F.when(w.rlike(CUE), i + 1)), lambda i: i.isNotNull())
        short = _let(cues, lambda at: F.transform(notices, lambda t: F.array_max(F.transform(at, lambda i: window(ids, i - t["at"], t)))))
        starts = lambda t: F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(ids), F.lit(1))),
            lambda i: (F.get(ids, i - 1) == t["first"][0])
            & (F.get(ids, i) == t["first"][1]) & (F.get(ids, i + 1) == t["first"][2]) & (F.get(ids, i + 2) == t["first"][3]),
        )
        long = F.transform(texts, lambda t: F.array_max(F.transform(starts(t), lambda i: window(ids, i, t))))
        whole = _let(F.array_distinct(ids), lambda distinct: F.transform(texts, lambda t: cosine(distinct, t)))
        return F.array_max(F.concat(short, long, whole))

    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1))
    return _let(found, lambda ws: _let(F.transform(ws, number), lambda ids: compared(ws, ids)))


def spdx(text: Column) -> Column:
    """Array of struct(score, license) of the licences that SPDX tags name."""

    def ids(expression: Column) -> Column:
        named = F.regexp_extract_all(F.regexp_replace(expression, rf"(?i)[ \t]with[ \t]+\(*{_ID}", ""), F.lit(f"({_ID})"), F.lit(1))
        return F.filter(named, lambda x: ~F.lower(x).isin("and", "or", "none", "noassertion"))

    named = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), ids))
    plain = lambda x: F.regexp_replace(x, r"(?i)(-only|-or-later|\+)$", "")
    return F.transform(named, lambda x: F.struct(F.lit(1.0).alias("score"), plain(x).alias("license")))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, id_col: str, path: Column, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, path, license, score, origin (own, inherited, none) and licensed_by (a path)."""
    base = files.select(F.col(id_col), path.alias("path"), F.col(text_col).alias("text"))
    weight, other = word_weights(base, "text")
    scored = F.transform(segments(base, "text"), lambda line: best_template(words(line), weight, other))
    whole = F.when(F.lower("text").rlike(ANY_CUE), F.concat(F.array(best_whole(F.col("text"))), spdx(F.col("text"))))
    found = F.array_max(F.array(F.array_max(scored), F.array_max(whole)))
    own = base.select(id_col, "path", found.alias("best")).select(
        id_col, "path", parent(F.col("path")).alias("dir"), F.when(F.col("best.score") >= threshold, F.col("best")).alias("best")
    )
    own = spool(own, "license-own")  # read three times below; texts are compared once
    name = F.regexp_extract("path", "[^/]*$", 0)
    licence_dirs = (
        own.where(F.col("best").isNotNull() & name.rlike(LICENCE_FILE))
        .groupBy("dir")
        .agg(F.max(F.struct("best.score", "best.license", "path")).alias("given"))
    )
    parts = F.split(F.col("dir"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    chain = F.array_distinct(F.concat(F.array(F.lit("")), above))
    nearest = (
        own.where("best is null and dir is not null")
        .select("dir")
        .distinct()
        .select("dir", F.explode(chain).alias("at"))
        .join(licence_dirs.withColumnRenamed("dir", "at"), "at")
        .groupBy("dir")
        .agg(F.max_by("given", F.length("at")).alias("given"))
    )
    free = F.col("best").isNull()
    joined = own.join(nearest, "dir", "left")
    return joined.select(
        id_col,
        "path",
        F.when(free, F.col("given.license")).otherwise(F.col("best.license")).alias("license"),
        F.when(free, F.col("given.score")).otherwise(F.col("best.score")).alias("score"),
        F.when(~free, "own").when(F.col("given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(free, F.col("given.path")).otherwise(F.col("path")).alias("licensed_by"),
    )
