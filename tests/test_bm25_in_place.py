"""BM25 keeps and shuffles neither words nor pairs."""

import math
import random

from pyspark.sql import functions as F

from inkfathom.operators import answers, search

K1, B = 1.2, 0.75


def by_hand(docs, queries):
    words = {i: t.lower().split() for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    out = {}
    for q, text in queries:
        for t in set(text.lower().split()):
            df = sum(t in w for w in words.values())
            for i, w in words.items():
                if t in w:
                    tf = w.count(t)
                    part = math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
                    out[q, i] = out.get((q, i), 0) + part
    return {k: round(v, 6) for k, v in out.items()}


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 9))) for _ in range(n)]


def kept_rows(monkeypatch):
    kept, real = [], search.written
    monkeypatch.setattr(search, "written", lambda df, name: kept.append(df.count()) or real(df, name))
    return kept


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]


def test_bm25_scores_texts_where_they_are(spark, monkeypatch):
    docs, asked = list(enumerate(texts(200, 1))), list(enumerate(texts(7, 2)))
    kept = kept_rows(monkeypatch)
    monkeypatch.setattr(search, "PAIRS", 100)
    found = search.bm25(spark.createDataFrame(docs, "id bigint, text string"), spark.createDataFrame(asked, "query_id bigint, text string"))
    assert {(r["query_id"], r["id"]): round(r["score"], 6) for r in found.collect()} == by_hand(docs, asked)
    assert kept and max(kept) < 100  # the terms, not the documents' words
    assert {s.split("(")[1][:2] for s in shuffles(found)} == {"id"}  # the texts alone


def test_bm25_cited_scores_what_is_kept_alone(spark, monkeypatch):
    chunks = [(f"c{i}", t, i % 4) for i, t in enumerate(texts(60, 3))]
    units = [(c, n, w, w, g) for c, t, g in chunks for n, w in enumerate(t.split())]
    asked = list(enumerate(texts(5, 4)))
    kept = kept_rows(monkeypatch)
    found = answers.bm25_cited(
        spark.createDataFrame(chunks, "chunk_id string, text string, g int"), spark.createDataFrame(units, "chunk_id string, ord int, heading string, text string, g int"),
        spark.createDataFrame(asked, "query_id bigint, text string"), F.col("g") == 1,
    )
    whole = by_hand([((c, -1), t) for c, t, _ in chunks] + [((c, n), t) for c, n, _, t, _ in units], asked)
    want = []
    for q, _ in asked:
        rows = []
        for c, _, g in chunks:
            cited = [s for (k, i), s in whole.items() if k == q and i[0] == c and i[1] >= 0]
            if g == 1 and cited:
                rows.append((-len(cited), -max(cited) * answers.CITED, c))
        want += [(q, c, round(-s, 4), -n, k + 1) for k, (n, s, c) in enumerate(sorted(rows)[:10])]
    assert sorted((r["query_id"], r["chunk_id"], round(r["score"], 4), r["labels"], r["rank"]) for r in found.collect()) == sorted(want)
    assert kept and max(kept) < 100
