"""Whole results where groups are large, and plans that the driver can hold."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from inkfathom.operators import graph, search, subsets
from inkfathom.plans import graph as plans
from inkfathom.plans import sparse
from inkfathom.registry import ORACLES


def test_shared_pairs_of_entities_of_many_chunks(spark, monkeypatch):
    """All pairs of an entity of many chunks are made, in cells of bounded size, by lists (of at most 32 entities) and by counts."""
    rows = {(f"c{i:03d}", "often") for i in range(130)} | {(f"c{i:03d}", f"e{i % 9}") for i in range(0, 130, 2)}
    rows |= {(w, f"x{i}") for w in ("w1", "w2") for i in range(40)} | {("w1", "often"), ("w2", "e4"), ("c001", "alone")}
    m = spark.createDataFrame(sorted(rows), "src string, dst string")
    of = {}
    for c, e in rows:
        of.setdefault(e, set()).add(c)
    want = {}
    for chunks in of.values():
        for a in chunks:
            for b in chunks:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    for cell in (1000, 20):
        monkeypatch.setattr(graph, "_CELL", cell)
        assert sorted(map(tuple, graph.shared_pairs(m).collect())) == sorted((*p, n) for p, n in want.items())
    first, second = graph._ends(m)
    cells = [{tuple(r[:2]): r[2] for r in df.groupBy("dst", "cell").count().collect()} for df in (first, second)]
    assert cells[0].keys() == cells[1].keys() and max(c[k] for c in cells for k in c) <= 60
    assert len([k for k in cells[0] if k[0] == "alone"]) == 1


def test_shared_entity_pairs_leaves_no_entity_out(spark, tmp_path):
    lines = spark.range(60).selectExpr("id AS l_orderkey", "7L AS l_partkey", "0.1D AS l_discount")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert plans.shared_entity_pairs(spark, str(tmp_path)).count() == 60 * 59 // 2
    assert "50" not in ORACLES["shared_entity_pairs"]


def test_short_lists_are_not_broadcast(spark, monkeypatch):
    """By the sizes of their files lists look small, so Spark would send them to the driver."""
    plans_of, real = [], search.written
    said = lambda df: plans_of.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (search, subsets):
        monkeypatch.setattr(module, "written", lambda df, name: said(df) or real(df, name))
    rows = [(i, t, 1.0, i) for i in range(300) for t in ("often", f"w{i % 7}", f"v{i}")]
    p = spark.createDataFrame(rows, "id bigint, term string, weight double, grp bigint")
    got = subsets.best_sparse(p, p.withColumnRenamed("id", "query_id"), 5, alone=True)
    said(got)
    assert got.count() >= 300 * 5
    assert "SortMergeJoin" in plans_of[-1] and not [x for x in plans_of if "BroadcastExchange" in x]


def test_hops_are_not_broadcast(spark, monkeypatch):
    """Seeds, hops and edges grow with the tables, and seeds meet what they reach in many parts."""
    said, real = [], graph.written
    plan = lambda df: said.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(graph, "written", lambda df, name: plan(df) or real(df, name))
    edges = spark.range(200).selectExpr("concat('n', id % 5) AS src", "concat('s', id) AS dst")
    found = graph.k_hop(edges, edges.selectExpr("dst AS node"), 2, "both")
    plan(found)
    assert found.count() == 200 * (1 + 1 + 39)
    assert "SortMergeJoin" in said[-1] and not [x for x in said if "BroadcastExchange" in x]


def test_what_queries_find_is_given_some_queries_at_a_time(spark, monkeypatch):
    """A task holds a block of rows and the results of few queries, however many queries there are."""
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(90, 6)), 3)
    d = spark.createDataFrame([(i, v[i % 80].tolist(), i % 3) for i in range(90)], "id bigint, vector array<float>, grp int")
    q = d.withColumnRenamed("id", "query_id")
    fields = {"a": slice(None), "b": slice(0, 3)}
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(search.knn_fields(d, q, 4, fields, unlike=True))
    assert len(want) == 90 * 2 * 4
    monkeypatch.setattr(search, "_AT_ONCE", 7)
    assert rows(search.knn_fields(d, q, 4, fields, unlike=True, block=20)) == want
    local = pd.DataFrame({"id": range(90), "vector": [v[i % 80] for i in range(90)], "grp": 0})
    asked = local.rename(columns={"id": "query_id", "vector": "asked", "grp": "own"})
    parts = list(search._nearest(search._units(local, fields), asked, 4, fields, None, False))
    assert max(map(len, parts)) == 7 * 2 * 4 and sum(map(len, parts)) == 90 * 2 * 4
    plan = search.knn_fields(d, q, 4, fields)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" not in plan and "MapInPandas" in plan


def test_best_texts_are_those_of_all_scores(spark, monkeypatch):
    """With ties, texts without words, words asked for that no text has, and more blocks than texts to some."""
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choices([f"w{i}" for i in range(25)], [1 / (i + 1) for i in range(25)], k=n))
    docs = [(i, text(rng.randint(1, 9))) for i in range(120)] + [(200 + i, "w0 w1") for i in range(30)] + [(300, ""), (301, None), (302, "\n ")]
    asked = [(i, text(4)) for i in range(40)] + [(50, "nowhere"), (51, "nowhere w3 w3"), (52, "w0"), (53, None), (54, "")]
    d, q = spark.createDataFrame(docs, "id bigint, text string"), spark.createDataFrame(asked, "query_id bigint, text string")
    scores = search.bm25(d, q).withColumn("score", F.round("score", 6))
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())
    want = rows(search.top_k(scores, "query_id", [F.desc("score"), "id"], 8))
    assert len(want) > 300
    for texts in (8000, 10):
        monkeypatch.setattr(search, "_TEXTS", texts)
        assert rows(search.bm25_best(d, q, 8)) == want


def test_prefetch_ranks_no_pairs(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("all pairs of queries and texts go into a shuffle")

    monkeypatch.setattr(search, "bm25", never)
    assert sparse.prefetch_fusion(spark, "/root/testdata/sf0.001").count() > 0
