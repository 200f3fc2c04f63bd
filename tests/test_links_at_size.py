"""Searches that do not meet all pairs give what those that do give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfathom.operators import impacts, linking, search, subsets
from inkfathom.plans import linking as plans


def found(df):
    return sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("unlike, block", [(True, 20_000), (False, 40)])
def test_near_cells_hold_all_that_counts(spark, unlike, block):
    rng = np.random.default_rng(5)
    v = [[float(x) for x in np.round(rng.normal(size=4) + [0.4, 0, 0, 0], 3)] for _ in range(400)]
    v += [v[0]] * 90 + [[0.0] * 4, None, [1.0, None, 0.0, 0.0], [1.0, float("nan"), 0.0, 0.0], [1.0, 2.0], [1.0, 2.5], [-9.0, 0.1, 0.0, 0.0]]
    d = spark.createDataFrame([(i, x, i % 7) for i, x in enumerate(v)], "id bigint, vector array<double>, grp int")
    q = d.withColumnRenamed("id", "query_id")
    got = found(search.knn_near(d, q, 8, 0.5, unlike, cell=20, block=block))
    assert got == found(search.knn(d, q, 8, least=0.5, unlike=unlike)) and len(got) > 3000


def test_short_vectors_with_ties(spark):
    rng = random.Random(6)
    words, share = [f"t{i}" for i in range(30)], [1 / (i + 1) for i in range(30)]
    docs = [(d, t, rng.choice([1.0, 2.0, 0.3]), d % 3) for d in range(400) for t in set(rng.choices(words, share, k=rng.randint(1, 5)))]
    docs += [(500, t, 1.0, 1) for t in words[:9]] + [(501, None, 1.0, 1), (502, "t0", float("nan"), 1)]
    asked = [(q, t, 1.0, g) for q, t, _, g in docs if q % 5 == 0]
    p, q = spark.createDataFrame(docs, "id bigint, term string, weight double, grp bigint"), spark.createDataFrame(asked, "query_id bigint, term string, weight double, grp bigint")
    ids = lambda df, key: df.withColumn("grp", F.col(key))
    for k, alone, (a, b) in ((4, False, (p, q)), (7, True, (ids(p, "id"), ids(q, "query_id"))), (1000, False, (p, q))):
        best = lambda df: found(search.top_k(df.withColumn("score", F.round("score", 6)), "query_id", [F.desc("score"), "id"], k))
        got = best(subsets.best_sparse(a, b, k, 1e-5, alone))
        assert got == best(impacts.best_sparse(a, b, k, 1e-5, True)) and got


def test_lists_of_a_frequent_word_are_bounded(spark):
    """All of 3000 titles have a word in common: what a query reads does not grow with them."""
    p = spark.createDataFrame([(i, t, 1.0, i) for i in range(3000) for t in ("often", f"w{i}")], "id bigint, term string, weight double, grp bigint")
    got = subsets.best_sparse(p, p.withColumnRenamed("id", "query_id"), 5, alone=True)
    assert got.count() <= 3000 * 6


def test_dense_links_make_no_sparse_lists(spark, monkeypatch):
    def never(*_):
        raise AssertionError

    monkeypatch.setattr(linking, "sparse_lists", never)
    assert plans.dense_links(spark, "/root/testdata/sf0.001").count() > 0
