"""Links kept as documents arrive, weights with a known optimum, summaries against exact quantiles."""

import math
import random

import numpy as np
import pytest

from inkfathom.operators import learning, linking, summaries


def vectors(spark, rng, ids):
    dense = [(i, [float(x) for x in np.round(rng.normal(size=4) + 1, 3)]) for i in ids]
    terms = [(i, f"t{rng.integers(0, 12)}", float(rng.integers(1, 4))) for i in ids for _ in range(3)]
    terms = [(i, t, w) for (i, t), w in {(i, t): w for i, t, w in terms}.items()]
    return {"dense": spark.createDataFrame(dense, "id bigint, vector array<double>"), "sparse": spark.createDataFrame(terms, "id bigint, term string, weight double")}


def both(a, b):
    return {k: a[k].unionByName(b[k]) for k in a}


def rows(df):
    return sorted(tuple(r) for r in df.select("src", "dst", "score", "rank").collect())


def test_links_of_arrivals_are_those_of_all_at_once(spark, monkeypatch):
    monkeypatch.setattr(linking, "LIST", 6)
    rng = np.random.default_rng(1)
    batches = [vectors(spark, rng, range(a, b)) for a, b in ((0, 25), (25, 32), (32, 33), (33, 45))]
    whole, lists = batches[0], None
    lists = linking.dense_lists(whole["dense"], whole["dense"]).unionByName(linking.sparse_lists(whole["sparse"], whole["sparse"]))
    before = {(s, d) for s, d, _, _ in rows(linking.linked(lists, "fused"))}
    for batch in batches[1:]:
        lists = spark.createDataFrame(linking.arrived(lists, whole, batch).collect(), "src bigint, kind string, dst bigint, score double")
        whole = both(whole, batch)
    anew = linking.dense_lists(whole["dense"], whole["dense"]).unionByName(linking.sparse_lists(whole["sparse"], whole["sparse"]))
    for method in ("fused", "dense"):
        assert rows(linking.linked(lists, method)) == rows(linking.linked(anew, method)) != []
    after = {(s, d) for s, d, _, _ in rows(linking.linked(lists, "fused"))}
    assert any(s < 25 and d >= 25 for s, d in after) and before - after  # new partners took old ones' places
    assert max(r[3] for r in rows(linking.linked(lists, "dense"))) <= linking.LINKS


def test_links_by_title(spark):
    lists = spark.createDataFrame([(1, "title", d, s) for d, s in ((2, 1.9), (3, 2.0), (4, 9.0), (5, 3.0), (6, 3.0), (7, 3.0), (8, 3.0))], "src bigint, kind string, dst bigint, score double")
    assert [r[1] for r in sorted(rows(linking.linked(lists, "title")), key=lambda r: r[3])] == [4, 5, 6, 7, 8]


def test_weights_reach_a_known_optimum(spark):
    rng = np.random.default_rng(2)
    best, sharp = np.array([0.6, 0.1, 0.3, 0.0]), 8.0
    x = rng.random((900, 4))
    x[0], x[1] = 0, 1  # so that scaling changes nothing
    data = [(f"q{i % 30}", *map(float, x[i]), float(sharp * x[i] @ best)) for i in range(900)] + [("q0", None, 1.0, 1.0, 1.0, 1.0), (None, 0.5, 0.5, 0.5, 0.5, 4.0)]
    d = spark.createDataFrame(data, "g string, a double, b double, c double, d double, gain double")
    w, losses = learning.tune_weights(d, "g", ["a", "b", "c", "d"], "gain", sharp)
    assert np.abs(w - best).max() < 0.01 and abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
    assert all(a >= b - 1e-12 for a, b in zip(losses, losses[1:])) and losses[-1] < losses[0]
    none, _ = learning.tune_weights(d.where("false"), "g", ["a", "b"], "gain")
    assert none.tolist() == [0.5, 0.5]


def test_the_simplex():
    rng = np.random.default_rng(3)
    for _ in range(50):
        v = rng.normal(size=5) * 3
        p = learning.on_simplex(v)
        assert abs(p.sum() - 1) < 1e-9 and (p >= 0).all()
        assert all(((v - q) ** 2).sum() >= ((v - p) ** 2).sum() - 1e-9 for q in rng.dirichlet(np.ones(5), 100))


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_summaries_are_as_exact_as_they_say(spark, tmp_path, error):
    rng = random.Random(4)
    values = [(g, s * math.exp(rng.gauss(0, 4))) for g, s in (("a", 1), ("b", -1), (None, 1)) for _ in range(400)] + [("a", 0.0)] * 30 + [("z", None), ("z", float("nan")), ("i", float("inf")), ("i", 1.0), ("i", float("-inf"))]
    t = summaries.summary_table(spark, str(tmp_path / "t"))
    for n in range(4):
        part = spark.createDataFrame(values[n::4], "grp string, n double")
        version = summaries.added(t, summaries.summary(part, "grp", "n", error), "s", n)
        assert summaries.added(t, summaries.summary(part, "grp", "n", error), "s", n) == version  # again after a crash
    got = {r["grp"]: r for r in summaries.quantiles(t.read(), [0.0, 0.25, 0.5, 0.95, 0.99, 1.0], error).collect()}
    assert set(got) == {"a", "b", "i", None}
    for g in ("a", "b", None):
        own = sorted(v for k, v in values if k == g)
        assert got[g]["count"] == len(own) and abs(got[g]["mean"] - sum(own) / len(own)) <= 1e-9 * sum(map(abs, own))
        for p in (0.0, 0.25, 0.5, 0.95, 0.99, 1.0):
            exact = own[math.floor(p * (len(own) - 1))]
            assert abs(got[g][f"p{p * 100:g}"] - exact) <= error * abs(exact) * (1 + 1e-9)
    assert (got["i"]["p0"], got["i"]["p100"]) == (float("-inf"), float("inf"))
    assert t.read().count() < 1000 if error == 0.01 else 200
