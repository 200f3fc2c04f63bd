"""Sparse top-k by two reads against the sums of all postings."""

import random

import pytest

from inkfathom.operators import fusion, impacts, search
from inkfathom.sources.scratch import written

SPARSE = "{} bigint, term string, weight double, grp bigint"


def best(scores, k):
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]


def by_hand(docs, queries, k, unlike):
    found = {}
    for q, own in {(r[0], r[3]) for r in queries}:
        scores = {}
        for a, t, x, _ in (r for r in queries if r[0] == q and r[1] and r[2] and r[2] > 0):
            for d, u, y, grp in docs:
                if t == u and y and y > 0 and not (unlike and grp == own):
                    scores[d] = scores.get(d, 0.0) + x * y
        for rank, (d, s) in enumerate(best(scores, k), 1):
            found[q, rank] = (d, round(s, 6))
    return found


@pytest.mark.parametrize("k, unlike", [(1, False), (5, False), (5, True), (400, False)])
def test_best_of_few_terms(spark, k, unlike):
    rng = random.Random(k)
    zipf = [f"t{i}" for i in range(60)]
    share = [1 / (i + 1) for i in range(60)]
    docs = [(d, t, round(rng.random() ** 3 * 5 + 0.01, 3), d % 3) for d in range(300) for t in set(rng.choices(zipf, share, k=8))]
    docs += [(5, None, 1.0, 2), (6, "t1", None, 0), (7, "t1", -1.0, 1), (8, "t0", float("nan"), 2), (9, "t2", 0.5, 0)]
    queries = [(q, t, round(rng.random() + 0.1, 3), q % 3) for q in range(12) for t in set(rng.choices(zipf, share, k=3))]
    queries += [(20, "absent", 1.0, 0), (21, None, 1.0, 0), (22, "t59", 1.0, 1)]
    d, q = spark.createDataFrame(docs, SPARSE.format("id")), spark.createDataFrame(queries, SPARSE.format("query_id"))
    found = impacts.best_sparse(d, q, k, slack=1e-5, unlike=unlike)
    got = search.top_k(found, "query_id", ["query_id", found["score"].desc(), "id"], k).collect()
    fine = [r for r in docs if r[2] == r[2]]
    assert {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 6)) for r in got} == by_hand(fine, queries, k, unlike)


def test_few_postings_are_read(spark):
    """A rare and a frequent word: of the frequent one's postings only few are read."""
    rng = random.Random(3)
    docs = [(d, "often", round(0.2 + rng.random() * 0.2, 3), 0) for d in range(20_000)]
    docs += [(d, f"rare{r}", round(4 + rng.random(), 3), 0) for r in range(5) for d in rng.sample(range(20_000), 40)]
    queries = [(r, t, 1.0, 0) for r in range(5) for t in ("often", f"rare{r}")]
    d = written(spark.createDataFrame(docs, SPARSE.format("id")).drop("grp"), "test")
    q = spark.createDataFrame(queries, SPARSE.format("query_id")).drop("grp")
    first, second = impacts.reads(d, q, 10)
    assert first.count() + second.count() < 0.02 * 5 * 20_040
    found = search.top_k(impacts.best_sparse(d, q, 10), "query_id", ["query_id", impacts.F.desc("score"), "id"], 10).collect()
    assert {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 6)) for r in found} == by_hand(docs, queries, 10, False)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id bigint, term string, weight double")
    q = spark.createDataFrame([(1, "a", 1.0)], "query_id bigint, term string, weight double")
    assert impacts.best_sparse(none, q, 3).collect() == []
    assert impacts.best_sparse(none.union(none.sparkSession.createDataFrame([(1, "a", 1.0)], none.schema)), q.where("false"), 3).collect() == []


def test_words_and_counts(spark):
    texts = [(1, " A b\nb  "), (2, ""), (3, None), (4, "c"), (4, "c c")]
    counts = search.term_counts(spark.createDataFrame(texts, "id bigint, text string"), spark.createDataFrame([("b",), ("c",)], "term string"))
    assert sorted((r["id"], r["dl"], r["term"], r["tf"]) for r in counts.collect()) == [
        (1, 3, "", 1), (1, 3, "b", 2), (2, 0, "", 1), (3, 0, "", 1), (4, 1, "", 1), (4, 1, "c", 1), (4, 2, "", 1), (4, 2, "c", 2),
    ]


def test_distribution_fusion(spark):
    lists = spark.createDataFrame([(1, "a", 1, 1.0), (1, "a", 2, 3.0), (1, "b", 2, 7.0)], "query_id bigint, field string, id bigint, score double")
    got = {r["id"]: round(r["fused"], 6) for r in fusion.distribution_fusion(lists).collect()}
    assert got == {1: round((1 - 2 + 3) / 6, 6), 2: round((3 - 2 + 3) / 6 + 0.5, 6)}


def test_fuzzy_references_ask_for_the_phrase(spark):
    from inkfathom.operators import building

    titles = [(1, "Green apple pie"), (2, "Red apple"), (3, "red apple tart"), (4, "RED APPLE"), (5, "the red and apple"), (6, None), (7, "go on")]
    hints = [(1, "red apple", 0.9), (2, "apple  red", 0.9), (3, "go", 0.9), (4, "pie\x00", 0.2), (5, None, 0.5), (6, "   ", 0.5), (7, "pear", 0.4)]
    got = building.fuzzy(spark.createDataFrame(hints, "query_id bigint, text string, confidence double"), spark.createDataFrame(titles, "id bigint, text string"), least=0.1)
    assert sorted((r["query_id"], r["state"], r["id"], r["confidence"]) for r in got.collect()) == [
        (1, "resolved", 2, 0.65), (2, "pending", None, 0.9), (3, "pending", None, 0.9), (4, "resolved", 1, 0.1), (5, "pending", None, 0.5), (6, "pending", None, 0.5), (7, "pending", None, 0.4),
    ]


def test_text_batches_of_a_long_document(spark):
    from inkfathom.operators import building

    rows = spark.range(30_000).selectExpr("1 AS d", "id AS n", "id % 7 AS size").unionByName(spark.createDataFrame([(2, 0, 99), (2, 1, None), (2, 2, 1)], "d int, n bigint, size bigint"))
    got = {(r["d"], r["n"]): r["batch"] for r in building.text_batches(rows, "d", "n", "size", 5, 12).collect()}
    batch = n = used = 0
    for i in range(30_000):
        if n and (n >= 5 or used + i % 7 > 12):
            batch, n, used = batch + 1, 0, 0
        n, used = n + 1, used + i % 7
        assert got[1, i] == batch
    assert [got[2, i] for i in range(3)] == [0, 1, 1]
