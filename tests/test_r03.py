"""Work that once grew with the square of the input."""

import random

import pytest

from inkfathom.operators import graph
from inkfathom.plans import paths

NAMES = ("nation", "supplier", "customer")


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Two nations of 40 suppliers and 30 customers each; the second's procedures also belong to the first."""
    d = tmp_path_factory.mktemp("crowded")
    made = {
        "nation": ([(0, "a"), (1, "b"), (2, "c")], "n_nationkey int, n_name string"),
        "supplier": ([(i, i % 2) for i in range(80)] + [(i, 0) for i in range(1, 80, 2)], "s_suppkey bigint, s_nationkey int"),
        "customer": ([(i, i % 2, f"m{i % 3}") for i in range(60)], "c_custkey bigint, c_nationkey int, c_mktsegment string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return str(d)


def test_procedures_of_the_same_nations_are_walked_once(spark, crowded, monkeypatch):
    walked, real = [], paths.walks.typed_walks
    monkeypatch.setattr(paths.walks, "typed_walks", lambda e, seeds, *a, **k: walked.append((e.count(), seeds.count())) or real(e, seeds, *a, **k))
    got = paths.resolution_steps(spark, crowded).collect()
    assert all(edges <= 2 * 60 and seeds <= 3 for edges, seeds in walked)
    by_error = {e: sorted(r["procedure"] for r in got if r["error"] == e) for e in ("n0", "n1", "n2")}
    assert by_error == {"n0": sorted(f"s{i}" for i in range(80))[:10], "n1": sorted(f"s{i}" for i in range(1, 80, 2))[:10], "n2": []}
    own = lambda r: {int(x.split(":")[0][1:]): int(x.split(":")[2]) for x in r["ordered_steps"].split(",")}
    for r in got:
        nations = (0,) if int(r["procedure"][1:]) % 2 == 0 else (0, 1)
        want = {}
        for n in nations:
            mine = list(range(n, 60, 2))
            for at, c in enumerate(mine):
                for up in range(3):
                    if at >= up and mine[at - up] % 5 == 0:
                        want[c] = min(want.get(c, 9), up + 2)
        assert own(r) == want and r["step_count"] == len(want)


@pytest.mark.parametrize("hops", [2, 3])
def test_seeds_of_the_same_neighbours_are_walked_once(spark, monkeypatch, hops):
    edges = [(f"s{i}", f"n{i % 2}") for i in range(40)] + [("n0", "r"), ("n1", "r"), ("s0", "n1")] + [("hub", f"h{i}") for i in range(70)] + [("h3", "s1"), ("s1", "s1")]
    e = spark.createDataFrame([*edges, (None, "n0"), ("n0", None)], "src string, dst string")
    names = [f"s{i}" for i in range(40)] + ["hub", "lone"]
    kept, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: kept.append((name, df.count())) or real(df, name))
    got = sorted(map(tuple, graph.k_hop(e, spark.createDataFrame([(n,) for n in names], "node string"), hops, "both").collect()))
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = []
    for n in names:
        dist, front = {n: 0}, {n}
        for d in range(1, hops + 1):
            front = {y for x in front for y in near.get(x, ())} - set(dist)
            dist |= dict.fromkeys(front, d)
        want += [(n, y, d) for y, d in dist.items()]
    assert got == sorted(want)
    assert sum(n for name, n in kept if name == "hops") < 500 < len(want)


def test_shortest_paths_of_lone_and_several_middles(spark, monkeypatch):
    """Each end is told whether it has one middle alone; pairs of two ends with several keep the least path."""
    told, real = [], graph.walks.written
    monkeypatch.setattr(graph.walks, "written", lambda df, name: real(df, name) if name != "ends" else told.append(real(df, name)) or told[-1])
    rows = [("a", "m1"), ("a", "m2"), ("b", "m1"), ("c", "m2"), ("c", "m1"), ("d", "m3")]
    e = spark.createDataFrame(rows + [(y, x) for x, y in rows] + [("a", "c")], "src string, dst string")
    ends = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    got = {(r["seed"], r["node"], r["distance"], r["path"]) for r in graph.shortest_paths(e, ends, ends, 2, "out").collect()}
    assert got == {
        ("a", "c", 1, "a>c"), ("a", "b", 2, "a>m1>b"), ("b", "a", 2, "b>m1>a"), ("b", "c", 2, "b>m1>c"),
        ("c", "a", 2, "c>m1>a"), ("c", "b", 2, "c>m1>b"),
    }
    assert any(set(map(tuple, t.select("seed", "alone").collect())) >= {("b", True), ("c", False), ("d", True)} for t in told if "seed" in t.columns)


def test_shared_pairs_are_made_where_their_least_entity_is(spark, monkeypatch):
    """Wide chunks (of more than 32 entities) and others, entities of too many chunks left out; what is kept is no more than the mentions."""
    rng = random.Random(5)
    rows = {(f"c{rng.randint(0, 59)}", f"e{rng.randint(0, 99)}") for _ in range(500)}
    rows |= {("w1", f"e{i}") for i in range(60)} | {("w2", f"e{i}") for i in range(40, 99)} | {(f"c{i}", "common") for i in range(60)}
    kept, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: kept.append(df.count()) or real(df, name))
    m = spark.createDataFrame(sorted(rows), "src string, dst string")
    got = sorted(map(tuple, graph.shared_pairs(m, 2, 50).collect()))
    of = {}
    for c, e in rows:
        of.setdefault(e, set()).add(c)
    want = {}
    for chunks in of.values():
        if 2 <= len(chunks) <= 50:
            for a in chunks:
                for b in chunks:
                    if a < b:
                        want[a, b] = want.get((a, b), 0) + 1
    assert got == sorted((*p, n) for p, n in want.items())
    assert kept and sum(kept) <= len(rows)
