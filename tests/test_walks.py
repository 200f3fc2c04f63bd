"""Typed walks and two-ended search against enumeration in plain Python."""

import random

from inkfathom.operators import graph, walks
from inkfathom.operators.walks import edge, either, some, then, times


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, type string, confidence double")


def seeds_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def accepted(pattern, depth):
    """Whether a word of (type, way) is one of the pattern's, by its sets of states."""
    moves = pattern.moves()

    def states(word):
        now = {0}
        for kind, way in word:
            now = {b for a, k, w, b in moves if a in now and w == way and k in (None, kind)}
        return now

    return lambda word: bool(states(word) & pattern.last)


def enumerated(rows, seeds, pattern, depth):
    """seed, node -> least length, over all walks."""
    steps = [(a, b, t, "out") for a, b, t, _ in rows if a and b] + [(b, a, t, "in") for a, b, t, _ in rows if a and b]
    ok, found = accepted(pattern, depth), {}
    for seed in seeds:
        at = {(seed, ())}
        for d in range(1, depth + 1):
            at = {(b, word + ((t, way),)) for node, word in at for a, b, t, way in steps if a == node}
            for node, word in at:
                if node != seed and ok(word):
                    found.setdefault((seed, node), d)
    return found


def test_patterns_are_languages():
    p = then(edge("A"), times(edge("B"), 1, 3), either(edge("C", way="in"), times(edge("D"), 0, 1)))
    ok = accepted(p, 9)
    say = lambda text: [(c.upper(), "in" if c.islower() else "out") for c in text]
    for word in ("AB", "ABB", "ABBB", "ABc", "ABBD"):
        assert ok(say(word)), word
    for word in ("", "A", "ABBBB", "ABC", "ABcD", "B", "ABDD"):
        assert not ok(say(word)), word
    ok = accepted(some(then(edge("A"), edge("B", way="both"))), 9)
    assert ok(say("AB")) and ok(say("Ab")) and ok(say("ABAb")) and not ok(say("ABA")) and not ok([])


def test_walks_against_enumeration(spark):
    rng = random.Random(1)
    rows = [(f"n{rng.randint(0, 11)}", f"n{rng.randint(0, 11)}", rng.choice("ABC"), 0.5) for _ in range(26)]
    rows += [(None, "n1", "A", 1.0), ("n1", None, "A", 1.0), ("n2", "n3", None, 1.0), rows[0]]
    seeds = ["n0", "n3", "n7", "absent"]
    patterns = [
        some(edge("A", "B")), some(edge(way="both")), then(edge("A", way="in"), times(edge("B", "C"), 1, 2)),
        then(some(edge("A", way="both")), edge("C")), either(edge("A"), then(edge("B"), edge("B"))),
    ]
    for p in patterns:
        want = enumerated(rows, seeds, p, 3)
        got = walks.typed_walks(edges_of(spark, rows), seeds_of(spark, *seeds, "n0"), p, 3, properties=["confidence"]).collect()
        assert {(r["seed"], r["node"]): r["distance"] for r in got} == want and len(got) == len(want)
        ok = accepted(p, 3)
        have = {(a, b, t, "out") for a, b, t, _ in rows} | {(b, a, t, "in") for a, b, t, _ in rows}
        for r in got:
            assert r["nodes"][0] == r["seed"] and r["nodes"][-1] == r["node"] and len(r["edges"]) == r["distance"] == len(r["nodes"]) - 1
            assert ok([(e["type"], e["way"]) for e in r["edges"]])
            assert all((a, b, e["type"], e["way"]) in have for a, b, e in zip(r["nodes"], r["nodes"][1:], r["edges"]))


def test_walks_are_capped_and_aimed(spark):
    rows = [("s", f"a{i}", "A", 1.0) for i in range(5)] + [("a0", "z", "A", 1.0), ("t", "a0", "A", 1.0)]
    e = edges_of(spark, rows)
    got = sorted((r["seed"], r["node"]) for r in walks.typed_walks(e, seeds_of(spark, "s", "t"), some(edge("A")), 3, per_seed=2).collect())
    assert got == [("s", "a0"), ("s", "a1"), ("t", "a0"), ("t", "z")]
    aim = spark.createDataFrame([("s", "z"), ("t", "a0")], "seed string, node string")
    got = {(r["seed"], r["node"]): r["distance"] for r in walks.typed_walks(e, seeds_of(spark, "s", "t"), some(edge("A")), 3, 2, aim).collect()}
    assert got == {("s", "z"): 2, ("t", "a0"): 1}
    assert walks.typed_walks(e.where("false"), seeds_of(spark, "s"), some(edge("A")), 3).collect() == []
    assert walks.typed_walks(e, seeds_of(spark, "s").where("false"), some(edge("A")), 3).collect() == []


def shortest_by_hand(rows, sources, targets, hops):
    found = {}
    for s in sources:
        level, seen = {s: [s]}, {s}
        for d in range(1, hops + 1):
            more = {}
            for node, path in level.items():
                for a, b in rows:
                    if a == node and b not in seen:
                        one = path + [b]
                        if b not in more or ">".join(one) < ">".join(more[b]):
                            more[b] = one
            seen |= set(more)
            for t in targets:
                if t in more:
                    found[s, t] = (d, ">".join(more[t]))
            level = more
    return found


def test_shortest_paths_against_breadth_first_search(spark):
    rng = random.Random(2)
    for hops in (1, 2, 3, 4, 5):
        rows = list({(f"n{rng.randint(0, 39)}", f"n{rng.randint(0, 39)}") for _ in range(70)})
        names = [f"n{i}" for i in range(0, 40, 3)]
        e = spark.createDataFrame(rows + [(None, "n1"), ("n1", None)], "src string, dst string")
        got = graph.shortest_paths(e, seeds_of(spark, *names), seeds_of(spark, *names[::-1], "n1"), hops, "out").collect()
        assert {(r["seed"], r["node"]): (r["distance"], r["path"]) for r in got} == shortest_by_hand(rows, names, [*names, "n1"], hops)


def test_a_hub_is_met_not_expanded(spark):
    """A hundred thousand neighbours between two ends, and more beyond: the search stays with the ends."""
    leaves = spark.range(100_000).selectExpr("'hub' AS src", "concat('leaf', id) AS dst")
    beyond = spark.range(100_000).selectExpr("concat('leaf', id) AS src", "concat('far', id % 1000) AS dst")
    ends = spark.createDataFrame([("a", "hub"), ("b", "hub"), ("far7", "c")], "src string, dst string")
    e = leaves.unionByName(beyond).unionByName(ends)
    got = {(r["seed"], r["node"], r["distance"], r["path"]) for r in graph.shortest_paths(e, seeds_of(spark, "a"), seeds_of(spark, "b", "c"), 5).collect()}
    assert got == {("a", "b", 2, "a>hub>b"), ("a", "c", 4, "a>hub>leaf10007>far7>c")}
    near = graph.nearest_paths(e, seeds_of(spark, "a"), 2, "both")
    assert near.count() == 100_002
