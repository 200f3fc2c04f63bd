"""Connected components of an edge table, by alternating star contractions.

No task or driver ever holds a component: each round is two grouped minima and
two joins over the edges left. Rounds are written to the shared folder.

In a round's joins a hub's rows are left to adaptive skew handling. For joins of
what the rounds find there is ``join_spread``: a key of more than one in
``SHARE`` rows is a hub; there are fewer hubs than ``SHARE``, so what is joined
to their rows is broadcast, and the rows stay spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import spool

SHARE = 1000


def join_spread(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, spread: str) -> DataFrame:
    """``left`` with the columns of ``right`` (one row a key), null where it has none.

    ``count``: right's column of how many of the ``total`` left rows have the key;
    it is left out. ``spread``: a column of left by which a hub's rows are dealt out.
    The last of the keys is a bigint.
    """
    rest, last = [c for c in right.columns if c not in (*keys, count)], keys[-1]
    hubs = right.where(F.col(count) * SHARE > total).select(
        *(F.col(c).alias(f"__hub_{c}") for c in (*keys, *rest)), F.lit(True).alias("__is_hub")
    )
    marked = left.join(F.broadcast(hubs), [F.col(c) == F.col(f"__hub_{c}") for c in keys], "left")
    # A hub's row has its values already; under another key it only has to go somewhere.
    key = F.when(F.col("__is_hub"), F.xxhash64(spread)).otherwise(F.col(last)).alias("__key")
    own = right.select(*keys[:-1], F.col(last).alias("__key"), *(F.col(c).alias(f"__own_{c}") for c in rest))
    joined = marked.select("*", key).join(own, [*keys[:-1], "__key"], "left")
    of = lambda c: F.when(F.col("__is_hub"), F.col(f"__hub_{c}")).otherwise(F.col(f"__own_{c}")).alias(c)
    return joined.select(*(F.col(c) for c in left.columns), *map(of, rest))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (
        both.where("b > a").join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    ).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are tied to the least one."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    tied = edges.join(least, "a")
    return (
        tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    ).where("a <> b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns a, b: bigint).

    The root is the least node of the component and has a row of its own. Null
    ends and loops are left out; repeated edges do no harm. An empty table gives
    an empty result. Raises if ``rounds`` do not suffice.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    e = spool(e.distinct(), "cc")
    before = None
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        e = spool(_small_star(_large_star(e)).distinct(), "cc")
        mark = e.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if (now := (mark["n"], mark["h"])) == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
