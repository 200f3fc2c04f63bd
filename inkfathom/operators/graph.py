"""Graph operators over edge tables (src, dst, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfathom.operators import walks
from inkfathom.operators.walks import met
from inkfathom.sources.scratch import written


def adjacency(rows: DataFrame, group: str | list[str], order: Sequence[str], id_col: str) -> DataFrame:
    """src, dst of each row and the next one of its group; n-1 edges a group."""
    w = Window.partitionBy(group).orderBy(*order)
    return (
        rows.select(F.col(id_col).alias("src"), F.lead(id_col).over(w).alias("dst")).where("dst is not null")
    )


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Edges to walk along: as they are, reversed, or both."""
    out = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": out, "in": back, "both": out.union(back).distinct()}[direction]


#: Seeds of so many neighbours at most are told apart by them.
_NARROW = 64


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "out") -> DataFrame:
    """seed, node, distance: least number of hops, the seed itself at 0.

    ``seeds``: column node; null ends lead nowhere. Seeds of the same neighbours reach
    the same nodes at the same distances, but for themselves. So each set of
    neighbours is walked from once, for the least seed that has it, from the last
    step's frontier only, and the rows of all its seeds are made at the end, where
    they are neither shuffled nor kept. (A seed of more than ``_NARROW`` neighbours
    stands for itself.) All joins are by sorted shuffles: what grows with seeds or
    edges is never sent to the driver, however small its files are.
    """
    walk = directed(edges, direction).where("src is not null and dst is not null").distinct().hint("merge")
    starts = seeds.select(F.col("node").alias("seed")).distinct()
    found = starts.select("seed", F.col("seed").alias("node"), F.lit(0).alias("distance"))
    if hops < 1:
        return found
    first = starts.join(walk, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("node"))
    if hops == 1:
        return found.unionByName(first.where("seed <> node").withColumn("distance", F.lit(1)))
    first = written(first, "hops")
    few = first.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") <= _NARROW)
    narrow = first.join(few.hint("merge"), "seed", "left_semi")
    sets = narrow.groupBy("seed").agg(F.sort_array(F.collect_list("node")).alias("has"))
    least = sets.groupBy("has").agg(F.min("seed").alias("like"))
    alone = first.select("seed").distinct().join(sets.select("seed").hint("merge"), "seed", "left_anti").withColumn("like", F.col("seed"))
    members = written(sets.join(least.hint("merge"), "has").select("seed", "like").unionByName(alone), "members")
    frontier = first.withColumnRenamed("seed", "like").join(members.select("like").distinct().hint("merge"), "like", "left_semi")
    reached = frontier.withColumn("distance", F.lit(1))
    for d in range(2, hops + 1):
        step = frontier.join(walk, F.col("node") == F.col("src")).select("like", F.col("dst").alias("node")).distinct()
        frontier = written(step.join(reached.select("like", "node").hint("merge"), ["like", "node"], "left_anti"), "hops")
        reached = reached.unionByName(frontier.withColumn("distance", F.lit(d)))
    return found.unionByName(met(members, reached, "like").where("seed <> node").select("seed", "node", "distance"))


def nearest_paths(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "out") -> DataFrame:
    """seed, node, distance, path (array): of each node within 1 to ``hops`` edges one
    shortest path, of equal ones that of least text."""
    levels = walks.reach(directed(edges, direction), seeds, hops)
    parts = [level.withColumn("distance", F.lit(d)) for d, level in enumerate(levels) if d]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select("seed", "node", "distance", "path")


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """seed, node, distance, path: one shortest path (least by text) of each pair, searched from both ends."""
    return walks.shortest_paths(directed(edges, direction), sources, targets, hops)


#: A chunk of so many entities at most takes them along.
_LISTED = 32

#: Chunks of an entity that meet in one place.
_CELL = 1000


def _ends(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (dst, src, ...) as the first and as the second end of a pair, with ``cell``: each two of a dst meet in one cell.

    A dst of more than ``_CELL`` rows is cut into parts, and each two of its parts meet in a
    cell of their own: no task holds all of its rows, and what is shuffled
    beyond the rows themselves is a small share of the pairs.
    """
    many = written(rows.groupBy("dst").agg(F.ceil(F.count("*") / _CELL).alias("of")).where("of > 1"), "crowded")
    if many.isEmpty():
        here = rows.withColumn("cell", F.lit(0).cast("bigint"))
        return here, here
    cut = rows.join(many, "dst", "left").withColumn("of", F.coalesce("of", F.lit(1).cast("bigint"))).withColumn("part", F.pmod(F.xxhash64("src"), F.col("of")))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("of") - 1))
    met = cut.withColumn("other", every)
    first = met.withColumn("cell", F.col("part") * F.col("of") + F.col("other"))
    second = met.withColumn("cell", F.col("other") * F.col("of") + F.col("part"))
    return first.drop("of", "part", "other"), second.drop("of", "part", "other")


def shared_pairs(mentions: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """a < b, shared: entities that both chunks mention; entities of fewer than
    ``least`` or, if it is given, more than ``most`` chunks make no pairs.

    Each mention takes the entities of its chunk along: a pair is counted where it meets
    at its least entity, and no pairs are shuffled. Only those with a chunk of more
    than ``_LISTED`` entities are counted by a shuffle. Mentions meet by sorted
    shuffles: a file's size does not tell how large its lists are in memory.
    """
    held = F.col("n") >= least if most is None else F.col("n").between(least, most)
    sized = mentions.groupBy("dst").agg(F.count("*").alias("n")).where(held)
    own = mentions.select("src", "dst").join(sized.select("dst"), "dst", "left_semi").distinct()
    many = own.groupBy("src").agg(F.count("*").alias("n"))
    few = own.join(many.where(F.col("n") <= _LISTED).select("src"), "src", "left_semi")
    lists = few.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("has"))
    listed = lists.select("src", "has", F.explode("has").alias("dst"))
    wide = own.join(many.where(F.col("n") > _LISTED).select("src"), "src", "left_semi")
    rows = written(listed.unionByName(wide.withColumn("has", F.lit(None).cast(listed.schema["has"].dataType))), "mentions")
    first, second = _ends(rows)
    a = first.select(F.col("src").alias("a"), "dst", "cell", F.col("has").alias("one"))
    b = second.select(F.col("src").alias("b"), "dst", "cell", F.col("has").alias("other"))
    two = lambda x, y: x.join(y.hint("merge"), ["dst", "cell"]).where("a < b")
    both = F.array_intersect("one", "other")
    inline = two(a.where("one is not null"), b.where("other is not null")).withColumn("both", both)
    inline = inline.where(F.array_min("both") == F.col("dst")).select("a", "b", F.size("both").cast("bigint").alias("shared"))
    long_a, short_a = (a.where(f"one is {has}").drop("one") for has in ("null", "not null"))
    rest = two(long_a, b.drop("other")).unionByName(two(short_a, b.where("other is null").drop("other")))
    return inline.unionByName(rest.groupBy("a", "b").agg(F.count("*").alias("shared")))


#: Rows to a task of what is counted by key.
PART = 500_000


def dealt(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows dealt by the key, for ``n`` rows to be counted: what a task holds does not grow with the table, and groups of the key are not shuffled again."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // PART)), key)


def coverage(edges: DataFrame) -> DataFrame:
    """src, edges, targets: out-edges and distinct ends."""
    each = edges.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return each.groupBy("src").agg(F.sum("n").alias("edges"), F.count("dst").alias("targets"))


def nearest_before(rows: DataFrame, parents: DataFrame, group: str, order: str, parent_id: str) -> DataFrame:
    """Adds parent: the last parent of the group at an earlier place (as-of join).

    One sort of both sides by group and place, no pairs.
    """
    a = rows.select("*", F.lit(1).alias("__kind"), F.lit(None).cast(parents.schema[parent_id].dataType).alias("__parent"))
    b = parents.select(group, order, F.lit(0).alias("__kind"), F.col(parent_id).alias("__parent"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(group).orderBy(order, F.desc("__kind"), "__parent").rowsBetween(Window.unboundedPreceding, -1)
    return (
        both.withColumn("parent", F.last("__parent", ignorenulls=True).over(w)).where("__kind = 1").drop("__kind", "__parent")
    )


#: Relations that may be made between entities.
ENTITY_RELATIONS = ("CONTAINS_STEP", "REFERENCES", "CONFIGURES", "RESOLVES")


def relation_outcomes(edges: DataFrame, nodes: DataFrame, allowed: Sequence[str] = ENTITY_RELATIONS) -> DataFrame:
    """type, created, missing, refused: distinct edges (type, src, dst) by what becomes of them; ``nodes``: dst that exist."""
    known = nodes.select("dst", F.lit(True).alias("__known"))
    e = edges.distinct().join(known, "dst", "left")
    may, there = F.col("type").isin(*allowed), F.col("__known").isNotNull()
    return e.groupBy("type").agg(F.count_if(may & there).alias("created"), F.count_if(may & ~there).alias("missing"), F.count_if(~may).alias("refused"))


def connecting_nodes(edges: DataFrame, seeds: DataFrame, hops: int, most: int) -> DataFrame:
    """node, distance: nodes on a shortest path between two of the (few) seeds, seeds left out, by least length of the path."""
    found = shortest_paths(edges, seeds, seeds, hops, "both").where("seed < node")
    on = found.select(F.explode(F.split("path", ">")).alias("node"), "distance").join(seeds.select("node"), "node", "left_anti")
    return on.groupBy("node").agg(F.min("distance").alias("distance")).orderBy("distance", "node").limit(most)


def prune_edges(edges: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """src, dst, score, kept: edges by late interaction of their ends' vectors
    (doc, m: a bounded list each); one that lacks vectors is kept without a score."""
    from inkfathom.functions.scalars import max_sim

    v = lambda end, name: vectors.select(F.col("doc").alias(end), F.col("m").alias(name))
    j = edges.join(v("src", "a"), "src", "left").join(v("dst", "b"), "dst", "left")
    score = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.round(max_sim(F.col("a"), F.col("b")), 6))
    return j.select("src", "dst", score.alias("score")).withColumn("kept", F.coalesce(F.col("score") >= threshold, F.lit(True)))
