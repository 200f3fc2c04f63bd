"""Links between documents, kept as documents arrive.

Of each document and kind of score (dense, sparse, title) a bounded list of its best
partners is kept: ``LIST`` rows. A pair's score never changes, so the best of a union are
the best of the two sides' best: when documents arrive, those there before get a list of
their best among the new ones, the new ones a list among all, and each is cut to its
best again. A new partner thus displaces the last of an old list. Links are made of the
lists: the best five above a threshold by dense score, by the fusion of the dense and
the sparse ranks, or by title. What comes of documents that arrive bit by bit is what
comes of all at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkfathom.operators import search, subsets

#: Partners kept of each kind, least score to be one, links of a document, least score of a link, constant of the fusion.
LIST, DISCOVERY, LINKS, RANK_CONSTANT = 100, {"dense": 0.5, "sparse": 0.0, "title": 0.0}, 5, 60
THRESHOLDS = {"dense": 0.70, "fused": 0.025, "title": 2.0}

_LISTS = ["src", "kind", "dst", "score"]


def dense_lists(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Lists of ``sources`` among ``targets`` (both id, vector) by cosine."""
    own = lambda df, name: df.select(F.col("id").alias(name), "vector", F.col("id").alias("grp"))
    found = search.knn_near(own(targets, "id"), own(sources, "query_id"), LIST, DISCOVERY["dense"], unlike=True)
    return found.select(F.col("query_id").alias("src"), F.lit("dense").alias("kind"), F.col("id").alias("dst"), "score")


def sparse_lists(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Lists by products of sparse vectors (both id, term, weight). Weights are a document's own: none depends on the others."""
    named = targets.withColumn("grp", F.col("id"))
    asked = sources.select(F.col("id").alias("query_id"), "term", "weight", F.col("id").alias("grp"))
    found = subsets.best_sparse(named, asked, LIST, slack=1e-5, alone=True).withColumn("score", F.round("score", 6))
    best = search.top_k(found, "query_id", [F.desc("score"), "id"], LIST)
    return best.select(F.col("query_id").alias("src"), F.lit("sparse").alias("kind"), F.col("id").alias("dst"), "score")


def cut(lists: DataFrame) -> DataFrame:
    """The best of each list; a pair that came twice counts once."""
    once = lists.groupBy("src", "kind", "dst").agg(F.max("score").alias("score"))
    return search.top_k(once, ["src", "kind"], [F.desc("score"), "dst"], LIST).select(*_LISTS)


def arrived(lists: DataFrame, old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """The lists after documents have come. ``old`` and ``new``: vectors by kind (dense, sparse)."""
    made = {"dense": dense_lists, "sparse": sparse_lists}
    parts = [lists.select(*_LISTS)]
    for kind, vectors in new.items():
        parts.append(made[kind](old[kind].unionByName(vectors), vectors))
        parts.append(made[kind](vectors, old[kind]))
    return cut(reduce(DataFrame.unionByName, parts))


def linked(lists: DataFrame, method: str = "fused") -> DataFrame:
    """src, dst, score, rank: at most five links of each document."""
    if method == "fused":
        place = F.row_number().over(Window.partitionBy("src", "kind").orderBy(F.desc("score"), "dst"))
        ranked = lists.where(F.col("kind").isin("dense", "sparse")).withColumn("place", place)
        scored = ranked.groupBy("src", "dst").agg(F.sum(1.0 / (RANK_CONSTANT + F.col("place"))).alias("score"))
    else:
        scored = lists.where(F.col("kind") == method).select("src", "dst", "score")
    fine = scored.where(F.col("score") >= THRESHOLDS[method])
    return search.top_k(fine, "src", [F.desc("score"), "dst"], LINKS)
