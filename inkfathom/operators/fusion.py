"""Fusion of rankings, boosts and de-duplication.

A ranking table has query_id, field, id and score. Ranks are places
(``row_number``): score first, then id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weight_of(weights: dict[str, float], field: str = "field", default: float = 1.0) -> Column:
    if not weights:
        return F.lit(default)
    table = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))
    return F.coalesce(table[F.col(field)], F.lit(default))


def ranked(rankings: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id", "field").orderBy(F.desc("score"), "id")
    return rankings.withColumn("rank", F.row_number().over(w).cast("bigint"))


def weighted_max(rankings: DataFrame, weights: dict[str, float]) -> DataFrame:
    """query_id, id, fused: sum of w * score / largest score of the field."""
    top = F.max("score").over(Window.partitionBy("query_id", "field"))
    w = weight_of(weights, default=0.0)
    part = F.when(top > 0, w * F.col("score") / top).otherwise(0.0)
    parts = rankings.select("query_id", "id", part.alias("part"), w.alias("w")).where("w > 0")
    return parts.groupBy("query_id", "id").agg(F.sum("part").alias("fused"))


def rrf(rankings: DataFrame, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """query_id, id, fused: sum of w / (k + rank)."""
    part = weight_of(weights or {}) / (k + F.col("rank"))
    return ranked(rankings).groupBy("query_id", "id").agg(F.sum(part).alias("fused"))


def rrf_parts(rankings: DataFrame, weights: dict[str, float] | None = None, k: int = 60) -> DataFrame:
    """query_id, id, field, rank, weight, contribution: what each field adds."""
    w = weight_of(weights or {})
    return ranked(rankings).select(
        "query_id", "id", "field", "rank", w.alias("weight"), F.round(w / (k + F.col("rank")), 6).alias("contribution")
    )


def rrf_two(left: DataFrame, right: DataFrame, k: int = 60) -> DataFrame:
    """Two rankings (query_id, id, score): fused, and the place and score in each."""
    a = ranked(left.withColumn("field", F.lit("l"))).select(
        "query_id", "id", F.col("score").alias("left_score"), F.col("rank").alias("left_rank")
    )
    b = ranked(right.withColumn("field", F.lit("r"))).select(
        "query_id", "id", F.col("score").alias("right_score"), F.col("rank").alias("right_rank")
    )
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return a.join(b, ["query_id", "id"], "full_outer").withColumn("fused", part("left_rank") + part("right_rank"))


def distribution_fusion(rankings: DataFrame) -> DataFrame:
    """query_id, id, fused: the sum over fields of scores placed between three standard
    deviations below and above the mean of their list; 0.5 where all of a list are alike.

    ``rankings``: query_id, field, id, score, cut to the lists that are fused."""
    spread = rankings.groupBy("query_id", "field").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("dev"))
    placed = rankings.join(spread, ["query_id", "field"])
    part = F.when(F.col("dev") > 1e-12, (F.col("score") - F.col("mean") + 3 * F.col("dev")) / (6 * F.col("dev"))).otherwise(0.5)
    return placed.groupBy("query_id", "id").agg(F.sum(part).alias("fused"))


def min_max(score: Column, group: list[str]) -> Column:
    """Scaled to 0..1 in the group; 1 where all are equal. Null and 0 take no part and give 0."""
    used = F.when(score != 0, score)
    w = Window.partitionBy(*group)
    low, high = F.min(used).over(w), F.max(used).over(w)
    return F.when(used.isNull(), 0.0).when(high == low, 1.0).otherwise((used - low) / (high - low))


def alpha_fusion(left: DataFrame, right: DataFrame, alpha: float = 0.6) -> DataFrame:
    """query_id, id, fused = alpha * left + (1 - alpha) * right, each min-max scaled."""
    a = left.select("query_id", "id", F.col("score").alias("left_score"))
    b = right.select("query_id", "id", F.col("score").alias("right_score"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    l, r = (min_max(F.col(c), ["query_id"]) for c in ("left_score", "right_score"))
    return both.select("query_id", "id", l.alias("l"), r.alias("r")).select(
        "query_id", "id", (alpha * F.col("l") + (1 - alpha) * F.col("r")).alias("fused")
    )


def best_of_group(hits: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """Chunk hits to documents: the largest score of each group."""
    return hits.groupBy(*group).agg(F.max(score).alias(score), F.count("*").alias("hits"))


def dedup_best(rows: DataFrame, vector_weight: float, graph_weight: float) -> DataFrame:
    """One row for each query_id, id. The one with a rerank score, then of largest
    fused, wins; vector and graph take their maxima; where an id came more than
    once, fused is weighted anew from them."""
    key = F.struct(F.col("rerank").isNotNull().cast("int"), F.coalesce("fused", "vector", F.lit(0.0)), F.col("source"))
    g = rows.groupBy("query_id", "id").agg(
        F.max_by("source", key).alias("source"),
        F.max_by("fused", key).alias("own"),
        F.max("vector").alias("vector"),
        F.max("graph").alias("graph"),
        F.max("rerank").alias("rerank"),
        F.count("*").alias("n"),
    )
    again = vector_weight * F.coalesce("vector", F.lit(0.0)) + graph_weight * F.coalesce("graph", F.lit(0.0))
    return g.withColumn("fused", F.when(F.col("n") > 1, again).otherwise(F.col("own"))).drop("own")


def dedup_merged(rows: DataFrame, vector_weight: float = 0.7, graph_weight: float = 0.3) -> DataFrame:
    """As ``dedup_best``, for rows whose every score may be missing: without a
    fused score the vector's tells who wins; bm25 is merged too, and what no copy
    of a row that came more than once has is 0."""
    key = F.struct(F.col("rerank").isNotNull().cast("int"), F.coalesce("fused", "vector", F.lit(0.0)), F.col("source"))
    best = {c: F.max(c).alias(c) for c in ("vector", "graph", "bm25", "rerank")}
    g = rows.groupBy("query_id", "id").agg(F.max_by("source", key).alias("source"), F.max_by("fused", key).alias("own"), *best.values(), F.count("*").alias("n"))
    for c in ("vector", "graph", "bm25"):
        g = g.withColumn(c, F.when(F.col("n") > 1, F.coalesce(c, F.lit(0.0))).otherwise(F.col(c)))
    again = vector_weight * F.col("vector") + graph_weight * F.col("graph")
    return g.withColumn("fused", F.when(F.col("n") > 1, again).otherwise(F.col("own"))).drop("own")


def dedup_first(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def entity_boost(score: Column, terms: Column, entities: Column, step: float = 0.1, most: float = 0.5) -> Column:
    n = F.size(F.array_intersect(F.transform(terms, F.lower), F.transform(entities, F.lower)))
    return score * (1 + F.least(F.lit(most), step * n))


#: Fixed values by query type: multipliers for code, for tables, for paths deeper than the last number.
STRUCTURAL = {
    "cli": (1.20, 1.0, 0.95, 2),
    "config": (1.15, 1.10, 0.95, 2),
    "reference": (1.05, 1.20, 0.90, 1),
    "procedural": (1.10, 1.0, 1.0, 99),
    "conceptual": (1.0, 1.0, 0.85, 2),
    "troubleshooting": (1.15, 1.05, 0.95, 3),
}

#: Rank fusion weights by query type and field.
FIELD_WEIGHTS = {
    "conceptual": {"content": 2.5, "title": 1.0, "text-sparse": 0.3, "doc_title-sparse": 0.8, "title-sparse": 0.8, "entity-sparse": 0.6},
    "cli": {"content": 1.5, "title": 1.5, "text-sparse": 0.8, "doc_title-sparse": 0.8, "title-sparse": 1.0, "entity-sparse": 1.8},
    "config": {"content": 1.8, "title": 1.2, "text-sparse": 0.7, "doc_title-sparse": 0.8, "title-sparse": 1.0, "entity-sparse": 1.5},
    "procedural": {"content": 2.0, "title": 1.2, "text-sparse": 0.5, "doc_title-sparse": 0.8, "title-sparse": 1.0, "entity-sparse": 0.8},
    "troubleshooting": {"content": 2.0, "title": 1.0, "text-sparse": 0.6, "doc_title-sparse": 0.8, "title-sparse": 0.8, "entity-sparse": 1.5},
    "reference": {"content": 1.8, "title": 1.5, "text-sparse": 0.6, "doc_title-sparse": 1.0, "title-sparse": 1.2, "entity-sparse": 1.0},
}

#: Edges walked from a query's results by its type, and at most how many neighbours.
RELATIONS = {
    "conceptual": ("MENTIONS", "DEFINES", "IN_SECTION", "REFERENCES"),
    "cli": ("MENTIONS", "CONTAINS_STEP", "HAS_PARAMETER"),
    "config": ("MENTIONS", "HAS_PARAMETER", "DEFINES", "REFERENCES"),
    "procedural": ("MENTIONS", "CONTAINS_STEP", "NEXT_CHUNK", "IN_SECTION", "REFERENCES"),
    "troubleshooting": ("MENTIONS", "RESOLVES", "NEXT_CHUNK", "REFERENCES"),
    "reference": ("MENTIONS", "NEXT_CHUNK", "REFERENCES"),
}
RELATION_CAPS = {"procedural": 10, "troubleshooting": 15, "reference": 5}


def relations_of(kind: Column, default: list[str], cap: int) -> tuple[Column, Column]:
    """The edge types of a query type (or the default ones) and the number of neighbours."""
    table = F.create_map(*(x for k, v in RELATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    caps = F.create_map(*(x for k, v in RELATION_CAPS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(table[kind], F.array(*map(F.lit, default))), F.least(F.coalesce(caps[kind], F.lit(cap)), F.lit(cap))


def field_weights(kind: Column, base: dict[str, float] | None = None) -> Column:
    """A map of the fields' weights: those of the query type (unknown: conceptual) over the base ones."""
    known = F.lower(F.trim(kind))
    one = lambda w: F.create_map(*(x for f, v in w.items() for x in (F.lit(f), F.lit(float(v)))))
    table = F.create_map(*(x for k, v in FIELD_WEIGHTS.items() for x in (F.lit(k), one((base or {}) | v))))
    return F.coalesce(table[known], one((base or {}) | FIELD_WEIGHTS["conceptual"]))


def structural_boost(score: Column, kind: Column, has_code: Column, has_table: Column, depth: Column) -> Column:
    """Multiplied by query type for code and tables, less for deep paths; unknown types count as conceptual."""
    known = F.lower(F.trim(kind))

    def by(place: int) -> Column:
        return reduce(
            lambda rest, t: F.when(known == t, F.lit(float(STRUCTURAL[t][place]))).otherwise(rest),
            STRUCTURAL,
            F.lit(float(STRUCTURAL["conceptual"][place])),
        )

    code = F.when(has_code, by(0)).otherwise(1.0)
    table = F.when(has_table, by(1)).otherwise(1.0)
    deep = F.when(depth > by(3), by(2)).otherwise(1.0)
    return score * code * table * deep


def focus_bias(score: Column, hits: Column, step: float = 0.2) -> Column:
    return score * (1 + step * F.coalesce(hits, F.lit(0)))


def continuity_boost(rows: DataFrame, alpha: float = 0.12) -> DataFrame:
    """fused * (1 + alpha * share of the document among the query's rows), at most 1."""
    share = F.count("*").over(Window.partitionBy("query_id", "document_id")) / F.count("*").over(
        Window.partitionBy("query_id")
    )
    return rows.withColumn("fused", F.least(F.lit(1.0), F.col("fused") * (1 + alpha * share)))


def saturating(n: Column, scale: float) -> Column:
    """1 - e^(-n / scale)"""
    return 1 - F.exp(-n / scale)


def entity_signal(candidates: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, id, matched, signal: distinct entities of the query that a candidate mentions."""
    wanted = entities.select("query_id", F.col("entity").alias("dst"))
    hit = candidates.join(mentions.select(F.col("src").alias("id"), "dst"), "id").join(wanted, ["query_id", "dst"])
    return hit.groupBy("query_id", "id").agg(F.count_distinct("dst").alias("matched")).withColumn(
        "signal", saturating(F.col("matched"), 3.0)
    )


def cross_doc_signal(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """query_id, id, refs, signal: references to a candidate's document from other candidates' documents."""
    docs = candidates.select("query_id", "document_id").distinct()
    named = (
        docs.withColumnRenamed("document_id", "src").join(references.select("src", "dst"), "src").where("src <> dst")
    )
    refs = named.groupBy("query_id", F.col("dst").alias("document_id")).agg(F.count_distinct("src").alias("refs"))
    return candidates.join(refs, ["query_id", "document_id"]).select(
        "query_id", "id", "refs", saturating(F.col("refs"), 2.0).alias("signal")
    )


def graph_rerank(vector: Column, entity: Column, cross: Column, wv: float = 0.6, wg: float = 0.4, ratio: float = 0.3) -> Column:
    zero = F.lit(0.0)
    return (
        wv * F.coalesce(vector, zero)
        + (1 - ratio) * wg * F.coalesce(entity, zero)
        + ratio * wg * F.coalesce(cross, zero)
    )


def normalise(score: Column, group: list[str], how: str = "minmax") -> Column:
    if how == "sigmoid":
        return 1 / (1 + F.exp(-score))
    if how == "percentile":  # equal values take the last place
        w = Window.partitionBy(*group)
        n = F.count("*").over(w)
        last = F.count("*").over(w.orderBy(score).rangeBetween(Window.unboundedPreceding, 0))
        return F.when(n > 1, (last - 1) / (n - 1)).otherwise(1.0)
    return min_max(score, group)


def expansion_score(lexical: Column, structural: Column, distance: Column) -> Column:
    return 0.4 * lexical + 0.5 * structural + 0.1 / (distance + 1)


def gate(rows: DataFrame, passes: Column, group: list[str]) -> DataFrame:
    """Rows that pass; where none of a group does, all of it."""
    n = F.count_if(passes).over(Window.partitionBy(*group))
    return rows.withColumn("__n", n).where(passes | (F.col("__n") == 0)).drop("__n")


def neighbour_score(score: Column) -> Column:
    """Below the source's own score, never negative."""
    return F.greatest(F.lit(0.0), F.least(score / 2, score - 1e-4))


def primary_document(rows: DataFrame, share: float = 0.5) -> DataFrame:
    """Rows of a document that has more than ``share`` of a query's rows, else all of the query's."""
    own = F.count("*").over(Window.partitionBy("query_id", "document_id"))
    part = own / F.count("*").over(Window.partitionBy("query_id"))
    return gate(rows.withColumn("share", part), F.col("share") > share, ["query_id"])
