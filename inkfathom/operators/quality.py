"""Contracts, drift, metrics and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts of about equal size that ``percentile_by`` cuts each group into.
PARTS = 128


def percentile_by(rows: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """group, value: the exact percentile of each group, between two places in proportion.

    No task sorts a group: approximate percentiles cut it into parts, the parts are
    counted, and only the distinct values of the parts that hold the two places are
    ranked. What the cuts are changes nothing but the parts' sizes. Null values do
    not count; a null group is one; a group without values has no row.
    """
    own = rows.where(F.col(value).isNotNull()).select(F.struct(F.col(group).alias("g")).alias("k"), F.col(value).alias("v"))
    cuts = own.groupBy("k").agg(F.percentile_approx("v", [i / PARTS for i in range(1, PARTS)]).alias("cuts"))
    counts = own.groupBy("k", "v").agg(F.count("*").alias("n")).join(cuts, "k")
    parts = counts.select("k", "v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("part"))
    whole = Window.partitionBy("k")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parts.groupBy("k", "part").agg(F.sum("n").alias("n")).withColumn("before", before)
    sizes = sizes.withColumn("place", F.lit(p) * (F.sum("n").over(whole) - 1))
    low, high = F.floor("place"), F.ceil("place")
    held = sizes.where((F.col("before") <= high) & (F.col("before") + F.col("n") > low)).select("k", "part", "before", "place")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("k", "part").orderBy("v"))
    ranked = parts.join(held, ["k", "part"]).withColumn("upto", upto)
    found = ranked.groupBy("k", "place").agg(F.min(F.when(F.col("upto") > low, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > high, F.col("v"))).alias("b"))
    return found.select(F.col("k.g").alias(group), (F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - low)).alias(value))


def memberships(chunks: DataFrame, members: DataFrame) -> DataFrame:
    """Chunks that are not in exactly one document. ``members``: chunk_id, document_id."""
    n = members.groupBy("chunk_id").agg(F.count_distinct("document_id").alias("documents"))
    joined = chunks.select("chunk_id").join(n, "chunk_id", "left")
    return joined.withColumn("documents", F.coalesce("documents", F.lit(0))).where("documents <> 1")


def branching(edges: DataFrame) -> DataFrame:
    """Nodes with more than one out-edge."""
    return edges.groupBy("src").agg(F.count("*").alias("out")).where("out > 1")


def cycles(edges: DataFrame, hops: int = 50) -> DataFrame:
    """Nodes on a cycle of at most ``hops`` (rounded up to a power of two) edges
    of a table with one out-edge a node, by doubling jumps: a power of two needs
    one join for each factor of two."""
    jump = edges.select("src", "dst")
    seen = jump.where("src = dst").select("src")
    reach = jump
    d = 1
    while d < hops:
        step = reach.join(jump.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst"))
        reach = reach.unionByName(step).distinct()
        jump = jump.join(jump.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst"))
        d *= 2
    return seen.union(reach.where("src = dst").select("src")).distinct()


def drift(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: rows in both, only left, only right, drift in per cent of the larger."""
    a = left.select(key).distinct().withColumn("l", F.lit(1))
    b = right.select(key).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full_outer")
    counted = both.agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"),
        F.count_if(F.col("r").isNull()).alias("only_left"),
        F.count_if(F.col("l").isNull()).alias("only_right"),
    )
    most = F.col("shared") + F.greatest("only_left", "only_right")
    off = F.when(most > 0, 100.0 * (F.col("only_left") + F.col("only_right")) / most).otherwise(0.0)
    return counted.withColumn("drift_pct", F.round(off, 6))


def section_diff(old: DataFrame, new: DataFrame, key: str, checksum: str) -> DataFrame:
    """key and change: added, removed, modified or unchanged, by checksum."""
    a = old.select(key, F.col(checksum).alias("__old"))
    b = new.select(key, F.col(checksum).alias("__new"))
    change = (
        F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed")
        .when(F.col("__old") == F.col("__new"), "unchanged").otherwise("modified")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def slo_status(value: Column, target: Column, kind: str, page_factor: float = 2.0) -> Column:
    """OK, ALERT or PAGE for a value that must not exceed its target (``max``),
    lie at or above it (``min``), or be zero (``zero``)."""
    if kind == "zero":
        return F.when(value == 0, "OK").otherwise("PAGE")
    if kind == "min":
        return F.when(value >= target, "OK").when(value >= target / page_factor, "ALERT").otherwise("PAGE")
    return F.when(value <= target, "OK").when(value <= target * page_factor, "ALERT").otherwise("PAGE")


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, depths: tuple[int, ...] = (1, 3, 5, 10), cut: int = 10) -> DataFrame:
    """query_id with reciprocal rank, average precision, NDCG, recall and hits at depths.

    ``ranked``: query_id, id, rank; ``relevant``: query_id, id, gain. Hits at k
    are found relevant rows over the smaller of k and the relevant ones.
    """
    rel = relevant.where("gain > 0")
    n = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    place = Window.partitionBy("query_id").orderBy(F.desc("gain"), "id")
    ideal = (
        rel.withColumn("r", F.row_number().over(place)).where(F.col("r") <= cut)
        .groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("r") + 1)).alias("ideal"))
    )
    hit = ranked.where(F.col("rank") <= cut).join(rel, ["query_id", "id"])
    so_far = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    hit = hit.withColumn("found", so_far)
    got = hit.groupBy("query_id").agg(
        F.max(1.0 / F.col("rank")).alias("rr"),
        F.sum(F.col("found") / F.col("rank")).alias("precisions"),
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.count("*").alias("hits"),
        *(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in depths),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return n.join(ideal, "query_id").join(got, "query_id", "left").select(
        "query_id",
        F.round(zero("rr"), 6).alias("mrr"),
        F.round(zero("precisions") / F.least("n_rel", F.lit(cut)), 6).alias("map"),
        F.round(zero("dcg") / F.col("ideal"), 6).alias("ndcg"),
        F.round(zero("hits") / F.col("n_rel"), 6).alias("recall"),
        *(F.round(zero(f"h{k}") / F.least("n_rel", F.lit(k)), 6).alias(f"hits_at_{k}") for k in depths),
    )
