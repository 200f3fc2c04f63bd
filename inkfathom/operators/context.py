"""Budgets, assembly of context, citations."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget_prefix(rows: DataFrame, group: str, order: list, tokens: str, budget: int) -> DataFrame:
    """The rows of each group before the first that exceeds the budget; ``used`` is the running sum."""
    w = Window.partitionBy(group).orderBy(*order)
    place = F.row_number().over(w)
    r = rows.withColumn("used", F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__place", place)
    stop = F.min(F.when(F.col("used") > budget, F.col("__place"))).over(Window.partitionBy(group))
    return r.withColumn("__stop", stop).where("__stop is null or __place < __stop").drop("__stop", "__place")


def phase_budget(rows: DataFrame, group: str, order: str, phase: str, tokens: str, size: str, most: int, most_bytes: int, shares: dict) -> DataFrame:
    """Rows of each group before the first that exceeds the whole budget of tokens
    or bytes or its phase's share of one; phase_tokens and phase_bytes are running sums."""
    so_far = lambda *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cap = lambda total: F.create_map(*(x for k, v in shares.items() for x in (F.lit(k), F.lit(int(total * v)))))[F.col(phase)]
    r = rows.withColumn("phase_tokens", F.sum(tokens).over(so_far(group, phase))).withColumn("phase_bytes", F.sum(size).over(so_far(group, phase)))
    over = (F.sum(tokens).over(so_far(group)) > most) | (F.sum(size).over(so_far(group)) > most_bytes)
    r = r.withColumn("__over", over | (F.col("phase_tokens") > cap(most)) | (F.col("phase_bytes") > cap(most_bytes)))
    stop = F.min(F.when(F.col("__over"), F.col(order))).over(Window.partitionBy(group))
    return r.withColumn("__stop", stop).where(F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))).drop("__stop", "__over")


def capped(rows: DataFrame, group: str | list[str], order: list, cap: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= cap).drop("__n")


def joined_text(rows: DataFrame, group: str, order: list[str], text: str, sep: str = "\n\n") -> DataFrame:
    """group and context: its texts in order."""
    parts = F.sort_array(F.collect_list(F.struct(*order, text)))
    return rows.groupBy(group).agg(F.array_join(F.transform(parts, lambda p: p[text]), sep).alias("context"))


def truncated_words(text: Column, n: int) -> Column:
    words = F.split(text, " ")
    return F.when(F.size(words) > n, F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit("..."))).otherwise(text)


def snippet(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def ordered_labels(labels: Column) -> Column:
    """Citation labels struct(order, title, level): order 0 out, first of each
    title whatever its case, by order, level, title."""
    kept = F.filter(labels, lambda x: (x["order"] > 0) & x["title"].isNotNull())
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct(x["order"].alias("order"), x["level"].alias("level"), F.lower(x["title"]).alias("key"), x["title"].alias("title"))))
    return F.aggregate(
        ordered,
        F.array().cast("array<struct<order:int,level:int,key:string,title:string>>"),
        lambda seen, x: F.when(F.exists(seen, lambda s: s["key"] == x["key"]), seen).otherwise(F.concat(seen, F.array(x))),
    )


#: Of a stitching: documents a seed, candidates a tier, tokens of a small
#: document, of one taken, of all taken for a query.
PER_SEED, TIER, SMALL, EACH, ALL = 2, 5, 2000, 300, 1200


def micro_documents(docs: DataFrame) -> DataFrame:
    """document_id, directory, total, and the first ``EACH`` words as text and their number as tokens (docs: document_id, directory, text)."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    d = docs.select("document_id", "directory", words.alias("w"))
    cut = F.array_join(F.slice("w", 1, EACH), " ")
    return d.select("document_id", "directory", F.size("w").alias("total"), cut.alias("text"), F.least(F.size("w"), F.lit(EACH)).alias("tokens"))


def stitch_microdocs(results: DataFrame, micro: DataFrame, near: DataFrame, seeds: int, base: int = 600) -> DataFrame:
    """query_id, n, seed, document_id, tier, tokens, text: small documents taken for each query's first ``seeds`` results.

    ``results``: query_id, document_id, rank; ``micro``: as ``micro_documents``
    gives it; ``near``: document_id (a seed), id, rank, its at most ``TIER``
    neighbours. A seed of fewer than ``base`` tokens gets up to ``PER_SEED``
    documents of at most ``SMALL`` tokens from the query's other results, then
    from its directory, smallest first, then from its neighbours; none twice in
    a query, until the next would exceed ``ALL`` tokens. That depends on what
    was taken before, hence one pass over a query's own bounded candidates.
    """
    sizes = micro.select("document_id", "directory", "total")
    placed = results.join(sizes, "document_id")
    asked = placed.where(F.col("rank") <= seeds).select("query_id", F.col("document_id").alias("seed"), F.col("rank").alias("place"), "directory", "total")
    fused = placed.where((F.col("rank") > seeds) & (F.col("total") <= SMALL)).select(
        "query_id", F.lit(0).cast("bigint").alias("seed"), F.lit(0).cast("bigint").alias("place"), F.lit(0).alias("tier"), F.col("rank").cast("bigint").alias("rank"), "document_id"
    )
    w = Window.partitionBy("directory").orderBy("total", "document_id")
    least = sizes.where(F.col("total") <= SMALL).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TIER + 1)
    beside = asked.drop("total").join(least.drop("total"), "directory").where("document_id <> seed")
    # a seed among the first leaves its place to the next
    beside = capped(beside, ["query_id", "seed"], ["rank"], TIER)
    close = asked.join(near.withColumnRenamed("document_id", "seed"), "seed").withColumnRenamed("id", "document_id")
    close = close.where(F.col("rank") <= TIER).join(sizes.where(F.col("total") <= SMALL).select("document_id"), "document_id")
    shape = lambda d, tier: d.select("query_id", "seed", F.col("place").cast("bigint").alias("place"), F.lit(tier).alias("tier"), F.col("rank").cast("bigint").alias("rank"), "document_id")
    own = asked.select("query_id", "seed", F.col("place").cast("bigint").alias("place"), F.lit(-1).alias("tier"), F.col("total").cast("bigint").alias("rank"), F.col("seed").alias("document_id"))
    every = own.unionByName(fused).unionByName(shape(beside, 1)).unionByName(shape(close, 2))
    kept = micro.select("document_id", "tokens", "text")
    types = {f.name: f.dataType.simpleString() for f in every.schema}
    out = f"query_id {types['query_id']}, n int, seed bigint, document_id bigint, tier int, tokens int"

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_taken(rows, base), columns=["query_id", "n", "seed", "document_id", "tier", "tokens"])

    chosen = every.join(kept.drop("text"), "document_id").groupBy("query_id").applyInPandas(take, out)
    return chosen.join(kept.drop("tokens"), "document_id").select("query_id", "n", "seed", "document_id", "tier", "tokens", "text")


def _taken(rows: pd.DataFrame, base: int) -> Iterable[tuple]:
    rows = rows.sort_values(["tier", "place", "rank", "document_id"])
    own = rows[rows["tier"] == -1]
    used, spent, out = set(own["document_id"]), 0, []
    pool = [(0, r.document_id, r.tokens) for r in rows[rows["tier"] == 0].itertuples()]
    tiers: dict = {}
    for r in rows[rows["tier"] > 0].itertuples():
        tiers.setdefault((r.seed, r.tier), []).append((r.tier, r.document_id, r.tokens))
    for s in own.itertuples():
        if s.rank >= base:
            continue
        cohort: list = []
        for tier in (pool, tiers.get((s.seed, 1), []), tiers.get((s.seed, 2), [])):
            cohort += [c for c in tier if c[1] not in used][: PER_SEED - len(cohort)]
        for tier, document, tokens in cohort:
            if document in used or tokens == 0:
                continue
            if spent + tokens > ALL:
                return out
            out.append((s.query_id, len(out) + 1, s.seed, document, tier, tokens))
            used.add(document)
            spent += tokens
    return out
