"""From ranked rows to an answer: reranking, citations, budgets, responses, paging."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfathom.operators.search import bm25_by, top_k

#: How much a hit in a citation unit counts beside one in its chunk.
CITED = 1.25


def bm25_cited(chunks: DataFrame, units: DataFrame, queries: DataFrame, kept: Column | None = None, k: int = 10) -> DataFrame:
    """query_id, chunk_id, score, labels, rank: BM25 over chunks and citation units as one corpus.

    ``chunks``: chunk_id, text and what ``kept`` reads; ``units``: chunk_id (whose
    they are), ord, heading, text and what ``kept`` reads. A chunk with a unit that is hit has its
    best unit's score times CITED, else its own; more hit labels come first. All is counted
    in the corpus, only what is kept is scored, and a chunk's units where the chunk is.
    """
    is_kept = F.lit(True) if kept is None else F.coalesce(kept, F.lit(False))
    own = chunks.select("chunk_id", F.lit(-1).alias("ord"), F.lit("").alias("heading"), "text", is_kept.alias("kept"))
    cited = units.select("chunk_id", F.col("ord").cast("int").alias("ord"), "heading", "text", is_kept.alias("kept"))
    hits = bm25_by(own.unionByName(cited), ["chunk_id", "ord", "heading"], queries, F.col("kept"))
    unit = F.col("ord") >= 0
    best = hits.groupBy("query_id", "chunk_id").agg(
        F.max(F.when(unit, F.col("score"))).alias("cited"), F.max(F.when(~unit, F.col("score"))).alias("own"), F.count_if(unit).alias("labels")
    )
    score = F.when(F.col("cited") > 0, F.col("cited") * CITED).otherwise(F.coalesce("own", F.lit(0.0)))
    rows = best.select("query_id", "chunk_id", "labels", F.round(score, 6).alias("score"))
    return top_k(rows, "query_id", [F.desc("labels"), F.desc("score"), "chunk_id"], k)


#: Left-over mark-up, and what takes its place.
CLEAN_UP = (
    (r"<[^>]+>", " "), (r"\[/?CODE\]", " "), (r"\b[A-Z]{1,4}\]\s*", " "), ("####", " "), (r"DE\]", " "), (r"^[^A-Za-z0-9]+", ""), (r"\s+", " "),
)


def reranker_text(text: Column) -> Column:
    """Without tags and left-over mark-up, white space as single blanks."""
    for pattern, by in CLEAN_UP:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


#: What a scorer is given at once.
BATCH_DOCS, BATCH_WORDS = 32, 1024
Scorer = Callable[[str, Sequence[str]], Sequence[float | None]]


def overlap(query: str, texts: Sequence[str]) -> list[float]:
    """Share of a query's distinct words that a text has: a scorer without a model."""
    asked = set(query.lower().split())
    return [len(asked & set(t.lower().split())) / len(asked) if asked else 0.0 for t in texts]


def batches(texts: Sequence[str], docs: int = BATCH_DOCS, words: int = BATCH_WORDS) -> list[list[int]]:
    """Places of the texts in batches of at most ``docs`` texts and ``words`` words; a longer text goes alone."""
    out: list[list[int]] = []
    size = 0
    for i, t in enumerate(texts):
        n = max(1, len(t.split()))
        if not out or len(out[-1]) + 1 > docs or size + n > words:
            out.append([])
            size = 0
        out[-1].append(i)
        size += n
    return out


def rerank(candidates: DataFrame, scorer: Scorer = overlap, top_n: int | None = None) -> DataFrame:
    """query_id, id, score, rerank, rank: candidates in the scorer's order.

    ``candidates``: query_id, query, id, text (cleaned), score. They are scored a
    query at a time, in batches; empty texts are left out. Where the scorer fails
    the given order stays and rerank is null. A query's candidates are a bounded list.
    """
    types = {f.name: f.dataType.simpleString() for f in candidates.schema}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["text"].fillna("") != ""].sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        rows["rerank"] = None
        if len(rows):
            texts, found = rows["text"].tolist(), [None] * len(rows)
            try:
                for part in batches(texts):
                    for i, s in zip(part, scorer(rows["query"][0], [texts[i] for i in part])):
                        found[i] = s
            except Exception:  # noqa: BLE001 - a scorer is foreign code; its failure keeps the order
                found = [None] * len(rows)
            rows["rerank"] = found
        rows["rerank"] = rows["rerank"].astype(float)
        rows = rows.sort_values(["rerank", "score", "id"], ascending=[False, False, True], na_position="last", ignore_index=True)
        rows["rank"] = range(1, len(rows) + 1)
        return rows[["query_id", "id", "score", "rerank", "rank"]][:top_n]

    out = f"query_id {types['query_id']}, id {types['id']}, score double, rerank double, rank bigint"
    return candidates.select("query_id", "query", "id", "text", F.col("score").cast("double").alias("score")).groupBy("query_id").applyInPandas(run, out)


def rerank_nothing(candidates: DataFrame, k: int = 10) -> DataFrame:
    """The given order with each row's own score, or 1 less a hundredth for each place."""
    w = Window.partitionBy("query_id").orderBy("place")
    n = F.row_number().over(w)
    kept = candidates.withColumn("original_rank", n.cast("bigint")).where(F.col("original_rank") <= k)
    return kept.withColumn("rerank", F.coalesce("score", 1.0 - (F.col("original_rank") - 1) * 0.01))


LABELS = "array<struct<ord:int,title:string,level:int>>"


def parsed_boundaries(json: Column) -> Column:
    """Labels of a JSON list of sections, or of an object that has them as ``sections``; others give none."""
    kind = "array<struct<order:string,heading:string,title:string,level:string>>"
    listed = F.from_json(json, kind)
    inside = F.from_json(json, f"struct<sections:{kind}>")["sections"]
    sections = F.coalesce(F.when(F.ltrim(json).startswith("["), listed), inside, F.array().cast(kind))
    label = lambda s: F.struct(
        F.coalesce(s["order"].try_cast("int"), F.lit(0)).alias("ord"),
        F.trim(F.coalesce(F.nullif(s["heading"], F.lit("")), s["title"], F.lit(""))).alias("title"),
        F.coalesce(s["level"].try_cast("int"), F.lit(0)).alias("level"),
    )
    return F.filter(F.transform(sections, label), lambda x: x["title"] != "").cast(LABELS)


def citation_order(labels: Column, heading: Column) -> Column:
    """Labels as they are rendered: each place and title once whatever its case;
    of several those of place 0 go (where all are at 0, those named as the chunk);
    by place, level, steps first, title."""
    trimmed = F.filter(
        F.transform(labels, lambda x: F.struct(F.coalesce(x["ord"], F.lit(0)).alias("ord"), F.trim(F.coalesce(x["title"], F.lit(""))).alias("title"), F.coalesce(x["level"], F.lit(0)).alias("level"))),
        lambda x: x["title"] != "",
    ).cast(LABELS)
    same = lambda a, b: (a["ord"] == b["ord"]) & (F.lower(a["title"]) == F.lower(b["title"]))
    once = F.aggregate(
        trimmed, F.array().cast(LABELS), lambda seen, x: F.when(F.exists(seen, lambda s: same(s, x)), seen).otherwise(F.concat(seen, F.array(x)))
    )
    below = F.filter(once, lambda x: x["ord"] != 0)
    own = F.lower(F.trim(F.coalesce(heading, F.lit(""))))
    others = F.filter(once, lambda x: (own == "") | (F.lower(x["title"]) != own))
    kept = F.when(F.size(once) <= 1, once).when(F.size(below) > 0, below).when(F.size(others) > 0, others).otherwise(once)
    keyed = F.transform(
        kept,
        lambda x: F.struct(
            x["ord"].alias("ord"), x["level"].alias("level"), F.when(x["title"].rlike(r"(?i)^\s*step\s*\d+"), 0).otherwise(1).alias("step"),
            F.lower(x["title"]).alias("key"), x["title"].alias("title"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda x: x["title"])


def numbered_citations(chunks: DataFrame, group: str, order: list[str]) -> DataFrame:
    """group, citations: ``[n] title`` lines, numbered through the group's chunks.

    ``chunks``: titles (array), heading, extra (boolean). One without titles is
    cited by its heading, or as a section; an extra one as related.
    """
    own = F.coalesce(F.nullif(F.col("heading"), F.lit("")), F.lit("Section"))
    fallback = F.array(F.when(F.col("extra"), F.concat(F.lit("Related: "), own)).otherwise(own))
    rows = chunks.select(group, *order, F.posexplode(F.when(F.size("titles") > 0, F.col("titles")).otherwise(fallback)).alias("i", "title"))
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order, "i"))
    lines = rows.select(group, n.alias("n"), "title")
    listed = lines.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("n", "title"))).alias("l"))
    text = F.transform("l", lambda x: F.concat(F.lit("["), x["n"].cast("string"), F.lit("] "), x["title"]))
    return listed.select(group, F.array_join(text, "\n").alias("citations"))


def grouped_budget(rows: DataFrame, query: str, parent: str, rank: str, tokens: str, budget: int, cap: int) -> DataFrame:
    """Rows by parent, parents in order of their best row, at most ``cap`` of each,
    up to the first that would exceed the budget; ``used`` is the running sum."""
    within = Window.partitionBy(query, parent).orderBy(rank)
    placed = rows.withColumn("__n", F.row_number().over(within)).withColumn("__first", F.min(rank).over(Window.partitionBy(query, parent)))
    placed = placed.where(F.col("__n") <= cap)
    w = Window.partitionBy(query).orderBy("__first", rank)
    summed = placed.withColumn("used", F.sum(F.greatest(F.lit(0), F.col(tokens))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = F.max(F.when(F.col("used") > budget, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return summed.withColumn("__over", over).where("__over = 0").drop("__n", "__first", "__over")


def confidence(scores: Column, evidence: Column, paths: Column) -> Column:
    """Of an answer, from its best results' scores in order, the confidence of its
    evidence, and which results have a path (empty: not known)."""
    top = F.slice(scores, 1, 5)
    n = F.size(top)
    place = F.least(n - 1, F.greatest(F.lit(0), F.floor(n * 3 / 4).cast("int")))
    threshold = F.least(F.lit(0.85), F.greatest(F.lit(0.5), F.get(F.sort_array(top), place)))
    sure = F.size(F.filter(top, lambda s: s >= threshold))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    three = F.slice(evidence, 1, 3)
    strength = F.when(F.size(three) > 0, total(three) / F.size(three)).otherwise(0.0)
    linked = F.size(F.filter(paths, lambda p: p))
    coherence = F.when(linked > 0, linked / F.size(paths)).otherwise(0.5)
    found = 0.3 * F.get(top, F.lit(0)) + 0.2 * strength + 0.2 * F.least(F.lit(1.0), sure / 3.0) + 0.3 * coherence
    return F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), found))).otherwise(0.0)


def answer_text(intent: Column, results: Column, procedures: Column) -> Column:
    """Fixed wording by intent."""
    n = results.cast("string")
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return (
        F.when(results == 0, "No relevant information found.")
        .when(intent == "search", say("Found ", n, " relevant sections. Top ", F.least(F.lit(5), results).cast("string"), " results show information about this topic."))
        .when((intent == "troubleshoot") & (procedures > 0), say("Found ", procedures.cast("string"), " resolution procedures. Follow the steps in the linked sections."))
        .when(intent == "troubleshoot", "Found related documentation. Review the sections for troubleshooting guidance.")
        .when(intent == "compare", say("Comparison found ", n, " relevant nodes showing differences and similarities."))
        .when(intent == "explain", say("Explanation includes ", n, " related concepts and components."))
        .when(intent == "traverse", say("Traversal found ", n, " connected nodes across relationships."))
        .otherwise(say("Found ", n, " relevant results."))
    )


def cursor(offset: Column) -> Column:
    return F.base64(offset.cast("string").cast("binary"))


def offset_of(text: str | None) -> int:
    """What a cursor points at; 0 for none or one that says nothing."""
    import base64
    import binascii

    try:
        return int(base64.urlsafe_b64decode(text.encode())) if text else 0
    except (binascii.Error, ValueError):
        return 0


def page(rows: DataFrame, group: str, order: list, after: str | None, limit: int) -> DataFrame:
    """``limit`` rows of each group after the cursor, and next_cursor where more follow."""
    start = offset_of(after)
    w = Window.partitionBy(group).orderBy(*order)
    placed = rows.withColumn("__n", F.row_number().over(w)).withColumn("__all", F.count("*").over(Window.partitionBy(group)))
    more = F.when(F.col("__all") > start + limit, cursor(F.lit(start + limit)))
    return placed.where((F.col("__n") > start) & (F.col("__n") <= start + limit)).withColumn("next_cursor", more).drop("__n", "__all")


def over_fetch(k: Column, has_entities: Column) -> Column:
    """Candidates asked for, so that boosts can still bring rows up."""
    return F.least(k * 3 * F.when(has_entities, 2).otherwise(1), F.lit(200))


def expansion_trigger(tokens: Column, first: Column, second: Column, when: str, least: int = 12, close: float = 0.02) -> Column:
    """Why results are expanded: query_long, scores_close, forced; else disabled or none."""
    long = tokens >= least
    near = second.isNotNull() & (F.abs(F.coalesce(first, F.lit(0.0)) - F.coalesce(second, F.lit(0.0))) <= close)
    return {
        "never": F.lit("disabled"),
        "always": F.lit("forced"),
        "length": F.when(long, "query_long").otherwise("none"),
        "auto": F.when(long, "query_long").when(near, "scores_close").otherwise("none"),
    }[when]


def unseen(rows: DataFrame, session: str, item: str, ts: str, tie: str, ttl: int = 900) -> DataFrame:
    """Adds suppressed: what a session was given before. A pause longer than
    ``ttl`` seconds ends what it remembers."""
    w = Window.partitionBy(session).orderBy(ts, tie)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = at - F.lag(at).over(w)
    r = rows.withColumn("__part", F.sum(F.when(gap > ttl * 1_000_000, 1).otherwise(0)).over(w))
    n = F.row_number().over(Window.partitionBy(session, "__part", item).orderBy(ts, tie))
    return r.withColumn("suppressed", n > 1).drop("__part")
