"""Queries of candidate search and fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.operators import fusion, impacts, search
from inkfathom.registry import query
from inkfathom.sources.adapters import table

#: Best of each field that enter fusion.
DEPTH = 50
WEIGHTS = {"content": 0.5, "title": 0.3, "doc_title": 0.2}


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("bigint").alias("grp")
    )


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """The query set of vector searches: every id divisible by 100."""
    return rows(spark, sf).where("id % 100 = 0").withColumnRenamed("id", "query_id")


def rankings(spark: SparkSession, sf: str, k: int = DEPTH) -> DataFrame:
    r, q = rows(spark, sf), asked(spark, sf)
    return search.knn_fields(r, q, k, search.dense_fields(r)).select("query_id", "field", "id", "score")


def with_document(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    return df.join(rows(spark, sf).select("id", F.col("grp").alias("document_id")), "id")


FIELDS_SQL = """
  e AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS grp, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  fields AS (SELECT id, grp, 'content' AS field, v FROM e
    UNION ALL SELECT id, grp, 'title', v[1:32] FROM e UNION ALL SELECT id, grp, 'doc_title', v[33:64] FROM e),
  normed AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM fields),
  scored AS (
    SELECT q.id AS query_id, q.grp AS query_grp, r.field, r.id, r.grp,
      round(CASE WHEN q.norm * r.norm > 0 THEN list_dot_product(q.v, r.v) / (q.norm * r.norm) ELSE 0 END, 9) AS score
    FROM normed q JOIN normed r USING (field) WHERE q.id % 100 = 0),
  rankings AS (
    SELECT query_id, field, id, grp AS document_id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, field ORDER BY score DESC, id) AS rank FROM scored)
    WHERE rank <= 50)"""


def fields_sql(rest: str) -> str:
    rest = rest.strip()
    return f"WITH {FIELDS_SQL}" + (" " if rest.upper().startswith("SELECT") else ", ") + rest


@query("V01 V13 V14 V16 L06", fields_sql("SELECT query_id, id, score, rank FROM rankings WHERE field = 'content' AND rank <= 10"))
def knn_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.knn(rows(spark, sf), asked(spark, sf), 10)


@query("V02", fields_sql("SELECT query_id, id, score FROM scored WHERE field = 'content' AND score >= 0.3"))
def knn_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return search.knn(rows(spark, sf), asked(spark, sf), None, least=0.3).select("query_id", "id", "score")


@query("V17 V18 P07", fields_sql("""
SELECT query_id, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM scored WHERE field = 'content' AND grp <> query_grp AND score >= 0.2) WHERE rank <= 100"""))
def knn_exclude_own_document(spark: SparkSession, sf: str) -> DataFrame:
    return search.knn(rows(spark, sf), asked(spark, sf), 100, least=0.2, unlike=True)


@query("V15", fields_sql("""
SELECT query_id, id, max(score) AS score, arg_max(field, (score, field)) AS field FROM rankings GROUP BY ALL"""))
def knn_max_field(spark: SparkSession, sf: str) -> DataFrame:
    r = rankings(spark, sf)
    return r.groupBy("query_id", "id").agg(
        F.max("score").alias("score"), F.max_by("field", F.struct("score", "field")).alias("field")
    )


@query("F02 W01 L03 V04 V05 U02 V07", fields_sql("""
SELECT query_id, id, round(sum(1.0 * CASE field WHEN 'content' THEN 0.5 WHEN 'title' THEN 0.3 ELSE 0.2 END / (60 + rank)), 6) AS fused
FROM rankings GROUP BY ALL"""))
def rrf_weighted_fields(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.rrf(rankings(spark, sf), WEIGHTS).withColumn("fused", F.round("fused", 6))


@query("F03", fields_sql("""
SELECT query_id, id, field, rank, w AS weight, round(w / (60 + rank), 6) AS contribution
FROM (SELECT *, CAST(CASE field WHEN 'content' THEN 0.5 WHEN 'title' THEN 0.3 ELSE 0.2 END AS DOUBLE) AS w FROM rankings)"""))
def rrf_contributions(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.rrf_parts(rankings(spark, sf), WEIGHTS)


@query("F01 W04", fields_sql("""
SELECT query_id, id, round(sum(CASE WHEN top > 0 THEN w * score / top ELSE 0 END), 6) AS fused FROM (
  SELECT *, max(score) OVER (PARTITION BY query_id, field) AS top,
    CASE field WHEN 'content' THEN 0.5 WHEN 'title' THEN 0.3 ELSE 0.2 END AS w FROM rankings) GROUP BY ALL"""))
def weighted_max_norm_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.weighted_max(rankings(spark, sf), WEIGHTS).withColumn("fused", F.round("fused", 6))


@query("V06 V08 P06 J04", fields_sql("""
cand AS (SELECT query_id, id FROM rankings WHERE rank <= 10 GROUP BY ALL),
again AS (SELECT s.*, CASE s.field WHEN 'content' THEN 0.5 WHEN 'title' THEN 0.3 ELSE 0.2 END AS w,
  max(score) OVER (PARTITION BY s.query_id, s.field) AS top FROM scored s SEMI JOIN cand USING (query_id, id))
SELECT query_id, id, round(sum(CASE WHEN top > 0 THEN w * score / top ELSE 0 END), 6) AS fused FROM again GROUP BY ALL"""))
def two_stage_rescoring(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of all fields, scored anew in every field, fused."""
    r, q = rows(spark, sf), asked(spark, sf)
    cand = rankings(spark, sf, 10).select("query_id", "id").distinct()
    pairs = cand.join(r.select("id", F.col("vector").alias("v")), "id").join(q.select("query_id", "vector"), "query_id")
    scored = []
    for f, dims in search.dense_fields(r).items():
        cut = (lambda c: F.col(c)) if dims.start is None and dims.stop is None else (
            lambda c, d=dims: F.slice(F.col(c), (d.start or 0) + 1, d.stop - (d.start or 0))
        )
        score = F.round(search.cosine(cut("vector"), cut("v")), 9)
        scored.append(pairs.select("query_id", "id", F.lit(f).alias("field"), score.alias("score")))
    fused = fusion.weighted_max(reduce(DataFrame.unionByName, scored), WEIGHTS)
    return fused.withColumn("fused", F.round("fused", 6))


@query("F04 J03", fields_sql("""
l AS (SELECT query_id, id, score AS left_score, rank AS left_rank FROM rankings WHERE field = 'title'),
r AS (SELECT query_id, id, score AS right_score, rank AS right_rank FROM rankings WHERE field = 'doc_title')
SELECT coalesce(l.query_id, r.query_id) AS query_id, coalesce(l.id, r.id) AS id, left_score, left_rank, right_score, right_rank,
  round(coalesce(1.0 / (60 + left_rank), 0) + coalesce(1.0 / (60 + right_rank), 0), 6) AS fused
FROM l FULL JOIN r ON l.query_id = r.query_id AND l.id = r.id"""))
def rrf_two_lists_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    r = rankings(spark, sf).drop("rank")
    fused = fusion.rrf_two(r.where("field = 'title'").drop("field"), r.where("field = 'doc_title'").drop("field"))
    return fused.drop("field").withColumn("fused", F.round("fused", 6))


@query("F05", fields_sql("""
l AS (SELECT query_id, id, nullif(score, 0) AS s FROM rankings WHERE field = 'title'),
r AS (SELECT query_id, id, nullif(score, 0) AS s FROM rankings WHERE field = 'doc_title'),
b AS (SELECT coalesce(l.query_id, r.query_id) AS query_id, coalesce(l.id, r.id) AS id, l.s AS ls, r.s AS rs
  FROM l FULL JOIN r ON l.query_id = r.query_id AND l.id = r.id),
m AS (SELECT *, min(ls) OVER q AS l0, max(ls) OVER q AS l1, min(rs) OVER q AS r0, max(rs) OVER q AS r1 FROM b WINDOW q AS (PARTITION BY query_id))
SELECT query_id, id, round(0.6 * CASE WHEN ls IS NULL THEN 0 WHEN l0 = l1 THEN 1 ELSE (ls - l0) / (l1 - l0) END
  + 0.4 * CASE WHEN rs IS NULL THEN 0 WHEN r0 = r1 THEN 1 ELSE (rs - r0) / (r1 - r0) END, 6) AS fused FROM m"""))
def minmax_alpha_fusion(spark: SparkSession, sf: str) -> DataFrame:
    r = rankings(spark, sf)
    fused = fusion.alpha_fusion(r.where("field = 'title'"), r.where("field = 'doc_title'"))
    return fused.withColumn("fused", F.round("fused", 6))


@query("F07 A02", fields_sql("""
SELECT query_id, document_id, max(score) AS score, count(*) AS hits FROM rankings WHERE field = 'content' GROUP BY ALL"""))
def doc_max_score_agg(spark: SparkSession, sf: str) -> DataFrame:
    hits = with_document(search.knn(rows(spark, sf), asked(spark, sf), DEPTH), spark, sf)
    return fusion.best_of_group(hits, ["query_id", "document_id"])


@query("F06", fields_sql("""
d AS (SELECT query_id, field, document_id, max(score) AS score FROM rankings WHERE field IN ('title', 'doc_title') GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, field ORDER BY score DESC, document_id) AS rank FROM d)
SELECT query_id, document_id, round(sum(1.0 / (60 + rank)), 6) AS fused FROM p GROUP BY ALL"""))
def document_rrf(spark: SparkSession, sf: str) -> DataFrame:
    hits = with_document(rankings(spark, sf).where("field in ('title', 'doc_title')"), spark, sf)
    docs = fusion.best_of_group(hits, ["query_id", "field", "document_id"]).withColumnRenamed("document_id", "id")
    return fusion.rrf(docs).select("query_id", F.col("id").alias("document_id"), F.round("fused", 6).alias("fused"))


_DUP_SQL = """
u AS (
  SELECT query_id, id, 'title' AS source, score AS vector, CAST(NULL AS DOUBLE) AS graph, score AS fused,
    CASE WHEN id % 5 = 0 THEN score ELSE NULL END AS rerank FROM rankings WHERE field = 'title'
  UNION ALL SELECT query_id, id, 'doc_title', NULL, score, round(score / 2, 9), NULL FROM rankings WHERE field = 'doc_title')"""


def _twice(spark: SparkSession, sf: str) -> DataFrame:
    r = rankings(spark, sf)
    none = F.lit(None).cast("double")
    a = r.where("field = 'title'").select(
        "query_id", "id", F.lit("title").alias("source"), F.col("score").alias("vector"), none.alias("graph"),
        F.col("score").alias("fused"), F.when(F.col("id") % 5 == 0, F.col("score")).alias("rerank"),
    )
    b = r.where("field = 'doc_title'").select(
        "query_id", "id", F.lit("doc_title").alias("source"), none.alias("vector"), F.col("score").alias("graph"),
        F.round(F.col("score") / 2, 9).alias("fused"), none.alias("rerank"),
    )
    return a.unionByName(b)


@query("F08", fields_sql(_DUP_SQL + """,
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY (rerank IS NOT NULL) DESC, coalesce(fused, 0) DESC, source DESC) AS n FROM u),
g AS (SELECT query_id, id, max(vector) AS vector, max(graph) AS graph, max(rerank) AS rerank, count(*) AS n FROM u GROUP BY ALL)
SELECT g.query_id, g.id, k.source, g.vector, g.graph, g.rerank, g.n,
  round(CASE WHEN g.n > 1 THEN 0.6 * coalesce(g.vector, 0) + 0.4 * coalesce(g.graph, 0) ELSE k.fused END, 6) AS fused
FROM g JOIN k ON g.query_id = k.query_id AND g.id = k.id AND k.n = 1"""))
def dedup_best_score(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.dedup_best(_twice(spark, sf), 0.6, 0.4).withColumn("fused", F.round("fused", 6))


@query("F09", fields_sql(_DUP_SQL + """
SELECT query_id, id, source FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY fused DESC, source) AS n FROM u) WHERE n = 1""".replace("\nSELECT", ", z AS (SELECT 1) SELECT", 1)))
def dedup_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.dedup_first(_twice(spark, sf), ["query_id", "id"], [F.desc("fused"), "source"]).select(
        "query_id", "id", "source"
    )


@query("F14 W05 F22", fields_sql("""
f AS (SELECT query_id, id, any_value(document_id) AS document_id, sum(1.0 / (60 + rank)) AS fused FROM rankings GROUP BY query_id, id)
SELECT query_id, id, document_id, round(least(1.0, fused * (1 + 0.12 * (1.0 * count(*) OVER (PARTITION BY query_id, document_id)
  / count(*) OVER (PARTITION BY query_id)))), 6) AS fused FROM f"""))
def doc_continuity_boost(spark: SparkSession, sf: str) -> DataFrame:
    fused = with_document(fusion.rrf(rankings(spark, sf)), spark, sf)
    return fusion.continuity_boost(fused).select("query_id", "id", "document_id", F.round("fused", 6).alias("fused"))


@query("F22", fields_sql("""
c AS (SELECT query_id, id, document_id, 1.0 * count(*) OVER (PARTITION BY query_id, document_id) / count(*) OVER (PARTITION BY query_id) AS share
  FROM rankings WHERE field = 'content'),
g AS (SELECT *, count(*) FILTER (share > 0.5) OVER (PARTITION BY query_id) AS n FROM c)
SELECT query_id, id, document_id, round(share, 9) AS share FROM g WHERE share > 0.5 OR n = 0"""))
def primary_document_gate(spark: SparkSession, sf: str) -> DataFrame:
    hits = with_document(search.knn(rows(spark, sf), asked(spark, sf), DEPTH), spark, sf)
    return fusion.primary_document(hits).select("query_id", "id", "document_id", F.round("share", 9).alias("share"))


@query("F18 W07", fields_sql("""
n AS (SELECT *, nullif(score, 0) AS s, count(*) OVER (PARTITION BY query_id) AS c,
  count(*) OVER (PARTITION BY query_id ORDER BY score RANGE UNBOUNDED PRECEDING) AS l FROM rankings WHERE field = 'content'),
m AS (SELECT *, min(s) OVER (PARTITION BY query_id) AS lo, max(s) OVER (PARTITION BY query_id) AS hi FROM n)
SELECT query_id, id, round(CASE WHEN s IS NULL THEN 0 WHEN lo = hi THEN 1 ELSE (s - lo) / (hi - lo) END, 9) AS minmax,
  round(1 / (1 + exp(-score)), 9) AS sigmoid, round(CASE WHEN c > 1 THEN (l - 1) / (c - 1) ELSE 1 END, 9) AS percentile FROM m"""))
def expansion_normalise(spark: SparkSession, sf: str) -> DataFrame:
    r = search.knn(rows(spark, sf), asked(spark, sf), DEPTH)
    by = {h: F.round(fusion.normalise(F.col("score"), ["query_id"], h), 9).alias(h) for h in ("minmax", "sigmoid", "percentile")}
    return r.select("query_id", "id", *by.values())


@query("F19 F20 F21", fields_sql("""
x AS (SELECT l.query_id, l.id, 0.4 * l.score + 0.5 * s.score + 0.1 / (l.rank + 1) AS fused, l.score, l.rank,
  greatest(0.0, least(l.score / 2, l.score - 0.0001)) AS neighbour
  FROM rankings l JOIN rankings s ON l.query_id = s.query_id AND l.id = s.id AND l.field = 'title' AND s.field = 'doc_title'),
g AS (SELECT *, count(*) FILTER (score >= 0.3) OVER (PARTITION BY query_id) AS n FROM x)
SELECT query_id, id, round(fused, 6) AS fused, round(neighbour, 9) AS neighbour FROM g WHERE score >= 0.3 OR n = 0"""))
def expansion_fuse_gate(spark: SparkSession, sf: str) -> DataFrame:
    r = fusion.ranked(rankings(spark, sf))
    a = r.where("field = 'title'")
    b = r.where("field = 'doc_title'").select("query_id", "id", F.col("score").alias("structural"))
    both = a.join(b, ["query_id", "id"])
    gated = fusion.gate(both, F.col("score") >= 0.3, ["query_id"])
    return gated.select(
        "query_id", "id",
        F.round(fusion.expansion_score(F.col("score"), F.col("structural"), F.col("rank")), 6).alias("fused"),
        F.round(fusion.neighbour_score(F.col("score")), 9).alias("neighbour"),
    )


@query("F11 P09 F12", """
WITH d AS (SELECT doc_id, contains(text, '|') AS has_table, contains(text, '=') AS has_code, len(string_split(text, chr(10))) AS depth,
  CASE doc_id % 4 WHEN 0 THEN 'cli' WHEN 1 THEN 'reference' WHEN 2 THEN 'conceptual' ELSE 'other' END AS kind FROM documents)
SELECT doc_id, kind, round(CAST(0.8 AS DOUBLE) * CASE WHEN has_code AND kind = 'cli' THEN 1.2 WHEN has_code AND kind = 'reference' THEN 1.05 ELSE 1 END
  * CASE WHEN has_table AND kind = 'reference' THEN 1.2 ELSE 1 END
  * CASE kind WHEN 'cli' THEN CASE WHEN depth > 2 THEN 0.95 ELSE 1 END WHEN 'reference' THEN CASE WHEN depth > 1 THEN 0.9 ELSE 1 END
    ELSE CASE WHEN depth > 2 THEN 0.85 ELSE 1 END END, 9) AS score FROM d""")
def structural_boost(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(
        "doc_id", F.contains("text", F.lit("|")).alias("has_table"), F.contains("text", F.lit("=")).alias("has_code"),
        F.size(F.split("text", "\n")).alias("depth"),
        F.element_at(F.array(*map(F.lit, ("cli", "reference", "conceptual", "other"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("kind"),
    )
    boosted = fusion.structural_boost(F.lit(0.8), F.col("kind"), F.col("has_code"), F.col("has_table"), F.col("depth"))
    return d.select("doc_id", "kind", F.round(boosted, 9).alias("score"))


@query("F10 U06 P11", """
WITH c AS (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS w FROM conversations),
b AS (SELECT list_distinct(flatten(list(string_split(lower(text), ' ')))) AS e FROM benchmark),
n AS (SELECT conv_id, turn, len(list_intersect(w, list_filter(e, lambda x: length(x) >= 4 AND x NOT IN ('that', 'with', 'this')))) AS n FROM c CROSS JOIN b)
SELECT conv_id, turn, round(1 + least(0.5, CAST(0.1 AS DOUBLE) * n), 9) AS boost FROM n""")
def entity_boost(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    vocabulary = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("e")).distinct()
    usual = F.col("e").isin("that", "with", "this")
    kept = vocabulary.where((F.length("e") >= 4) & ~usual)
    hits = c.select("conv_id", "turn", F.explode("w").alias("e")).join(kept, "e").groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return c.join(hits, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.round(1 + F.least(F.lit(0.5), 0.1 * n), 9).alias("boost")
    )


_WORDS_SQL = "list_filter(string_split(lower(translate(text, chr(10), ' ')), ' '), lambda x: x <> '')"
_BM25_SQL = """
WITH w AS (SELECT doc_id AS id, list_filter(string_split(lower(translate(text, chr(10), ' ')), ' '), lambda x: x <> '') AS words FROM documents),
s AS (SELECT count(*) AS n_docs, avg(len(words)) AS avgdl FROM w),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split(lower(translate(text, chr(10), ' ')), ' '), lambda x: x <> '')) AS term FROM benchmark),
x AS (SELECT id, len(words) AS dl, unnest(words) AS term FROM w),
p AS (SELECT id, dl, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bm AS (SELECT query_id, id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM p JOIN df USING (term) CROSS JOIN s JOIN q USING (term) GROUP BY ALL)"""


def bm25(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    asked_ = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.bm25(docs, asked_).withColumn("score", F.round("score", 6))


@query("V09 L01 P08", _BM25_SQL + """
SELECT query_id, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 10""")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.top_k(bm25(spark, sf), "query_id", [F.desc("score"), "id"], 10)


@query("V03 V21", """
WITH w AS (SELECT conv_id AS id, unnest(string_split(lower(text), ' ')) AS term FROM conversations),
t AS (SELECT id, term, count(*) AS weight FROM w GROUP BY ALL),
q AS (SELECT query_id, term, count(*) AS weight FROM (SELECT item_id AS query_id, unnest(string_split(lower(text), ' ')) AS term FROM benchmark) GROUP BY ALL)
SELECT query_id, id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT query_id, id, CAST(sum(t.weight * q.weight) AS BIGINT) AS score FROM t JOIN q USING (term) GROUP BY ALL)) WHERE rank <= 10""")
def sparse_dot_topk(spark: SparkSession, sf: str) -> DataFrame:
    def weights(name: str, key: str) -> DataFrame:
        words = table(spark, sf, name[0]).select(F.col(name[1]).alias(key), F.explode(F.split(F.lower("text"), " ")).alias("term"))
        return words.groupBy(key, "term").agg(F.count("*").alias("weight"))

    scored = search.sparse_scores(weights(("conversations", "conv_id"), "id"), weights(("benchmark", "item_id"), "query_id"))
    return search.top_k(scored, "query_id", [F.desc("score"), "id"], 10)


@query("V11 V12 J09", """
WITH t AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS phrase FROM benchmark)
SELECT item_id, doc_id, CAST(length(phrase) AS BIGINT) AS score FROM t JOIN documents
ON contains(concat(' ', translate(text, chr(10), ' '), ' '), concat(' ', phrase, ' ')) WHERE length(phrase) >= 3""")
def phrase_search(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a phrase, by whole words. A phrase meets only documents
    that have its rarest word, found by an equi-join, before a text is searched."""
    phrase = F.trim(F.regexp_replace("text", r"\s+", " "))
    p = table(spark, sf, "benchmark").select("item_id", phrase.alias("phrase")).where(F.length("phrase") >= 3)
    docs = table(spark, sf, "documents").select("doc_id", F.translate("text", "\n", " ").alias("text"))
    named = p.select("item_id", F.explode(F.array_distinct(F.split("phrase", " "))).alias("word"))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    posted = words.join(named.select("word").distinct(), "word", "left_semi")
    frequency = posted.groupBy("word").agg(F.count("*").alias("df"))
    rarest = (
        named.join(frequency, "word", "left").groupBy("item_id")
        .agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    )
    pairs = rarest.join(posted, "word").select("item_id", "doc_id").join(p, "item_id").join(docs, "doc_id")
    blank = F.lit(" ")
    found = pairs.where(F.contains(F.concat(blank, F.col("text"), blank), F.concat(blank, F.col("phrase"), blank)))
    return found.select("item_id", "doc_id", F.length("phrase").cast("bigint").alias("score"))


@query("V19 N02", """
WITH e AS (SELECT DISTINCT p_brand AS brand, lower(p_brand) AS b FROM part)
SELECT c.conv_id, c.turn, e.brand, CAST(count(*) FILTER (contains(lower(c.text), split_part(e.b, '#', 1))) AS BIGINT) AS hits,
  max(CASE WHEN lower(c.text) = e.b THEN 1.0 WHEN contains(lower(c.text), e.b) THEN 0.9 WHEN contains(lower(c.text), left(e.b, 2)) THEN 0.8 ELSE CAST(0 AS DOUBLE) END) AS score
FROM conversations c CROSS JOIN e GROUP BY ALL""")
def focused_entities(spark: SparkSession, sf: str) -> DataFrame:
    """How well each brand (a closed list of some dozens) is named in each turn."""
    e = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.lower("p_brand").alias("b")).distinct()
    low = F.lower("text")
    score = (
        F.when(low == F.col("b"), 1.0).when(F.contains(low, F.col("b")), 0.9)
        .when(F.contains(low, F.substring("b", 1, 2)), 0.8).otherwise(0.0)
    )
    return (
        table(spark, sf, "conversations").crossJoin(F.broadcast(e)).groupBy("conv_id", "turn", "brand")
        .agg(F.count_if(F.contains(low, F.split_part("b", F.lit("#"), F.lit(1)))).alias("hits"), F.max(score).alias("score"))
    )
