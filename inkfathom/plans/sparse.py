"""Queries over sparse vectors: similar titles, prefetch with fusion in the store, mentions of titles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.operators import fusion, search, subsets
from inkfathom.plans.search import FIELDS_SQL, asked, rows
from inkfathom.registry import query
from inkfathom.sources.adapters import table
from inkfathom.sources.scratch import written

#: How many of each kind of vector are fetched before fusion, and results at most of similar chunks.
DENSE_LIMIT, SPARSE_LIMIT, TITLE_LIMIT, FUSED_LIMIT, CHUNK_LIMIT = 200, 200, 50, 200, 100
#: Words of a text that stand for its title, as the documents have none.
TITLE_WORDS = 6


def titles(docs: DataFrame) -> DataFrame:
    """id, text: the first words of each document in place of its title."""
    return docs.select(F.col("doc_id").alias("id"), F.array_join(F.slice(search.terms(F.col("text")), 1, TITLE_WORDS), " ").alias("text"))


_WORDS = "list_filter(string_split(lower(translate(text, chr(10), ' ')), ' '), lambda x: x <> '')"


def _bm25_sql(name: str, docs: str, asked: str) -> str:
    """``name``: query_id, id, score over ``docs`` (id, words) for ``asked`` (query_id, term)."""
    return f"""
{name}_x AS (SELECT id, len(words) AS dl, unnest(words) AS term FROM {docs}),
{name}_p AS (SELECT id, dl, term, count(*) AS tf FROM {name}_x WHERE term IN (SELECT term FROM {asked}) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_s AS (SELECT count(*) AS n_docs, avg(len(words)) AS avgdl FROM {docs}),
{name} AS (
  SELECT query_id, id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {name}_p JOIN {name}_df USING (term) CROSS JOIN {name}_s JOIN {asked} USING (term) GROUP BY ALL)"""


_TITLES_SQL = f"""
whole AS (SELECT doc_id AS id, source, {_WORDS} AS words FROM documents),
titles AS (SELECT id, source, words[1:{TITLE_WORDS}] AS words FROM whole),
asked AS (SELECT DISTINCT id AS query_id, unnest(words) AS term FROM titles WHERE id % 100 = 0)"""


@query("V17", f"""
WITH {_TITLES_SQL}, {_bm25_sql("t", "titles", "asked")},
other AS (SELECT t.* FROM t JOIN titles a ON a.id = t.query_id JOIN titles b ON b.id = t.id WHERE a.source IS DISTINCT FROM b.source)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM other) WHERE rank <= {CHUNK_LIMIT}""")
def sparse_similar_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of another source whose titles (first words) are most alike, by sparse vectors; not all postings are added up."""
    docs = table(spark, sf, "documents")
    t, grp = titles(docs), docs.select(F.col("doc_id").alias("id"), F.col("source").alias("grp"))
    own = t.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    terms = search.query_terms(own).withColumn("weight", F.lit(1.0)).join(grp.withColumnRenamed("id", "query_id"), "query_id")
    postings = search.bm25_weights(search.term_counts(t, terms)).join(grp, "id")
    found = subsets.best_sparse(postings, terms, CHUNK_LIMIT, slack=1e-5).withColumn("score", F.round("score", 6))
    return search.top_k(found, "query_id", [F.desc("score"), "id"], CHUNK_LIMIT)


_LIMITS = {"content": DENSE_LIMIT, "title": DENSE_LIMIT, "doc_title": DENSE_LIMIT, "text-sparse": SPARSE_LIMIT, "title-sparse": TITLE_LIMIT}


@query("V05 V07 U02", f"""
WITH {FIELDS_SQL}, {_TITLES_SQL.strip()},
held AS (SELECT * FROM whole SEMI JOIN embeddings ON vec_id = id),
held_titles AS (SELECT * FROM titles SEMI JOIN embeddings ON vec_id = id),
{_bm25_sql("a", "held", "asked")}, {_bm25_sql("b", "held_titles", "asked")},
lists AS (SELECT query_id, field, id, score FROM scored UNION ALL SELECT query_id, 'text-sparse', id, score FROM a UNION ALL SELECT query_id, 'title-sparse', id, score FROM b),
fetched AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, field ORDER BY score DESC, id) AS rank FROM lists
  QUALIFY rank <= CASE field {" ".join(f"WHEN '{f}' THEN {n}" for f, n in _LIMITS.items())} END),
spread AS (SELECT *, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS dev FROM fetched WINDOW w AS (PARTITION BY query_id, field)),
fused AS (SELECT query_id, id, round(sum(CASE WHEN dev > 1e-12 THEN (score - mean + 3 * dev) / (6 * dev) ELSE 0.5 END), 6) AS fused FROM spread GROUP BY ALL),
kept AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) <= {FUSED_LIMIT})
SELECT query_id, id, fused, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
FROM kept JOIN (SELECT query_id, id, score FROM scored WHERE field = 'content') USING (query_id, id) QUALIFY rank <= 10""")
def prefetch_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Best of each dense field and of two sparse ones, fused by their distributions, then ranked by the primary dense vector.

    The text of vector i is document i; its first words are the sparse query.
    """
    v, q = rows(spark, sf), asked(spark, sf)
    dense = search.knn_fields(v, q, DENSE_LIMIT, search.dense_fields(v)).select("query_id", "field", "id", "score")
    docs = table(spark, sf, "documents").join(v.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    ask = titles(table(spark, sf, "documents").where("doc_id % 100 = 0")).withColumnRenamed("id", "query_id").join(q.select("query_id"), "query_id", "left_semi")
    sparse = {"text-sparse": docs.select(F.col("doc_id").alias("id"), "text"), "title-sparse": titles(docs)}
    lists = [dense]
    for field, texts in sparse.items():
        lists.append(search.bm25_best(texts, ask, _LIMITS[field]).select("query_id", F.lit(field).alias("field"), "id", "score"))
    fused = fusion.distribution_fusion(written(reduce(DataFrame.unionByName, lists), "lists")).withColumn("fused", F.round("fused", 6))
    kept = search.top_k(fused, "query_id", [F.desc("fused"), "id"], FUSED_LIMIT).drop("rank")
    own = kept.join(v.select("id", F.col("vector").alias("v")), "id").join(q.select("query_id", "vector"), "query_id")
    scored = own.select("query_id", "id", "fused", F.round(search.cosine(F.col("vector"), F.col("v")), 9).alias("score"))
    return search.top_k(scored, "query_id", [F.desc("score"), "id"], 10)
