"""Queries of document links and of rolling metrics, both kept batch by batch."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.operators import linking, summaries
from inkfathom.plans.sparse import _TITLES_SQL, titles
from inkfathom.registry import query
from inkfathom.sources.adapters import table
from inkfathom.sources.scratch import scratch_dir, written


def _vectors(spark: SparkSession, sf: str, which: str) -> dict[str, DataFrame]:
    """The first four components stand for the vector of a title: whole vectors of the tables are hardly alike."""
    e = table(spark, sf, "embeddings").where(which).select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 4).alias("vector"))
    words = titles(table(spark, sf, "documents").join(e.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"))
    terms = words.select("id", F.explode(F.split("text", " ")).alias("term")).where("term <> ''")
    return {"dense": e, "sparse": terms.groupBy("id", "term").agg(F.count("*").cast("double").alias("weight"))}


_LISTS_SQL = f"""
e AS (SELECT vec_id AS id, v, sqrt(list_dot_product(v, v)) AS norm FROM (SELECT vec_id, CAST(embedding[1:4] AS DOUBLE[]) AS v FROM embeddings)),
dense AS (SELECT a.id AS src, b.id AS dst, round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 9) AS score FROM e a JOIN e b ON a.id <> b.id WHERE score >= 0.5),
{_TITLES_SQL.strip().replace("WHERE id % 100 = 0", "")},
tw AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(words) AS w FROM titles SEMI JOIN embeddings ON vec_id = id) GROUP BY ALL),
sparse AS (SELECT a.id AS src, b.id AS dst, sum(a.n * b.n)::DOUBLE AS score FROM tw a JOIN tw b ON a.w = b.w AND a.id <> b.id GROUP BY ALL),
lists AS (
  SELECT *, row_number() OVER (PARTITION BY src, kind ORDER BY score DESC, dst) AS place
  FROM (SELECT src, 'dense' AS kind, dst, score FROM dense UNION ALL SELECT src, 'sparse', dst, score FROM sparse) QUALIFY place <= {linking.LIST})"""


def _arrived(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    """The lists of these kinds after every tenth vector has come last."""
    old, new = ({k: v[k] for k in kinds} for v in (_vectors(spark, sf, "vec_id % 10 <> 0"), _vectors(spark, sf, "vec_id % 10 = 0")))
    made = {"dense": linking.dense_lists, "sparse": linking.sparse_lists}
    first = reduce(DataFrame.unionByName, (made[k](old[k], old[k]) for k in kinds))
    return linking.arrived(written(first, "lists"), old, new)


@query("G36 G38", f"""
WITH {_LISTS_SQL},
fused AS (SELECT src, dst, sum(1.0::DOUBLE / ({linking.RANK_CONSTANT} + place)) AS score FROM lists GROUP BY ALL)
SELECT src, dst, round(score, 9) AS score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank
FROM fused WHERE score >= 0.025 QUALIFY rank <= {linking.LINKS}""")
def fused_links(spark: SparkSession, sf: str) -> DataFrame:
    """Five links of each document by the fusion of dense and sparse ranks, as they are after a tenth of the documents has come later."""
    return linking.linked(_arrived(spark, sf, "dense", "sparse"), "fused").withColumn("score", F.round("score", 9))


@query("G36 V17", f"""
WITH {_LISTS_SQL}
SELECT src, dst, score, place AS rank FROM lists WHERE kind = 'dense' AND score >= {linking.THRESHOLDS["dense"]} AND place <= {linking.LINKS}""")
def dense_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links by dense score alone, likewise."""
    return linking.linked(_arrived(spark, sf, "dense"), "dense")


@query("D11 D12 A18")
def rolling_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of the events' values by type from summaries added day by day (no SQL: within one per cent of exact ones, which tests hold)."""
    t = summaries.summary_table(spark, f"{scratch_dir(spark)}/summary-{uuid.uuid4().hex}")
    events = table(spark, sf, "events").withColumn("part", F.pmod(F.dayofyear("ts"), 3))
    for number in range(3):
        summaries.added(t, summaries.summary(events.where(F.col("part") == number), "event_type", "value"), "events", number)
    return summaries.quantiles(t.read(), [0.5, 0.95, 0.99])
