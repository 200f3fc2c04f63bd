"""Queries through keyed tables: merged batches, updates by difference, repaired references."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.registry import query
from inkfathom.sources import store
from inkfathom.sources.adapters import graph_chunks, table, with_views
from inkfathom.sources.scratch import scratch_dir


def _fresh(spark: SparkSession, schema: str, key: str, buckets: int = 16) -> store.KeyedTable:
    return store.KeyedTable.create(spark, f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}", schema, key, buckets)


@query("S20 T09", """
SELECT d.doc_id, d.lang, CASE WHEN l.doc_id IS NOT NULL THEN -d.n_chars ELSE d.n_chars END AS n_chars
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0""")
def merged_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A table of documents after a batch that changes those with labels and takes out toxic ones."""
    t = _fresh(spark, "doc_id bigint, lang string, n_chars bigint", "doc_id")
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    t.merge(d)
    labels = table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("gone"))
    t.merge(d.join(labels, "doc_id").withColumn("n_chars", -F.col("n_chars")), deletes="gone")
    return t.read()


@query("D08 T09", with_views("graph_chunks", """
SELECT g.chunk_id, g.document_id, g.status FROM graph_chunks g JOIN customer ON concat('c', c_custkey) = document_id WHERE c_acctbal >= 0"""))
def repaired_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks after those of documents that are gone (customers in debt) have been found and taken out."""
    t = _fresh(spark, "chunk_id string, document_id string, status string", "chunk_id")
    t.merge(graph_chunks(spark, sf).select("chunk_id", "document_id", "status"))
    alive = table(spark, sf, "customer").where("c_acctbal >= 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    store.repair_orphans(t, "document_id", alive, "id")
    return t.compact() and t.read()


@query("G26 T09", with_views("graph_chunks next_chunk", """
SELECT concat(src, '>', dst) AS edge, src, dst FROM next_chunk"""))
def restructured_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the order of keys, made into those of the order of dates: only what differs is taken out or put in."""
    from inkfathom.operators.graph import adjacency

    c = graph_chunks(spark, sf)
    named = lambda e: e.select(F.concat("src", F.lit(">"), "dst").alias("edge"), "src", "dst")
    t = _fresh(spark, "edge string, src string, dst string", "edge")
    t.merge(named(adjacency(c, "document_id", ["key"], "chunk_id")))
    store.update_from_diff(t, named(adjacency(c, "document_id", ["ord", "key"], "chunk_id")), ["src", "dst"])
    return t.read()
