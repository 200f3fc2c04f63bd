"""One object with the engine's tools; each gives a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.functions import scalars
from inkfathom.operators import context, fusion, graph, guards, search


class Engine:
    """Tables: chunks (chunk_id, document_id, ord, text, token_count), entities (id,
    name, label), mentions (src, dst, confidence), edges (src, dst, type), vectors
    (id, vector, grp)."""

    def __init__(self, spark: SparkSession, chunks: DataFrame, entities: DataFrame, mentions: DataFrame, edges: DataFrame, vectors: DataFrame | None = None):
        self.spark, self.chunks, self.entities, self.mentions, self.edges, self.vectors = spark, chunks, entities, mentions, edges, vectors

    def _ids(self, ids: Sequence[str], name: str = "node") -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], f"{name} string")

    def search_documentation(self, query: str, top_k: int = 10, query_vectors: DataFrame | None = None, k: int = 60) -> DataFrame:
        """Chunks by keyword and, where vectors are given, by vector, fused by rank."""
        asked = self.spark.createDataFrame([(0, query)], "query_id bigint, text string")
        asked = asked.withColumn("text", scalars.rewrite_keywords(F.col("text")))
        docs = self.chunks.select(F.col("chunk_id").alias("id"), "text")
        found = search.top_k(search.bm25(docs, asked), "query_id", [F.desc("score"), "id"], 10 * top_k).drop("rank").withColumn("field", F.lit("text"))
        if query_vectors is not None and self.vectors is not None:
            near = search.knn(self.vectors, query_vectors, 10 * top_k).drop("rank").withColumn("field", F.lit("content"))
            found = found.withColumn("id", F.col("id").cast("string")).unionByName(near.withColumn("id", F.col("id").cast("string")))
        fused = fusion.rrf(found, k=k)
        return fused.orderBy(F.desc("fused"), "id").limit(top_k)

    def search_sections(self, query: str, top_k: int = 10) -> DataFrame:
        hits = self.search_documentation(query, top_k).withColumnRenamed("id", "chunk_id")
        return hits.join(self.chunks, "chunk_id").select("chunk_id", "document_id", "ord", "fused", context.snippet(F.col("text")).alias("snippet"))

    def traverse_relationships(self, start_ids: Sequence[str], types: Sequence[str], max_depth: int = 2, limit: int = 100) -> DataFrame:
        allowed = guards.edge_types(types)
        walk = self.edges.where(F.col("type").isin(*allowed))
        return graph.k_hop(walk, self._ids(start_ids), min(max_depth, 3), "both").orderBy("distance", "node").limit(limit)

    def describe_nodes(self, ids: Sequence[str]) -> DataFrame:
        return self.entities.join(F.broadcast(self._ids(ids, "id")), "id", "left_semi")

    def expand_neighbors(self, ids: Sequence[str], types: Sequence[str], direction: str = "both", page: int = 0, size: int = 20) -> DataFrame:
        """One page; ask for the next while a page is full."""
        walk = self.edges.where(F.col("type").isin(*guards.edge_types(types)))
        found = graph.k_hop(walk, self._ids(ids), 1, direction).where("distance > 0")
        return found.orderBy("distance", "node").offset(page * size).limit(size)

    def get_paths_between(self, a: Sequence[str], b: Sequence[str], types: Sequence[str], max_hops: int = 3, limit: int = 50) -> DataFrame:
        walk = self.edges.where(F.col("type").isin(*guards.edge_types(types)))
        return graph.shortest_paths(walk, self._ids(a), self._ids(b), min(max_hops, 5)).orderBy("distance", "path").limit(limit)

    def list_children(self, parent: str) -> DataFrame:
        return self.chunks.where(F.col("document_id") == parent).orderBy("ord")

    def list_parents(self, node: str) -> DataFrame:
        return self.edges.where(F.col("dst") == node).select("src", "type")

    def get_entities_for_sections(self, ids: Sequence[str], labels: Sequence[str] | None = None, cap: int = 20) -> DataFrame:
        m = self.mentions.join(F.broadcast(self._ids(ids, "src")), "src", "left_semi")
        e = self.entities.where(F.col("label").isin(*labels)) if labels else self.entities
        return search.top_k(m.join(e, F.col("dst") == F.col("id")), "src", [F.desc("confidence"), "dst"], cap)

    def get_sections_for_entities(self, ids: Sequence[str], cap: int = 20) -> DataFrame:
        m = self.mentions.join(F.broadcast(self._ids(ids, "dst")), "dst", "left_semi")
        return search.top_k(m, "dst", [F.desc("confidence"), "src"], cap)

    def get_section_text(self, ids: Sequence[str], max_bytes: int = 8192) -> DataFrame:
        c = self.chunks.join(F.broadcast(self._ids(ids, "chunk_id")), "chunk_id", "left_semi")
        cut = scalars.truncate_bytes(max_bytes)
        return c.select("chunk_id", cut(F.col("text")).alias("text"), (F.octet_length("text") > max_bytes).alias("truncated"))

    def summarize_neighborhood(self, ids: Sequence[str], bullets: int = 5) -> DataFrame:
        found = graph.k_hop(self.edges, self._ids(ids), 1, "both").where("distance > 0").join(self.entities, F.col("node") == F.col("id"))
        best = search.top_k(found, "seed", ["name", "id"], bullets)
        return best.select("seed", F.format_string("- %s (%s)", "name", "label").alias("bullet"))

    def compute_context_bundle(self, ids: Sequence[str], budget: int = 4500) -> DataFrame:
        c = self.chunks.join(F.broadcast(self._ids(ids, "chunk_id")), "chunk_id", "left_semi")
        return context.joined_text(context.budget_prefix(c, "document_id", ["ord"], "token_count", budget), "document_id", ["ord"], "text")
