"""Queries of enrichment, stitching, labels and tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfathom.operators import building, context, fusion, graph, learning, search
from inkfathom.registry import query
from inkfathom.sources.adapters import chunks, entities, graph_chunks, mentions, next_chunk, table, with_views


@query("F23 E05", with_views("mentions entities", """
d AS (SELECT src, e.label, min(dst) AS first FROM mentions JOIN entities e ON e.id = dst GROUP BY ALL)
SELECT src AS id, string_agg(label, ',' ORDER BY first) AS entity_types, count(*) AS entity_count FROM d GROUP BY src"""))
def entity_metadata_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Entity types of a chunk, each once, in order of their first entity."""
    m = mentions(spark, sf).join(entities(spark, sf).select(F.col("id").alias("dst"), "label"), "dst")
    listed = m.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", "label"))).alias("l"))
    types = F.array_distinct(F.col("l.label"))
    return listed.select("id", F.array_join(types, ",").alias("entity_types"), F.size(types).cast("bigint").alias("entity_count"))


@query("G11", with_views("graph_chunks next_chunk", """
r AS (SELECT chunk_id AS id, price / 1000000 AS score FROM graph_chunks WHERE key % 100 = 0),
n AS (SELECT e.dst AS id, max(greatest(0.0, least(r.score / 2, r.score - 0.0001))) AS score FROM r JOIN next_chunk e ON e.src = r.id GROUP BY ALL)
SELECT coalesce(r.id, n.id) AS id, round(least(1.0, greatest(coalesce(r.score, 0), coalesce(n.score, 0))), 9) AS score, r.id IS NULL AS added FROM r FULL JOIN n ON r.id = n.id"""))
def graph_enrichment_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Results and their next chunks; one that is both keeps its better score."""
    r = graph_chunks(spark, sf).where("key % 100 = 0").select(F.col("chunk_id").alias("id"), (F.col("price") / 1000000).alias("score"))
    n = r.join(next_chunk(spark, sf), F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.max(fusion.neighbour_score(F.col("score"))).alias("near"))
    both = r.join(n, "id", "full_outer")
    best = F.greatest(F.coalesce("score", F.lit(0.0)), F.coalesce("near", F.lit(0.0)))
    return both.select("id", F.round(F.least(F.lit(1.0), best), 9).alias("score"), F.col("score").isNull().alias("added"))


@query("G12", with_views("entities mentions", """
q AS (SELECT DISTINCT split_part(name, ' ', 1) AS word FROM entities),
h AS (SELECT q.word, e.id FROM q JOIN entities e ON contains(e.name, q.word))
SELECT h.word, m.src AS chunk_id, count(DISTINCT h.id) AS matched, round(1 - exp(-count(DISTINCT h.id) / 3.0), 6) AS score FROM h JOIN mentions m ON m.dst = h.id GROUP BY ALL"""))
def entity_anchored_channel(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that mention entities named by a word (words of names: a closed list)."""
    e = entities(spark, sf)
    words = e.select(F.explode(F.split("name", " ")).alias("token"), "id").distinct()
    asked = e.select(F.split_part("name", F.lit(" "), F.lit(1)).alias("word")).distinct()
    tokens = building.containing(words.select(F.col("token").alias("text")).distinct(), asked.select(F.col("word").alias("part"))).select(F.col("part").alias("word"), F.col("text").alias("token"))
    hits = tokens.join(words, "token").groupBy("id").agg(F.collect_set("word").alias("words"))
    # An entity takes its words along to each chunk, and chunks are counted where they are.
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("part"))
    n = lines.count()
    m = graph.dealt(lines, "part", n).distinct().withColumn("id", F.concat(F.lit("p"), F.col("part").cast("string")))
    met = graph.dealt(m.join(hits, "id").select("chunk", "words"), "chunk", 3 * n).select("chunk", F.explode("words").alias("word"))
    counted = met.groupBy("word", "chunk").agg(F.count("*").alias("matched"))
    g = counted.select("word", F.concat(F.lit("o"), F.col("chunk").cast("string")).alias("chunk_id"), "matched")
    return g.withColumn("score", F.round(fusion.saturating(F.col("matched"), 3.0), 6))


@query("G29", with_views("chunks", """
SELECT chunk_id, CASE WHEN contains(text, '=') AND contains(text, '|') THEN 'Chunk,CodeChunk,TableChunk' WHEN contains(text, '=') THEN 'Chunk,CodeChunk'
  WHEN contains(text, '|') THEN 'Chunk,TableChunk' ELSE 'Chunk' END AS labels, len(string_split(text, '|')) - 1 AS bars FROM chunks"""))
def structural_labels(spark: SparkSession, sf: str) -> DataFrame:
    code = F.when(F.contains("text", F.lit("=")), F.array(F.lit("CodeChunk"))).otherwise(F.array().cast("array<string>"))
    tab = F.when(F.contains("text", F.lit("|")), F.array(F.lit("TableChunk"))).otherwise(F.array().cast("array<string>"))
    labels = F.array_union(F.array_union(F.array(F.lit("Chunk")), code), tab)
    return chunks(spark, sf).select("chunk_id", F.array_join(labels, ",").alias("labels"), (F.size(F.split("text", r"\|")) - 1).cast("bigint").alias("bars"))


@query("G26 T08 T11", with_views("graph_chunks next_chunk", """
SELECT document_id, count(*) AS chunks, count(dst) AS edges, count(*) - 1 = count(dst) AS whole FROM graph_chunks LEFT JOIN next_chunk ON src = chunk_id GROUP BY ALL"""))
def rebuilt_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Structural edges made anew from the chunks alone: n - 1 a document, however often."""
    c = graph_chunks(spark, sf)
    e = graph.adjacency(c, "document_id", ["ord", "key"], "chunk_id").withColumnRenamed("src", "chunk_id")
    g = c.join(e, "chunk_id", "left").groupBy("document_id").agg(F.count("*").alias("chunks"), F.count("dst").alias("edges"))
    return g.withColumn("whole", F.col("chunks") - 1 == F.col("edges"))


@query("X05")
def microdoc_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Small documents stitched to the first three of each query's ten nearest
    vectors: from the other seven, the source, the seed's own neighbours (no
    SQL: who is taken depends on who was before). A vector is its document's of the same id."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("directory"), "text")

    def rows() -> DataFrame:  # read anew for each side of a search
        every = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit(0).cast("bigint").alias("grp"))
        return every.join(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), "id", "left_semi")

    ask = lambda d, c: d.select(F.col(c).alias("query_id"), "vector", "grp")
    found = search.knn(rows(), ask(rows().where("id % 100 = 0"), "id"), 10).select("query_id", F.col("id").alias("document_id"), "rank")
    wanted = found.where("rank <= 3").select(F.col("document_id").alias("id")).distinct()
    near = search.knn(rows(), ask(rows().join(wanted, "id", "left_semi"), "id"), context.TIER + 1, least=0.76).where("id <> query_id")
    near = context.capped(near, "query_id", ["rank"], context.TIER).select(F.col("query_id").alias("document_id"), "id", "rank")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy("rank")))
    return context.stitch_microdocs(found, context.micro_documents(docs), near, 3).withColumn("text", F.sha2("text", 256))


@query("N09")
def tuned_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of three features of the documents with labels that rank them by quality within
    their language (no SQL: iterative; tested with a known optimum)."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    f = d.select("lang", (F.col("n_chars") / 20000).alias("f0"), (F.col("doc_id") % 7 / 7).alias("f1"), F.col("toxic").alias("f2"), "quality")
    w, _ = learning.tune_weights(f, "lang", ["f0", "f1", "f2"], "quality")
    return spark.createDataFrame([(f"f{i}", float(x)) for i, x in enumerate(w)], "feature string, weight double")


@query("C29", "SELECT md5(regexp_replace(lower(text), '[0-9]+', '?', 'g')) AS fingerprint, count(*) AS n, max(length(text)) AS slowest FROM conversations GROUP BY ALL")
def query_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Queries by the text that is left when their literals are parameters."""
    form = F.regexp_replace(F.lower("text"), "[0-9]+", "?")
    g = table(spark, sf, "conversations").groupBy(F.md5(form).alias("fingerprint"))
    return g.agg(F.count("*").alias("n"), F.max(F.length("text")).cast("bigint").alias("slowest"))
