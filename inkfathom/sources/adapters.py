"""The engine's typed tables over the star-schema and corpus tables.

Each adapter has its SQL twin in ``VIEWS``, which the queries' SQL builds upon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.shipping import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # A union of children that are hash-partitioned alike may else stand for their
    # partitioning although adaptive coalescing has cut each child differently;
    # an aggregate above, planned without an exchange, then splits groups.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Lines of the documents: chunk_id, document_id, ord, text, token_count, and ``more`` columns of the documents."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", *more, F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return lines.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("ord").cast("string")).alias("chunk_id"),
        F.col("doc_id").alias("document_id"),
        F.col("ord").cast("bigint").alias("ord"),
        "text",
        F.size(F.filter(F.split("text", " "), lambda w: w != "")).cast("bigint").alias("token_count"),
        *more,
    )


def graph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks of their customer's document, in order of date."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("chunk_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("document_id"),
        F.date_format("o_orderdate", "yyyyMMdd").cast("bigint").alias("ord"),
        F.col("o_orderkey").cast("bigint").alias("key"),
        F.col("o_orderpriority").alias("heading"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities; the brand is the label."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("label"),
        F.col("p_type").alias("kind"),
        F.col("p_size").cast("bigint").alias("size"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as MENTIONS edges, one for each order and part."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
        F.round(1 - 5 * F.col("l_discount"), 4).alias("confidence"),
    )
    return lines.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"), F.count("*").alias("times"))


def next_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NEXT_CHUNK edges between a document's successive chunks."""
    from inkfathom.operators.graph import adjacency

    return adjacency(graph_chunks(spark, sf_dir), "document_id", ["ord", "key"], "chunk_id")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REFERENCES edges: a customer to the next of the same nation."""
    from inkfathom.operators.graph import adjacency

    return adjacency(
        table(spark, sf_dir, "customer").select(
            F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), "c_nationkey", "c_custkey"
        ),
        "c_nationkey",
        ["c_custkey"],
        "id",
    )


def typed_edges(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """src, dst, type, confidence, source: the edges of the types asked for, as one table.

    Customers are documents, orders their chunks, parts entities, nations errors,
    suppliers procedures: every fifth customer of a nation is a step of its
    procedures, and the next customer a step of that step.
    """
    key = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    of = lambda df, kind, a, b, confidence=F.lit(1.0), source=F.lit(""): df.select(
        a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"), confidence.alias("confidence"), source.alias("source")
    )
    src, dst = F.col("src"), F.col("dst")
    steps = table(spark, sf_dir, "customer").where("c_custkey % 5 = 0").select("c_custkey", F.col("c_nationkey").alias("s_nationkey"))
    made = {
        "HAS_CHUNK": lambda: of(table(spark, sf_dir, "orders"), "HAS_CHUNK", key("c", "o_custkey"), key("o", "o_orderkey")),
        "NEXT_CHUNK": lambda: of(next_chunk(spark, sf_dir), "NEXT_CHUNK", src, dst),
        "REFERENCES": lambda: of(references(spark, sf_dir), "REFERENCES", src, dst),
        "MENTIONS": lambda: of(mentions(spark, sf_dir), "MENTIONS", src, dst, F.col("confidence"), src),
        "RESOLVES": lambda: of(table(spark, sf_dir, "supplier"), "RESOLVES", key("s", "s_suppkey"), key("n", "s_nationkey")),
        "CONTAINS_STEP": lambda: of(
            table(spark, sf_dir, "supplier").join(steps, "s_nationkey"), "CONTAINS_STEP", key("s", "s_suppkey"), key("c", "c_custkey")
        ).unionByName(of(references(spark, sf_dir), "CONTAINS_STEP", src, dst)),
    }
    parts = [made[t]() for t in types or made]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


VIEWS = {
    "chunks": """
  SELECT concat(doc_id, '-', ord) AS chunk_id, doc_id AS document_id, ord, text,
    len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS token_count
  FROM (SELECT doc_id, unnest(lines) AS text, generate_subscripts(lines, 1) - 1 AS ord
        FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""",
    "graph_chunks": """
  SELECT concat('o', o_orderkey) AS chunk_id, concat('c', o_custkey) AS document_id,
    CAST(strftime(o_orderdate, '%Y%m%d') AS BIGINT) AS ord, CAST(o_orderkey AS BIGINT) AS key,
    o_orderpriority AS heading, o_orderstatus AS status, o_totalprice AS price
  FROM orders""",
    "entities": """
  SELECT concat('p', p_partkey) AS id, p_name AS name, p_brand AS label, p_type AS kind, CAST(p_size AS BIGINT) AS size
  FROM part""",
    "mentions": """
  SELECT concat('o', l_orderkey) AS src, concat('p', l_partkey) AS dst,
    max(round(1 - 5 * l_discount, 4)) AS confidence, count(*) AS times
  FROM lineitem GROUP BY 1, 2""",
    "next_chunk": """
  SELECT * FROM (
    SELECT chunk_id AS src, lead(chunk_id) OVER (PARTITION BY document_id ORDER BY ord, key) AS dst FROM graph_chunks)
  WHERE dst IS NOT NULL""",
    "refs": """
  SELECT * FROM (
    SELECT concat('c', c_custkey) AS src,
      concat('c', lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey)) AS dst,
      lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nxt FROM customer)
  WHERE nxt IS NOT NULL""",
    "typed_edges": """
  WITH refs AS (
    SELECT concat('c', c_custkey) AS src, concat('c', nxt) AS dst
    FROM (SELECT c_custkey, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nxt FROM customer) WHERE nxt IS NOT NULL)
  SELECT concat('c', o_custkey) AS src, concat('o', o_orderkey) AS dst, 'HAS_CHUNK' AS type, 1.0::DOUBLE AS confidence, '' AS source FROM orders
  UNION ALL SELECT src, dst, 'NEXT_CHUNK', 1.0, '' FROM (
    SELECT concat('o', o_orderkey) AS src, concat('o', lead(o_orderkey) OVER w) AS dst, lead(o_orderkey) OVER w AS nxt
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y%m%d'), o_orderkey)) WHERE nxt IS NOT NULL
  UNION ALL SELECT src, dst, 'REFERENCES', 1.0, '' FROM refs
  UNION ALL SELECT concat('o', l_orderkey), concat('p', l_partkey), 'MENTIONS', max(round(1 - 5 * l_discount, 4)), concat('o', l_orderkey)
    FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey), 'RESOLVES', 1.0, '' FROM supplier
  UNION ALL SELECT concat('s', s_suppkey), concat('c', c_custkey), 'CONTAINS_STEP', 1.0, '' FROM supplier JOIN customer ON c_nationkey = s_nationkey WHERE c_custkey % 5 = 0
  UNION ALL SELECT src, dst, 'CONTAINS_STEP', 1.0, '' FROM refs""",
}


def with_views(names: str, rest: str) -> str:
    """``WITH`` the named views (blank-separated, in order of use), then ``rest``:
    more common table expressions, or a SELECT."""
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names.split())
    rest = rest.strip()
    return f"WITH RECURSIVE {views}" + (" " if rest.upper().startswith("SELECT") else ", ") + rest
