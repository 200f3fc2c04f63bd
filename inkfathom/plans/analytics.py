"""Queries of aggregation, windows, set operations, contracts, evaluation, sessions and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfathom.operators import quality, search
from inkfathom.registry import query
from inkfathom.sources.adapters import chunks, entities, graph_chunks, mentions, next_chunk, references, table, with_views

#: Token ranges of the distribution report.
RANGES = ((0, 50), (51, 100), (101, 200), (201, 500), (501, 1000), (1001, 1 << 40))


@query("A08 D12 T12", with_views("chunks", """
SELECT count(*) AS chunks, round(avg(token_count), 6) AS mean, round(quantile_cont(token_count, 0.5), 6) AS p50, round(quantile_cont(token_count, 0.75), 6) AS p75,
  round(quantile_cont(token_count, 0.9), 6) AS p90, round(quantile_cont(token_count, 0.95), 6) AS p95, round(quantile_cont(token_count, 0.99), 6) AS p99 FROM chunks"""))
def chunk_metrics_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    p = (0.5, 0.75, 0.9, 0.95, 0.99)
    one = chunks(spark, sf).agg(F.count("*").alias("chunks"), F.round(F.avg("token_count"), 6).alias("mean"), F.percentile("token_count", F.array(*map(F.lit, p))).alias("p"))
    return one.select("chunks", "mean", *(F.round(F.col("p")[i], 6).alias(f"p{round(x * 100)}") for i, x in enumerate(p)))


@query("A09", with_views("chunks", """
o AS (SELECT token_count, row_number() OVER (ORDER BY token_count) - 1 AS i, count(*) OVER () AS n FROM chunks)
SELECT CAST(p AS INTEGER) AS percentile, max(token_count) FILTER (i = least(n - 1, n * p // 100)) AS value FROM o CROSS JOIN (VALUES (50), (90), (99)) t(p) GROUP BY p"""))
def nearest_index_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """The value at place n*p/100 of the sorted counts, from counts by value: no
    sort of all rows in one task."""
    values = chunks(spark, sf).groupBy("token_count").agg(F.count("*").alias("n"))
    w = Window.orderBy("token_count")
    # Distinct values are few beside rows: token counts of a chunk.
    upto = values.select("token_count", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    p = spark.createDataFrame([(50,), (90,), (99,)], "percentile int")
    place = F.least(F.col("total") - 1, F.floor(F.col("total") * F.col("percentile") / 100))
    return upto.crossJoin(F.broadcast(p)).where(F.col("upto") > place).groupBy("percentile").agg(F.min("token_count").alias("value"))


@query("A10", with_views("chunks", f"""
SELECT lo, hi, count(token_count) AS chunks, round(100.0 * count(token_count) / (SELECT count(*) FROM chunks), 6)::DOUBLE AS share
FROM (VALUES {', '.join(map(str, RANGES))}) r(lo, hi) LEFT JOIN chunks ON token_count BETWEEN lo AND hi GROUP BY ALL""").replace("SELECT lo, hi,", "SELECT CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi,"))
def token_histogram(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("token_count")
    counted = chunks(spark, sf).agg(F.count("*").alias("n"), *(F.count_if(c.between(a, b)).alias(f"r{i}") for i, (a, b) in enumerate(RANGES)))
    rows = F.array(*(F.struct(F.lit(a).cast("bigint").alias("lo"), F.lit(b).cast("bigint").alias("hi"), F.col(f"r{i}").alias("chunks")) for i, (a, b) in enumerate(RANGES)))
    return counted.select("n", F.inline(rows)).select("lo", "hi", "chunks", F.round(100.0 * F.col("chunks") / F.col("n"), 6).alias("share"))


@query("A11 A19 G41", with_views("chunks", """
s AS (SELECT document_id, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, max(token_count) AS largest FROM chunks GROUP BY ALL)
SELECT s.document_id, chunks, tokens, largest, n_chars AS declared, abs(n_chars - length(text)) <= 0.01 * n_chars AS within FROM s JOIN documents ON doc_id = document_id"""))
def document_token_accounting(spark: SparkSession, sf: str) -> DataFrame:
    s = chunks(spark, sf).groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("largest"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("n_chars").alias("declared"), F.length("text").alias("real"))
    return s.join(d, "document_id").select("document_id", "chunks", "tokens", "largest", "declared", (F.abs(F.col("declared") - F.col("real")) <= 0.01 * F.col("declared")).alias("within"))


@query("A12 K02", with_views("chunks", """
h AS (SELECT *, sum(CASE WHEN token_count < 8 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY ord) AS block FROM chunks)
SELECT document_id, CAST(block AS BIGINT) AS block, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, min(ord) AS first FROM h GROUP BY ALL"""))
def heading_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of lines; a short line, taken as a heading, begins a new one."""
    w = Window.partitionBy("document_id").orderBy("ord")
    h = chunks(spark, sf).withColumn("block", F.sum(F.when(F.col("token_count") < 8, 1).otherwise(0)).over(w))
    return h.groupBy("document_id", "block").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.min("ord").alias("first"))


@query("A13 A14 A15 A18", """
SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 6)::DOUBLE AS share, round(avg(CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS oversized,
  count(DISTINCT user_id) AS users FROM events GROUP BY ALL""")
def mode_histogram(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(F.col("value") > 40, 1.0).otherwise(0.0)), 6).alias("oversized"), F.count_distinct("user_id").alias("users")
    )
    total = F.sum("n").over(Window.partitionBy())  # over one row for each event type
    return e.withColumn("share", F.round(100.0 * F.col("n") / total, 6))


@query("A17 N11 D15", """
SELECT l_returnflag AS label, l_linestatus AS prop, count(*) AS freq, round(avg(l_quantity), 6) AS mean_ms, round(count(*) * avg(l_quantity), 3) AS benefit FROM lineitem GROUP BY ALL""")
def suggest_indexes(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("prop")).agg(F.count("*").alias("freq"), F.avg("l_quantity").alias("m"))
    return g.select("label", "prop", "freq", F.round("m", 6).alias("mean_ms"), F.round(F.col("freq") * F.col("m"), 3).alias("benefit"))


@query("W06 X01 X10", with_views("chunks", """
r AS (SELECT *, CAST(sum(token_count) OVER (PARTITION BY document_id ORDER BY ord) AS BIGINT) AS used FROM chunks),
c AS (SELECT *, min(CASE WHEN used > 200 THEN ord END) OVER (PARTITION BY document_id) AS stop FROM r)
SELECT document_id, ord, token_count, used FROM c WHERE stop IS NULL OR ord < stop"""))
def token_budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    from inkfathom.operators.context import budget_prefix

    return budget_prefix(chunks(spark, sf), "document_id", ["ord"], "token_count", 200).select("document_id", "ord", "token_count", "used")


@query("W08", """
WITH a AS (SELECT o_orderkey AS id, o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS before,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS after FROM orders)
SELECT g, round(avg(abs(before - after)), 6) AS mean_delta, max(abs(before - after)) AS most FROM a GROUP BY g""")
def rank_delta(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey")
    a = F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey"))
    b = F.row_number().over(w.orderBy(F.desc("o_orderdate"), "o_orderkey"))
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("g"), F.abs(a - b).cast("bigint").alias("d"))
    return d.groupBy("g").agg(F.round(F.avg("d"), 6).alias("mean_delta"), F.max("d").alias("most"))


@query("W09 N03", """
SELECT conv_id, turn, role, length(text) AS n FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE turn > last - 3""")
def session_focus_last_n(spark: SparkSession, sf: str) -> DataFrame:
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    c = table(spark, sf, "conversations").withColumn("last", last).where(F.col("turn") > F.col("last") - 3)
    return c.select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n"))


@query("W10", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY ALL""")
def trailing_window_metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("last"))
    recent = e.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 1 DAY"))
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("L02 L08", """
SELECT o_custkey AS g, o_orderkey AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY (o_orderkey % 100 = 0) DESC, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE o_totalprice / 2 END DESC, o_orderpriority, o_orderkey) AS rank FROM orders) WHERE rank <= 2""")
def final_order_topk(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    score = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(F.col("o_totalprice") / 2)
    best = search.top_k(o, "o_custkey", [F.desc(F.col("o_orderkey") % 100 == 0), F.desc(score), "o_orderpriority", "o_orderkey"], 2)
    return best.select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), "rank")


@query("U03 U07 D10 J17 D08 S17", """
WITH a AS (SELECT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels UNION SELECT doc_id + 1000000 FROM labels WHERE doc_id % 10 = 0),
c AS (SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS shared, count(*) FILTER (b.doc_id IS NULL) AS only_left, count(*) FILTER (a.doc_id IS NULL) AS only_right
  FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT shared, only_left, only_right, round(100.0 * (only_left + only_right) / (shared + greatest(only_left, only_right)), 6)::DOUBLE AS drift_pct FROM c""")
def reconcile_drift(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id")
    other = labels.union(labels.where("doc_id % 10 = 0").select(F.col("doc_id") + 1000000))
    return quality.drift(table(spark, sf, "documents").select("doc_id"), other, "doc_id")


_NEW = "CASE WHEN ord % 7 = 0 THEN concat(text, '!') ELSE text END"


@query("U04 T09 S08", with_views("chunks", f"""
o AS (SELECT chunk_id, sha256(text) AS s FROM chunks WHERE ord % 11 <> 3), n AS (SELECT chunk_id, sha256({_NEW}) AS s FROM chunks WHERE ord % 13 <> 5)
SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' WHEN o.s = n.s THEN 'unchanged' ELSE 'modified' END AS change
FROM o FULL JOIN n ON o.chunk_id = n.chunk_id"""))
def section_diff(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    old = c.where("ord % 11 <> 3").select("chunk_id", F.sha2("text", 256).alias("s"))
    new = c.where("ord % 13 <> 5").select("chunk_id", F.sha2(F.expr(_NEW), 256).alias("s"))
    return quality.section_diff(old, new, "chunk_id", "s")


@query("D01 D06", """
WITH m AS (SELECT doc_id AS chunk_id, count(DISTINCT toxic) AS documents FROM labels GROUP BY ALL)
SELECT doc_id AS chunk_id, coalesce(documents, 0) AS documents FROM documents d LEFT JOIN m ON m.chunk_id = d.doc_id WHERE coalesce(documents, 0) <> 1""")
def contract_membership(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"))
    return quality.memberships(c, table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"), F.col("toxic").alias("document_id")))


@query("D02", with_views("mentions", "SELECT src, count(*) AS out FROM mentions GROUP BY src HAVING count(*) > 1"))
def contract_branching(spark: SparkSession, sf: str) -> DataFrame:
    return quality.branching(mentions(spark, sf))


@query("D03", """
WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation), w(src, dst, d) AS (
  SELECT src, dst, 1 FROM e UNION ALL SELECT w.src, e.dst, d + 1 FROM w JOIN e ON w.dst = e.src WHERE d < 64)
SELECT DISTINCT src FROM w WHERE src = dst""")
def contract_cycles(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    return quality.cycles(table(spark, sf, "nation").select(n.alias("src"), ((n * 7 + 3) % 25).alias("dst")))


@query("D04 D05 D09 D14", with_views("graph_chunks mentions entities", """
SELECT 'hierarchy' AS contract, count(*) AS n, round(1.0 * count(*) FILTER (heading IS NOT NULL) / count(*), 6)::DOUBLE AS coverage, count(*) FILTER (heading IS NOT NULL) >= 0.9 * count(*) AS passes FROM graph_chunks
UNION ALL SELECT 'normalised', count(*), round(1.0 * count(*) FILTER (name = lower(trim(name))) / count(*), 6), count(*) FILTER (name = lower(trim(name))) = count(*) FROM entities
UNION ALL SELECT 'confident', count(*), round(1.0 * count(*) FILTER (confidence >= 0.5) / count(*), 6), count(*) FILTER (confidence >= 0.5) = count(*) FROM mentions"""))
def contract_coverage(spark: SparkSession, sf: str) -> DataFrame:
    def one(df: DataFrame, name: str, good, least: float) -> DataFrame:
        ok = F.count_if(good)
        return df.agg(F.lit(name).alias("contract"), F.count("*").alias("n"), F.round(ok / F.count("*"), 6).alias("coverage"), (ok >= least * F.count("*")).alias("passes"))

    return (
        one(graph_chunks(spark, sf), "hierarchy", F.col("heading").isNotNull(), 0.9)
        .union(one(entities(spark, sf), "normalised", F.col("name") == F.lower(F.trim("name")), 1.0))
        .union(one(mentions(spark, sf), "confident", F.col("confidence") >= 0.5, 1.0))
    )


@query("D07", with_views("graph_chunks next_chunk", """
SELECT c.document_id, count(*) AS chunks, count(e.dst) AS edges FROM graph_chunks c LEFT JOIN (SELECT * FROM next_chunk WHERE hash(src) IS NOT NULL AND right(src, 1) <> '7') e ON e.src = c.chunk_id
GROUP BY ALL HAVING count(e.dst) < count(*) - 1"""))
def contract_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with fewer NEXT_CHUNK edges than chunks less one, after a loss of edges."""
    e = next_chunk(spark, sf).where(~F.col("src").endswith("7"))
    c = graph_chunks(spark, sf).join(e.select(F.col("src").alias("chunk_id"), "dst"), "chunk_id", "left")
    return c.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count("dst").alias("edges")).where("edges < chunks - 1")


@query("D11 D13", """
WITH m AS (SELECT event_type, count(*) AS n, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY ALL)
SELECT event_type, round(p95, 6) AS p95, CASE WHEN p95 <= 100 THEN 'OK' WHEN p95 <= 200 THEN 'ALERT' ELSE 'PAGE' END AS latency,
  CASE WHEN n >= 300 THEN 'OK' WHEN n >= 150 THEN 'ALERT' ELSE 'PAGE' END AS volume, CASE WHEN event_type <> 'error' THEN 'OK' ELSE 'PAGE' END AS errors FROM m""")
def slo_status(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    p95 = quality.percentile_by(e, "event_type", "value", 0.95).withColumnRenamed("value", "p95")
    m = e.groupBy("event_type").agg(F.count("*").alias("n")).join(p95, "event_type")
    wrong = F.when(F.col("event_type") == "error", F.col("n")).otherwise(0)
    return m.select(
        "event_type", F.round("p95", 6).alias("p95"), quality.slo_status(F.col("p95"), F.lit(100.0), "max").alias("latency"),
        quality.slo_status(F.col("n"), F.lit(300), "min").alias("volume"), quality.slo_status(wrong, F.lit(0), "zero").alias("errors"),
    )


_RANKED = """
r AS (SELECT d.lang AS query_id, d.doc_id AS id, row_number() OVER (PARTITION BY d.lang ORDER BY d.n_chars DESC, d.doc_id) AS rank FROM documents d),
rel AS (SELECT d.lang AS query_id, l.doc_id AS id, quality AS gain FROM labels l JOIN documents d USING (doc_id) WHERE quality > 0)"""


def ranked_documents(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), "n_chars")
    w = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "id")
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("gain"))
    return d.select("query_id", "id", F.row_number().over(w).alias("rank")), d.select("query_id", "id").join(labels, "id")


@query("M01 M02 C31 M03 M04", f"""
WITH {_RANKED.strip()},
n AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY ALL),
i AS (SELECT query_id, sum(gain / log2(rn + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, id) AS rn FROM rel) WHERE rn <= 10 GROUP BY ALL),
h AS (SELECT query_id, rank, gain, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS found FROM r JOIN rel USING (query_id, id) WHERE rank <= 10),
g AS (SELECT query_id, max(1.0 / rank) AS rr, sum(1.0 * found / rank) AS p, sum(gain / log2(rank + 1)) AS dcg, count(*) AS hits, count(*) FILTER (rank <= 1) AS h1,
  count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10 FROM h GROUP BY ALL)
SELECT query_id, round(CAST(coalesce(rr, 0) AS DOUBLE), 6) AS mrr, round(CAST(coalesce(p, 0) AS DOUBLE) / least(n_rel, 10), 6) AS map, round(coalesce(dcg, 0) / ideal, 6) AS ndcg,
  round(CAST(coalesce(hits, 0) AS DOUBLE) / n_rel, 6) AS recall, round(CAST(coalesce(h1, 0) AS DOUBLE) / least(n_rel, 1), 6) AS hits_at_1, round(CAST(coalesce(h3, 0) AS DOUBLE) / least(n_rel, 3), 6) AS hits_at_3,
  round(CAST(coalesce(h5, 0) AS DOUBLE) / least(n_rel, 5), 6) AS hits_at_5, round(CAST(coalesce(h10, 0) AS DOUBLE) / least(n_rel, 10), 6) AS hits_at_10
FROM n JOIN i USING (query_id) LEFT JOIN g USING (query_id)""")
def ndcg_mrr_map_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Documents ranked by length in each language, against the quality labels."""
    return quality.ranking_metrics(*ranked_documents(spark, sf))


@query("M05", """
WITH m AS (SELECT event_type, avg(value) AS mean, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY ALL)
SELECT a.event_type AS treatment, round(a.mean / b.mean - 1, 6) AS gain, round(a.p95 / b.p95, 6) AS latency_ratio, a.mean / b.mean - 1 >= 0.0 AND a.p95 / b.p95 <= 1.1 AND a.p95 <= 500 AS go
FROM m a CROSS JOIN m b WHERE b.event_type = 'view' AND a.event_type <> 'view'""")
def go_no_go(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    p95 = quality.percentile_by(e, "event_type", "value", 0.95).withColumnRenamed("value", "p95")
    m = e.groupBy("event_type").agg(F.avg("value").alias("mean")).join(p95, "event_type")
    base = m.where("event_type = 'view'").select(F.col("mean").alias("m0"), F.col("p95").alias("p0"))
    both = m.where("event_type <> 'view'").crossJoin(F.broadcast(base))  # one row
    gain, ratio = F.col("mean") / F.col("m0") - 1, F.col("p95") / F.col("p0")
    return both.select(F.col("event_type").alias("treatment"), F.round(gain, 6).alias("gain"), F.round(ratio, 6).alias("latency_ratio"), ((gain >= 0) & (ratio <= 1.1) & (F.col("p95") <= 500)).alias("go"))


@query("M06", """
WITH q AS (SELECT item_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) >= 6)) AS k FROM benchmark),
c AS (SELECT list_distinct(flatten(list(string_split(lower(text), ' ')))) AS w FROM conversations)
SELECT item_id, len(k) AS keywords, len(list_intersect(k, w)) AS found, round(CASE WHEN len(k) > 0 THEN len(list_intersect(k, w)) / len(k) ELSE 0 END, 6) AS recall FROM q CROSS JOIN c""")
def keyword_recall(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "benchmark").select("item_id", F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w) >= 6)).alias("k"))
    seen = table(spark, sf, "conversations").select(F.explode(F.split(F.lower("text"), " ")).alias("w")).distinct().withColumn("hit", F.lit(1))
    x = q.select("item_id", F.explode_outer("k").alias("w")).join(seen, "w", "left")
    g = x.groupBy("item_id").agg(F.count("w").alias("keywords"), F.count("hit").alias("found"))
    return g.withColumn("recall", F.round(F.when(F.col("keywords") > 0, F.col("found") / F.col("keywords")).otherwise(0.0), 6))


@query("N01 N04 N05 N06 T06", """
SELECT conv_id AS session_id, count(*) FILTER (role = 'user') AS queries, count(*) FILTER (role = 'assistant') AS answers, max(turn) AS last_turn,
  arg_max(role, turn) AS last_role, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY ALL""")
def session_context(spark: SparkSession, sf: str) -> DataFrame:
    role = F.col("role")
    return table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(
        F.count_if(role == "user").alias("queries"), F.count_if(role == "assistant").alias("answers"), F.max("turn").alias("last_turn"),
        F.max_by("role", "turn").alias("last_role"), F.sum(F.length("text")).alias("chars"),
    )


@query("N05 N06", """
SELECT q.conv_id, q.turn AS question, min(a.turn) AS answer, length(any_value(q.text)) AS asked FROM conversations q
LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.role = 'assistant' AND a.turn > q.turn WHERE q.role = 'user' GROUP BY q.conv_id, q.turn""")
def query_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Each question and the next answer of its conversation, in one pass over it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    answer = F.first(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(w)
    c = table(spark, sf, "conversations").withColumn("answer", answer).where("role = 'user'")
    return c.select("conv_id", F.col("turn").alias("question"), "answer", F.length("text").cast("bigint").alias("asked"))


@query("N07 S26", """
WITH s AS (SELECT conv_id, max(turn) < 3 AS expired FROM conversations GROUP BY conv_id)
SELECT expired, count(DISTINCT s.conv_id) AS sessions, count(*) AS turns, count(*) FILTER (role = 'user') AS queries FROM s JOIN conversations USING (conv_id) GROUP BY ALL""")
def expired_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """What a clean-up would take with it (a dry run)."""
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg((F.max("turn") < 3).alias("expired"), F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("queries"))
    return g.groupBy("expired").agg(F.count("*").alias("sessions"), F.sum("turns").alias("turns"), F.sum("queries").alias("queries"))


@query("N08 A02", """
SELECT quality AS rating, count(*) AS total, count(*) FILTER (toxic = 1) AS flagged, round(avg(n_chars), 6) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def feedback_stats(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return f.groupBy(F.col("quality").alias("rating")).agg(F.count("*").alias("total"), F.count_if(F.col("toxic") == 1).alias("flagged"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("S23 S25 S22", "SELECT 'documents' AS store, count(*) AS n FROM documents UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'sessions', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'jobs', count(*) FROM events UNION ALL SELECT 'failures', count(*) FROM events WHERE event_type = 'error'")
def store_inventory(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda name, df, n=F.count("*"): df.agg(F.lit(name).alias("store"), n.alias("n"))
    e = table(spark, sf, "events")
    return (
        one("documents", table(spark, sf, "documents")).union(one("vectors", table(spark, sf, "embeddings")))
        .union(one("sessions", table(spark, sf, "conversations"), F.count_distinct("conv_id"))).union(one("jobs", e))
        .union(one("failures", e.where("event_type = 'error'")))
    )


@query("D17 S27", """
SELECT user_id, count(*) AS events, max(ts) AS last, arg_max(event_type, (ts, event_id)) AS stage, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 6)::DOUBLE AS percent FROM events GROUP BY ALL""")
def latest_progress(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(
        F.count("*").alias("events"), F.max("ts").alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"),
        F.round(100.0 * F.count_if(F.col("event_type") != "error") / F.count("*"), 6).alias("percent"),
    )


@query("J10 J11 J16 S24", """
SELECT a.p_partkey AS id, count(*) AS same_title, count(*) FILTER (a.p_brand = b.p_brand) AS same_brand FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) GROUP BY ALL""")
def title_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Titles matched whatever their case; counted by title first, not as pairs."""
    p = table(spark, sf, "part").select("p_partkey", "p_brand", F.lower("p_name").alias("title"))
    by_title = p.groupBy("title").agg(F.count("*").alias("same_title"))
    by_brand = p.groupBy("title", "p_brand").agg(F.count("*").alias("same_brand"))
    return p.join(by_title, "title").join(by_brand, ["title", "p_brand"]).select(F.col("p_partkey").alias("id"), "same_title", "same_brand")


@query("J18 V18", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.label <> b.label
WHERE a.vec_id % 100 = 0 AND round(list_cosine_similarity(a.v, b.v), 9) >= 0.25""")
def cross_document_similarity(spark: SparkSession, sf: str) -> DataFrame:
    from inkfathom.plans.search import asked, rows

    r = rows(spark, sf)
    found = search.knn(r, asked(spark, sf), None, least=0.25, unlike=True)
    return found.select("query_id", "id", F.round("score", 6).alias("score"))
