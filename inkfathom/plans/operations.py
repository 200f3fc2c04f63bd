"""Queries of templates, guards, learning, registries, health, evaluation and graph repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfathom.functions import scalars as S
from inkfathom.operators import graph, guards, learning, search
from inkfathom.plans.graph import PLACE_SQL, place
from inkfathom.plans.search import fields_sql, rankings, rows, with_document
from inkfathom.registry import query
from inkfathom.sources.adapters import chunks, entities, graph_chunks, mentions, references, table, with_views

_STATEMENT = """concat('MATCH (n:Doc {id: ''', conv_id % 3, ''', kind: "', role, '"}) WHERE n.turn > ', turn, ' RETURN n.', CASE WHEN conv_id % 2 = 0 THEN 'text' ELSE 'role' END)"""


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """A graph statement, a rating and a text for each turn."""
    c = table(spark, sf, "conversations")
    n = lambda c: c.cast("string")
    lit = F.lit
    s = F.concat(
        lit("MATCH (n:Doc {id: '"), n(F.col("conv_id") % 3), lit("', kind: \""), F.col("role"), lit('"}) WHERE n.turn > '), n(F.col("turn")), lit(" RETURN n."),
        F.when(F.col("conv_id") % 2 == 0, "text").otherwise("role"),
    )
    return c.select("conv_id", "turn", "role", "text", s.alias("statement"), F.when(F.col("turn") % 3 != 0, F.col("turn") % 5 / 4.0).alias("rating"))


_PATTERN = f"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_STATEMENT}, '''[^'']*''', '$STR', 'g'), '"[^"]*"', '$STR', 'g'), '\\b\\d+\\b', '$NUM', 'g'), '\\((\\w+):', '($VAR:', 'g'), '-\\[(\\w+):', '-[$VAR:', 'g'), '\\s+', ' ', 'g'))"""


@query("C30 N10 A16", f"""
WITH s AS (SELECT role, {_PATTERN} AS pattern, CASE WHEN turn % 3 <> 0 THEN turn % 5 / 4.0 END AS rating FROM conversations),
g AS (SELECT role AS intent, pattern, count(*) AS frequency, avg(rating) AS mean FROM s GROUP BY ALL HAVING count(*) >= 5),
k AS (SELECT *, least(1.0, frequency / 10.0) * coalesce(mean, 1.0) AS confidence FROM g WHERE mean IS NULL OR mean >= 0.45)
SELECT intent, pattern, frequency, round(mean, 6) AS rating, round(confidence, 6)::DOUBLE AS confidence FROM k ORDER BY round(confidence, 6) DESC, frequency DESC, intent, pattern LIMIT 10""")
def rated_template_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """Statements that come often and are liked, with their literals and variables put aside."""
    s = statements(spark, sf).select(F.col("role").alias("intent"), "rating", learning.statement_pattern(F.col("statement")).alias("pattern"))
    return learning.suggest_templates(s, least=5, liked=0.45, most=10)


@query("C30 N11", f"""
WITH s AS (SELECT {_STATEMENT} AS s, length(text) AS ms FROM conversations),
a AS (SELECT 'Doc' AS label, unnest(['id', 'kind']) AS prop, ms FROM s UNION ALL SELECT 'Doc', 'turn', ms FROM s UNION ALL SELECT 'Doc', regexp_extract(s, 'RETURN n\\.(\\w+)', 1), ms FROM s)
SELECT label, prop, count(*) AS frequency, round(avg(ms), 6) AS mean_ms, round(sum(ms), 3)::DOUBLE AS benefit FROM a GROUP BY ALL""")
def property_accesses(spark: SparkSession, sf: str) -> DataFrame:
    """Which properties of which labels statements read, how often and how slowly."""
    s = statements(spark, sf)
    a = s.select(F.inline(learning.property_accesses(F.col("statement"))), F.length("text").alias("ms"))
    return a.groupBy("label", "prop").agg(F.count("*").alias("frequency"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.round(F.sum("ms"), 3).cast("double").alias("benefit"))


@query("D15 D16", """
WITH s AS (SELECT conv_id, turn, length(text) AS ms, left(sha256(trim(regexp_replace(regexp_replace(text, '--[^\\n]*', '', 'g'), '\\s+', ' ', 'g'))), 16) AS fingerprint FROM conversations WHERE length(text) >= 100),
t AS (SELECT * FROM s ORDER BY ms DESC, conv_id, turn LIMIT 50),
d AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY ms DESC, conv_id, turn) AS n FROM t)
SELECT conv_id, turn, CAST(ms AS BIGINT) AS ms, fingerprint FROM d WHERE n = 1""")
def slow_queries(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty slowest of at least 100 ms (a text's length), one of each fingerprint."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("ms"), "text")
    return learning.slow_queries(c, "text", "ms", ["conv_id", "turn"], 100, 50).select("conv_id", "turn", "ms", "fingerprint")


@query("D17", """
WITH r(name, dims, model, active) AS (VALUES ('main', 64, 'm1', true), ('old', 32, 'm1', false), ('other', 64, 'm2', false)),
v AS (SELECT CASE vec_id % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'old' ELSE 'gone' END AS name, CASE WHEN vec_id % 6 = 0 THEN 'm2' ELSE 'm1' END AS model, len(embedding) AS dims FROM embeddings)
SELECT v.name, v.model, count(*) AS vectors, CASE WHEN r.name IS NULL THEN 'unknown' WHEN r.dims <> v.dims THEN 'dims' WHEN r.model <> v.model THEN 'model' ELSE 'ok' END AS status FROM v LEFT JOIN r USING (name) GROUP BY ALL""")
def index_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors against the indexes they are meant for: unknown, of other dims (refused), by another model (a warning)."""
    reg = learning.Registry(spark)
    reg.register("main", 64, "m1", active=True)
    reg.register("old", 32, "m1")
    reg.register("other", 64, "m2")
    i = F.col("vec_id")
    v = table(spark, sf, "embeddings").select(
        F.when(i % 3 == 0, "main").when(i % 3 == 1, "old").otherwise("gone").alias("name"), F.when(i % 6 == 0, "m2").otherwise("m1").alias("model"), F.size("embedding").alias("dims")
    )
    return reg.compatibility(v)


@query("D14", """
SELECT 'documents' AS check, count(*) > 0 AS ok, count(*) AS n FROM documents UNION ALL SELECT 'unique ids', count(*) = count(DISTINCT doc_id), count(*) - count(DISTINCT doc_id) FROM documents
UNION ALL SELECT 'vector size', count(*) FILTER (len(embedding) <> 64) = 0, count(*) FILTER (len(embedding) <> 64) FROM embeddings
UNION ALL SELECT 'labels known', count(*) FILTER (d.doc_id IS NULL) = 0, count(*) FILTER (d.doc_id IS NULL) FROM labels LEFT JOIN documents d USING (doc_id)
UNION ALL SELECT 'recent events', max(ts) >= TIMESTAMP '2024-01-15', count(*) FILTER (ts >= TIMESTAMP '2024-01-15') FROM events""")
def health_checks(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each check of the stores."""
    d, e = table(spark, sf, "documents"), table(spark, sf, "events")
    one = lambda df, name, ok, n: df.agg(F.lit(name).alias("check"), ok.alias("ok"), n.cast("bigint").alias("n"))
    total = F.count("*")
    again = total - F.count_distinct("doc_id")
    wrong = F.count_if(F.size("embedding") != 64)
    known = table(spark, sf, "labels").join(d.select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    lost, new = F.count_if(F.col("known").isNull()), F.col("ts") >= "2024-01-15"
    return (
        one(d, "documents", total > 0, total).union(one(d, "unique ids", again == 0, again)).union(one(table(spark, sf, "embeddings"), "vector size", wrong == 0, wrong))
        .union(one(known, "labels known", lost == 0, lost)).union(one(e, "recent events", F.coalesce(F.bool_or(new), F.lit(False)), F.count_if(new)))
    )


@query("M03", fields_sql("""
h AS (SELECT query_id, field AS method, rank, CASE WHEN r.document_id = (SELECT grp FROM e WHERE e.id = r.query_id) AND r.id <> r.query_id THEN 1 ELSE 0 END AS hit FROM rankings r WHERE rank <= 10),
q AS (SELECT query_id, method, avg(hit) AS precision_, coalesce(max(CASE WHEN hit = 1 THEN 1.0 / rank END), 0) AS rr FROM h GROUP BY ALL)
SELECT method, count(*) AS queries, round(avg(precision_), 6) AS mean_precision, round(avg(rr), 6)::DOUBLE AS mrr FROM q GROUP BY method"""))
def method_averages(spark: SparkSession, sf: str) -> DataFrame:
    """Precision and reciprocal rank of each field as a method of retrieval, averaged over the queries."""
    return _judged(spark, sf).groupBy("method").agg(F.count("*").alias("queries"), F.round(F.avg("precision"), 6).alias("mean_precision"), F.round(F.avg("rr"), 6).alias("mrr"))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    from inkfathom.operators.fusion import ranked

    own = rows(spark, sf).select(F.col("id").alias("query_id"), F.col("grp").alias("wanted"))
    r = with_document(ranked(rankings(spark, sf)).where("rank <= 10"), spark, sf).join(own, "query_id")
    hit = ((F.col("document_id") == F.col("wanted")) & (F.col("id") != F.col("query_id"))).cast("int")
    g = r.groupBy("query_id", F.col("field").alias("method"))
    return g.agg(F.avg(hit).alias("precision"), F.coalesce(F.max(F.when(hit == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"))


@query("M04", fields_sql("""
h AS (SELECT query_id, field AS method, rank, CASE WHEN r.document_id = (SELECT grp FROM e WHERE e.id = r.query_id) AND r.id <> r.query_id THEN 1 ELSE 0 END AS hit FROM rankings r WHERE rank <= 10),
q AS (SELECT query_id, avg(hit) AS p FROM h WHERE method = 'content' GROUP BY ALL)
SELECT CASE WHEN query_id // 100 % 3 = 0 THEN 'a' WHEN query_id // 100 % 3 = 1 THEN 'b' ELSE 'c' END AS category, count(*) AS queries, round(avg(p), 6) AS mean, round(min(p), 6) AS least, round(max(p), 6) AS most FROM q GROUP BY ALL"""))
def category_stats(spark: SparkSession, sf: str) -> DataFrame:
    k = F.floor(F.col("query_id") / 100) % 3
    q = _judged(spark, sf).where("method = 'content'").withColumn("category", F.when(k == 0, "a").when(k == 1, "b").otherwise("c"))
    p = F.col("precision")
    return q.groupBy("category").agg(F.count("*").alias("queries"), F.round(F.avg(p), 6).alias("mean"), F.round(F.min(p), 6).alias("least"), F.round(F.max(p), 6).alias("most"))


@query("A15", with_views("refs", """
l AS (SELECT c_nationkey AS batch, concat('c', c_custkey) AS id FROM customer), n AS (SELECT src, count(*) AS edges FROM refs GROUP BY src)
SELECT batch, count(*) AS documents, count(edges) AS linked, count(*) - count(edges) AS without, CAST(coalesce(sum(edges), 0) AS BIGINT) AS edges, round(coalesce(sum(edges), 0) / count(*), 6)::DOUBLE AS mean FROM l LEFT JOIN n ON src = id GROUP BY batch"""))
def linking_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What a batch of linking did: documents, those linked, edges."""
    d = table(spark, sf, "customer").select(F.col("c_nationkey").alias("batch"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"))
    n = references(spark, sf).groupBy("src").agg(F.count("*").alias("edges"))
    g = d.join(n, "src", "left").groupBy("batch")
    edges = F.coalesce(F.sum("edges"), F.lit(0))
    return g.agg(F.count("*").alias("documents"), F.count("edges").alias("linked"), (F.count("*") - F.count("edges")).alias("without"), edges.alias("edges"), F.round(edges / F.count("*"), 6).alias("mean"))


@query("A06", with_views("mentions", """
SELECT src, round(sum(confidence), 6) AS total, string_agg(dst, ' > ' ORDER BY dst) AS path FROM mentions GROUP BY src"""))
def folded_features(spark: SparkSession, sf: str) -> DataFrame:
    """Lists folded to a sum and to a path."""
    g = mentions(spark, sf).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "confidence"))).alias("l"))
    total = F.aggregate("l", F.lit(0.0), lambda s, x: s + x["confidence"])
    path = F.aggregate("l", F.lit(""), lambda s, x: F.when(s == "", x["dst"]).otherwise(F.concat(s, F.lit(" > "), x["dst"])))
    return g.select("src", F.round(total, 6).alias("total"), path.alias("path"))


@query("Q09", """
WITH p AS (SELECT p_brand AS name, string_agg(DISTINCT CAST(p_size AS BIGINT), ',' ORDER BY CAST(p_size AS BIGINT)) AS params, count(DISTINCT p_size) AS n FROM part GROUP BY ALL),
b AS (SELECT *, lead(name) OVER (ORDER BY name) AS other FROM p)
SELECT a.name AS a, c.name AS b, a.params AS params_a, c.params AS params_b, a.n AS n_a, c.n AS n_b FROM b a JOIN p c ON c.name = a.other""")
def template_compare_v2(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as commands, their sizes as parameters: each beside the next by name."""
    sizes = F.array_sort(F.collect_set(F.col("p_size").cast("bigint")))
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(sizes.alias("s"))
    p = p.select("name", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("params"), F.size("s").cast("bigint").alias("n"))
    b = p.withColumn("other", F.lead("name").over(Window.partitionBy().orderBy("name")))  # a row for each brand
    c = p.select(F.col("name").alias("other"), F.col("params").alias("params_b"), F.col("n").alias("n_b"))
    return b.join(c, "other").select(F.col("name").alias("a"), F.col("other").alias("b"), F.col("params").alias("params_a"), "params_b", F.col("n").alias("n_a"), "n_b")


@query("Q12", with_views("entities mentions", """
t AS (SELECT DISTINCT name AS term FROM entities UNION SELECT DISTINCT lower(kind) FROM entities),
h AS (SELECT DISTINCT term, id FROM t JOIN entities e ON e.name = term OR lower(e.kind) = term)
SELECT term, count(DISTINCT h.id) AS concepts, count(DISTINCT src) AS chunks, min(src) AS first FROM h LEFT JOIN mentions ON dst = h.id GROUP BY term"""))
def template_explain_v2(spark: SparkSession, sf: str) -> DataFrame:
    """A concept by its name or its term, and the chunks that mention it."""
    e = entities(spark, sf)
    h = e.select(F.col("name").alias("term"), "id").union(e.select(F.lower("kind"), "id")).distinct()
    m = mentions(spark, sf).select(F.col("dst").alias("id"), "src")
    return h.join(m, "id", "left").groupBy("term").agg(F.count_distinct("id").alias("concepts"), F.count_distinct("src").alias("chunks"), F.min("src").alias("first"))


@query("Q22", with_views("entities", """
n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY size, id) AS n FROM entities)
SELECT a.id AS a, b.id AS b, a.label, a.name AS name_a, b.name AS name_b, a.kind AS kind_a, b.kind AS kind_b, a.size AS size_a, b.size AS size_b FROM n a JOIN n b ON a.label = b.label AND b.n = a.n + 1"""))
def template_comparison_v1(spark: SparkSession, sf: str) -> DataFrame:
    """The properties of two entities of a type side by side: each and the next by size."""
    w = Window.partitionBy("label").orderBy("size", "id")
    e = entities(spark, sf)
    after = {c: F.lead(c).over(w).alias(f"{c}_b") for c in ("name", "kind", "size")}
    both = e.select(F.col("id").alias("a"), F.lead("id").over(w).alias("b"), "label", *(F.col(c).alias(f"{c}_a") for c in after), *after.values())
    return both.where("b is not null")


@query("Q24", """
WITH st AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), r AS (SELECT s, p, row_number() OVER (PARTITION BY s ORDER BY p) AS n, count(*) OVER (PARTITION BY s) AS total FROM st),
l AS (SELECT s, string_agg(p, ',' ORDER BY p) AS steps, any_value(total) AS total FROM r WHERE n <= 5 GROUP BY s),
x AS (SELECT s_nationkey AS k, s, steps, total, row_number() OVER (PARTITION BY s_nationkey ORDER BY s) AS n FROM l JOIN supplier ON s_suppkey = s)
SELECT a.s AS a, b.s AS b, a.steps AS steps_a, b.steps AS steps_b, abs(a.total - b.total) AS difference FROM x a JOIN x b ON a.k = b.k AND b.n = a.n + 1""")
def template_comparison_v3(spark: SparkSession, sf: str) -> DataFrame:
    """The first steps of two procedures and how much their numbers differ: suppliers of a nation, each and the next."""
    st = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    w = Window.partitionBy("s").orderBy("p")
    r = st.withColumn("n", F.row_number().over(w)).withColumn("total", F.count("*").over(Window.partitionBy("s"))).where("n <= 5")
    steps = r.groupBy("s").agg(F.sort_array(F.collect_list("p")).alias("l"), F.first("total").alias("total"))
    x = steps.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("k")), "s")
    x = x.select("k", "s", F.array_join(F.transform("l", lambda p: p.cast("string")), ",").alias("steps"), "total")
    at = Window.partitionBy("k").orderBy("s")
    both = x.select(F.col("s").alias("a"), F.lead("s").over(at).alias("b"), F.col("steps").alias("steps_a"), F.lead("steps").over(at).alias("steps_b"), F.abs(F.col("total") - F.lead("total").over(at)).alias("difference"))
    return both.where("b is not null")


@query("Q32 P20 L04", """
WITH r AS (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'dependency_chain' WHEN 1 THEN 'impact_assessment' ELSE 'comparison' END AS template, turn + 1 AS depth, 40 * (turn + 1) AS results,
  CASE WHEN conv_id % 5 = 0 THEN 'AFFECTS' ELSE 'MENTIONS' END AS rel FROM conversations),
g(template, max_depth, max_results) AS (VALUES ('dependency_chain', 5, 100), ('impact_assessment', 3, 100), ('comparison', 2, 100))
SELECT conv_id, turn, template, least(depth, max_depth) AS depth, least(results, max_results) AS results, CASE WHEN rel = 'AFFECTS' THEN 'refused' WHEN depth > max_depth OR results > max_results THEN 'clamped' ELSE 'ok' END AS verdict FROM r JOIN g USING (template)""")
def guarded_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests held to their template's limits."""
    i = F.col("conv_id")
    r = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(i % 3 == 0, "dependency_chain").when(i % 3 == 1, "impact_assessment").otherwise("comparison").alias("template"),
        (F.col("turn") + 1).alias("depth"), (40 * (F.col("turn") + 1)).alias("results"), F.when(i % 5 == 0, "AFFECTS").otherwise("MENTIONS").alias("rel"),
    )
    return guards.guarded(r).drop("rel")


@query("C32 T13", """
SELECT user_id, event_id, left(sha256(concat('{"kind":"', event_type, '","user":', user_id, '}', '|v2:', event_id % 3)), 16) AS key FROM events""")
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of cached answers; an epoch in the version makes old ones unreachable."""
    values = F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"))
    version = F.concat(F.lit("v2:"), (F.col("event_id") % 3).cast("string"))
    return table(spark, sf, "events").select("user_id", "event_id", S.cache_key(values, version).alias("key"))


@query("G33 J19", with_views("entities", """
t AS (SELECT ['CONTAINS_STEP', 'REFERENCES', 'CONFIGURES', 'RESOLVES', 'AFFECTS', 'MENTIONS'][l_linenumber % 6 + 1] AS type, l_suppkey AS src, concat('p', l_partkey) AS dst FROM lineitem),
e AS (SELECT id FROM entities WHERE size <= 40)
SELECT type, count(*) FILTER (e.id IS NOT NULL AND type IN ('CONTAINS_STEP', 'REFERENCES', 'CONFIGURES', 'RESOLVES')) AS created,
  count(*) FILTER (e.id IS NULL AND type IN ('CONTAINS_STEP', 'REFERENCES', 'CONFIGURES', 'RESOLVES')) AS missing, count(*) FILTER (type IN ('AFFECTS', 'MENTIONS')) AS refused
FROM (SELECT DISTINCT * FROM t) t LEFT JOIN e ON e.id = t.dst GROUP BY type"""))
def relation_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Relations between entities: made where the type is allowed and the ends exist."""
    names = F.array(*map(F.lit, ("CONTAINS_STEP", "REFERENCES", "CONFIGURES", "RESOLVES", "AFFECTS", "MENTIONS")))
    t = table(spark, sf, "lineitem").select(
        F.element_at(names, F.col("l_linenumber") % 6 + 1).alias("type"), F.col("l_suppkey").alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")
    )
    return graph.relation_outcomes(t, entities(spark, sf).where("size <= 40").select(F.col("id").alias("dst")))


@query("G09", f"""
WITH RECURSIVE {PLACE_SQL}, two AS (SELECT src, dst FROM place UNION SELECT dst, src FROM place),
s AS (SELECT concat('s', s_suppkey) AS id FROM supplier ORDER BY s_nationkey, s_suppkey LIMIT 5),
p(a, node, path, d) AS (SELECT id, id, [id], 0 FROM s UNION ALL SELECT a, dst, list_append(path, dst), d + 1 FROM p JOIN two ON node = src WHERE d < 3 AND NOT list_contains(path, dst)),
e AS (SELECT a, node AS b, d, min(array_to_string(path, '>')) AS path FROM p JOIN s ON s.id = node WHERE a < node GROUP BY ALL),
m AS (SELECT * FROM (SELECT *, min(d) OVER (PARTITION BY a, b) AS least FROM e) WHERE d = least)
SELECT * FROM (SELECT node, min(d) AS distance, CAST(0.3 AS DOUBLE) AS score FROM (SELECT unnest(string_split(path, '>')) AS node, d FROM m) WHERE node NOT IN (SELECT id FROM s) GROUP BY node) ORDER BY distance, node LIMIT 30""")
def connecting_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes on the shortest paths of at most three steps between the first five suppliers by nation."""
    top = table(spark, sf, "supplier").orderBy("s_nationkey", "s_suppkey").limit(5).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return graph.connecting_nodes(place(spark, sf), top, 3, 30).withColumn("score", F.lit(0.3))


@query("G14 J06 F09", with_views("graph_chunks mentions entities", """
seeds AS (SELECT * FROM graph_chunks WHERE key % 100 = 0),
heads AS (SELECT document_id, heading, min_by(chunk_id, (ord, key)) AS head, min_by(status, (ord, key)) AS head_status FROM graph_chunks GROUP BY ALL),
sib AS (SELECT s.chunk_id AS seed, c.chunk_id AS node, row_number() OVER (PARTITION BY s.chunk_id ORDER BY c.ord, c.key) AS n
  FROM seeds s JOIN graph_chunks c ON s.document_id = c.document_id AND s.heading = c.heading WHERE c.key % 100 <> 0),
par AS (SELECT s.chunk_id AS seed, c.chunk_id AS node, row_number() OVER (PARTITION BY s.chunk_id ORDER BY c.ord, c.key) AS n
  FROM seeds s JOIN heads h ON h.document_id = s.document_id AND h.heading = s.heading AND h.head <> s.chunk_id JOIN graph_chunks c ON c.document_id = s.document_id AND c.status = h.head_status AND c.chunk_id <> s.chunk_id),
own AS (SELECT m.src AS seed, m.dst, row_number() OVER (PARTITION BY m.src ORDER BY m.dst) AS n FROM mentions m JOIN seeds s ON m.src = s.chunk_id JOIN entities e ON e.id = m.dst WHERE length(e.name) >= 4),
sh AS (SELECT o.seed, m.src AS node, count(DISTINCT m.dst) AS k FROM own o JOIN mentions m ON m.dst = o.dst WHERE o.n <= 5 AND m.src NOT IN (SELECT chunk_id FROM seeds) GROUP BY ALL),
shr AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY k DESC, node) AS n FROM sh),
u AS (SELECT seed, node, 1 AS kind FROM sib WHERE n <= 3 UNION ALL SELECT seed, node, 2 FROM par WHERE n <= 2 UNION ALL SELECT seed, node, 3 FROM shr WHERE n <= 3)
SELECT seed, node, ['sibling', 'parent_section', 'shared_entities'][min(kind)] AS via FROM u GROUP BY ALL"""))
def structure_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Siblings, chunks of the parent's section and chunks that share entities, at most 3, 2 and 3 a seed, each once."""
    c = graph_chunks(spark, sf)
    seed = F.col("key") % 100 == 0
    s = c.where(seed).select(F.col("chunk_id").alias("seed"), "document_id", "heading")
    sib = search.top_k(s.join(c.where(~seed), ["document_id", "heading"]), "seed", ["ord", "key"], 3)
    first = F.struct("ord", "key")
    heads = c.groupBy("document_id", "heading").agg(F.min_by("chunk_id", first).alias("head"), F.min_by("status", first).alias("status"))
    par = s.join(heads, ["document_id", "heading"]).where("head <> seed").select("seed", "document_id", "status").join(c, ["document_id", "status"]).where("chunk_id <> seed")
    par = search.top_k(par, "seed", ["ord", "key"], 2)
    m = mentions(spark, sf)
    named = entities(spark, sf).where("length(name) >= 4").select(F.col("id").alias("dst"))
    own = m.join(s.select(F.col("seed").alias("src")), "src", "left_semi").join(named, "dst", "left_semi").select(F.col("src").alias("seed"), "dst")
    own = search.top_k(own, "seed", ["dst"], 5).select("seed", "dst")
    others = m.join(s.select(F.col("seed").alias("src")), "src", "left_anti").select("dst", F.col("src").alias("node"))
    sh = own.join(others, "dst").groupBy("seed", "node").agg(F.count_distinct("dst").alias("k"))
    sh = search.top_k(sh, "seed", [F.desc("k"), "node"], 3)
    shape = lambda d, node, kind: d.select("seed", F.col(node).alias("node"), F.lit(kind).alias("kind"))
    u = shape(sib, "chunk_id", 1).unionByName(shape(par, "chunk_id", 2)).unionByName(shape(sh, "node", 3))
    via = F.element_at(F.array(*map(F.lit, ("sibling", "parent_section", "shared_entities"))), F.min("kind"))
    return u.groupBy("seed", "node").agg(via.alias("via"))


@query("G37", """
WITH e AS (SELECT vec_id // 3 AS doc, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT DISTINCT doc FROM e),
x AS (SELECT doc AS src, unnest([doc + 1, doc + 2, doc + 1000000]) AS dst FROM d),
p AS (SELECT x.src, x.dst, q.vec_id, max(list_dot_product(q.v, t.v) / ((sqrt(list_dot_product(q.v, q.v)) + 1e-9) * (sqrt(list_dot_product(t.v, t.v)) + 1e-9))) AS c FROM x JOIN e q ON q.doc = x.src JOIN e t ON t.doc = x.dst GROUP BY ALL),
m AS (SELECT src, dst, round(avg(c), 6) AS score FROM p GROUP BY ALL)
SELECT x.src, x.dst, score, coalesce(score >= 0.1, true) AS kept FROM x LEFT JOIN m USING (src, dst)""")
def pruned_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between documents by late interaction of their vectors; one without vectors stays."""
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("doc"), F.col("embedding").cast("array<double>").alias("v"))
    m = e.groupBy("doc").agg(F.collect_list("v").alias("m"))
    doc = F.col("doc")
    x = m.select(doc.alias("src"), F.explode(F.array(doc + 1, doc + 2, doc + 1000000)).alias("dst"))
    return graph.prune_edges(x, m, 0.1)


@query("X10", with_views("chunks", """
r AS (SELECT document_id, ord, ord % 3 AS phase, token_count, octet_length(encode(text)) AS bytes FROM chunks),
s AS (SELECT *, sum(token_count) OVER d AS t, sum(bytes) OVER d AS b, sum(token_count) OVER p AS pt, sum(bytes) OVER p AS pb FROM r
  WINDOW d AS (PARTITION BY document_id ORDER BY ord ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY document_id, phase ORDER BY ord ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, min(CASE WHEN t > 500 OR b > 4000 OR pt > [250, 150, 100][phase + 1] OR pb > [2000, 1200, 800][phase + 1] THEN ord END) OVER (PARTITION BY document_id) AS stop FROM s)
SELECT document_id, ord, phase, CAST(pt AS BIGINT) AS phase_tokens, CAST(pb AS BIGINT) AS phase_bytes FROM o WHERE stop IS NULL OR ord < stop"""))
def phase_budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that fit their phase's share of the tokens and bytes, up to the first that does not."""
    from inkfathom.operators.context import phase_budget

    c = chunks(spark, sf).select("document_id", "ord", (F.col("ord") % 3).alias("phase"), "token_count", F.octet_length("text").alias("bytes"))
    kept = phase_budget(c, "document_id", "ord", "phase", "token_count", "bytes", 500, 4000, {0: 0.5, 1: 0.3, 2: 0.2})
    return kept.select("document_id", "ord", "phase", "phase_tokens", "phase_bytes")
