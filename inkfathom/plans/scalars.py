"""Queries of the scalar functions and of the five-signal ranker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.functions import scalars as S
from inkfathom.operators import context, ingest
from inkfathom.registry import query
from inkfathom.sources.adapters import chunks, mentions, table, with_views

_Q = """
q AS (SELECT item_id, concat(CASE item_id % 8 WHEN 0 THEN 'run cli command ' WHEN 1 THEN 'config a=b ' WHEN 2 THEN 'how to ' WHEN 3 THEN 'error E123 on node ' WHEN 4 THEN 'what is ' WHEN 5 THEN 'compare fs list versus ' ELSE '' END, text) AS text FROM benchmark)"""


def asked(spark: SparkSession, sf: str) -> DataFrame:
    heads = ("run cli command ", "config a=b ", "how to ", "error E123 on node ", "what is ", "compare fs list versus ", "", "")
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("item_id") % 8 + 1).cast("int"))
    return table(spark, sf, "benchmark").select("item_id", F.concat(head, "text").alias("text"))


def _sum(patterns, low: str = "low") -> str:
    return " + ".join(f"CAST(regexp_matches({low}, '{p}') AS INTEGER)" for p in patterns)


def _any(words) -> str:
    return " OR ".join(f"contains(low, '{w}')" for w in words)


@query("C01", f"""
WITH {_Q.strip()}, l AS (SELECT item_id, lower(text) AS low FROM q)
SELECT item_id, CASE WHEN {_sum(S.CLI)} >= 2 THEN 'cli' WHEN {_sum(S.CONFIG)} > 0 THEN 'config' WHEN {_any(S.PHRASES[0][1])} THEN 'procedural'
  WHEN {_any(S.PHRASES[1][1])} THEN 'troubleshooting' WHEN {_any(S.PHRASES[2][1])} THEN 'reference' ELSE 'conceptual' END AS kind FROM l""")
def classify_query_type(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("item_id", S.query_type(F.col("text")).alias("kind"))


@query("C02 Q31", f"""
WITH {_Q.strip()}, l AS (SELECT item_id, lower(text) AS low FROM q), s AS (SELECT item_id, {', '.join(f'{_sum(ps)} AS {n}' for n, ps in S.INTENTS.items())} FROM l),
b AS (SELECT *, greatest({', '.join(S.INTENTS)}) AS best FROM s)
SELECT item_id, CASE {' '.join(f"WHEN {n} = best THEN '{n}'" for n in S.INTENTS)} END AS intent FROM b""")
def intent_scores(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("item_id", S.intent(F.col("text")).alias("intent"))


@query("C03 P10 E07", f"""
WITH {_Q.strip()} SELECT item_id, {', '.join(f"nullif(regexp_extract({'lower(text)' if low else 'text'}, '({p})', 1), '') AS {n}" for n, p, low in S.LINKS)} FROM q""")
def linked_entities(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("item_id", *(c.alias(n) for n, c in S.linked(F.col("text")).items()))


def _among(words) -> str:
    return "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in words) + ")))"


@query("C04", f"""
WITH c AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, NOT (length(trim(text)) < 10 OR len(w) < 3 OR w[1] IN ({', '.join(f"'{x}'" for x in S.QUESTION)}) OR contains(text, '?')
  OR ({_among(S.FUNCTION)} / len(w) > 0.15 AND {_among(S.VERBS)} > 0) OR len(w) <= 4) AS rewritten FROM c""")
def keyword_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", (S.rewrite_keywords(F.col("text")) != F.col("text")).alias("rewritten"))


@query("C17", """
WITH v AS (SELECT event_id, value / 50 - 1 AS x FROM events)
SELECT event_id, round((greatest(-1, least(1, x)) + 1) / 2, 6) AS cosine, round(1 - greatest(0, least(2, x)) / 2, 6) AS distance, round(1 / (1 + exp(-x)), 6) AS dot,
  round(tanh(greatest(0, x) / 10), 6) AS colbert, round(greatest(0, least(1, x * 50)), 6) AS rrf FROM v""")
def normalise_scores(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("value") / 50 - 1
    kinds = ("cosine", "distance", "dot", "colbert", "rrf")
    return table(spark, sf, "events").select("event_id", *(F.round(S.normalise_score(x, k), 6).alias(k) for k in kinds))


@query("C18 C19 C20 C21 R04 L03", """
WITH o AS (SELECT o_orderkey AS id, o_custkey AS g, o_totalprice / 500000 * 2 - 1 AS x, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 100000 - 2 END AS rerank,
  o_orderkey % 4 AS distance, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS ts, CASE o_orderstatus WHEN 'F' THEN 'Procedure' WHEN 'O' THEN 'Concept' ELSE 'Other' END AS label,
  o_orderkey % 30 AS m, o_custkey % 5 AS c FROM orders),
f AS (SELECT *, (greatest(-1, least(1, x)) + 1) / 2 AS recall, CASE WHEN rerank IS NULL THEN 0 ELSE 1 / (1 + exp(-rerank)) END AS p,
  CASE WHEN ts IS NULL THEN 0.5::DOUBLE ELSE greatest(0, least(1, exp(-floor((epoch(TIMESTAMP '2003-01-01') - epoch(ts)) / 86400) / 365.0))) END AS recency,
  CASE label WHEN 'Procedure' THEN 1.0 WHEN 'Concept' THEN 0.7 ELSE 0.5 END AS priority,
  least(1.0::DOUBLE, 0.5 + CASE WHEN m > 0 THEN least(0.3::DOUBLE, ln(m + 1) / 10) ELSE 0 END + CASE WHEN c > 0 THEN least(0.2::DOUBLE, ln(c + 1) / 10) ELSE 0 END) AS coverage FROM o),
s AS (SELECT *, CASE WHEN rerank IS NOT NULL AND p < 0.2 THEN 0 ELSE 0.4 * recall + 0.4 * p + 0.2 * exp(-0.5 * distance) + 0.15 * recency + 0.15 * priority + 0.1 * coverage END AS score FROM f)
SELECT id, g, round(score, 6) AS score, row_number() OVER (PARTITION BY g ORDER BY round(score, 6) DESC, priority DESC, id) AS rank FROM s""")
def rank_five_signal(spark: SparkSession, sf: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    now = F.lit("2003-01-01").cast("timestamp")
    status = F.col("o_orderstatus")
    o = table(spark, sf, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("g"), S.normalise_score(price / 500000 * 2 - 1, "cosine").alias("recall"),
        F.when(key % 3 != 0, price / 100000 - 2).alias("rerank"), (key % 4).alias("distance"),
        S.recency_score([F.when(status != "P", F.col("o_orderdate"))], now).alias("recency"),
        F.when(status == "F", "Procedure").when(status == "O", "Concept").otherwise("Other").alias("label"),
        S.coverage_score(key % 30, F.col("o_custkey") % 5).alias("coverage"),
    )
    c = F.col
    score = S.final_score(c("recall"), c("rerank"), c("distance"), c("recency"), S.label_priority(c("label")), c("coverage"))
    ranked = S.rank_results(o.withColumn("score", score), "g", "score", "label", "id")
    return ranked.select("id", "g", F.round("score", 6).alias("score"), "rank")


@query("C12 S03", with_views("chunks", """
SELECT document_id, sha256(string_agg(text, chr(10) ORDER BY ord)) AS text_hash, count(*) AS chunks FROM chunks GROUP BY ALL"""))
def text_hash(spark: SparkSession, sf: str) -> DataFrame:
    from inkfathom.operators.context import joined_text

    c = chunks(spark, sf)
    n = c.groupBy("document_id").agg(F.count("*").alias("chunks"))
    return joined_text(c, "document_id", ["ord"], "text", "\n").join(n, "document_id").select("document_id", F.sha2("context", 256).alias("text_hash"), "chunks")


@query("C12", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, sha256(array_to_string(list_transform(generate_series(1, least(64, greatest(1, len(w) - 7))), lambda i: array_to_string(w[i : i + 7], ' ')), '||')) AS h FROM w""")
def shingle_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", S.shingle_hash(F.col("text")).alias("h"))


@query("C33 C32 P22", """
SELECT page_id, sha256(lower(trim(url))) AS document_id, sha256(concat(url, '#section|', sha256(trim(regexp_replace(html, '\\s+', ' ', 'g'))))) AS section_id,
  sha256(concat_ws('|', sha256(lower(trim(url))), 'a', 'b')) AS chunk_id FROM pages""")
def identity_hashes(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", S.document_id(url).alias("document_id"),
        S.section_id(url, F.lit("section"), F.sha2(S.normal_text(F.col("html")), 256)).alias("section_id"),
        S.chunk_id(S.document_id(url), F.array(F.lit("a"), F.lit("b"))).alias("chunk_id"),
    )


@query("C08 C09 C10 G24", """
SELECT page_id, array_to_string(string_split(url, '/')[1:4], '/') AS prefix, len(string_split(url, '/')) AS depth, concat('[Section: ', replace(split_part(url, '://', 2), '/', ' > '), ']') AS context,
  array_to_string(list_filter(list_transform(string_split(regexp_replace(concat('<a>', replace(url, '/', ' >')), '<[^>]+>', '', 'g'), '>'), lambda p: trim(p)), lambda p: p <> ''), ' > ') AS path FROM pages""")
def path_functions(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", S.path_prefix(url, 4).alias("prefix"), F.size(F.split(url, "/")).cast("bigint").alias("depth"),
        F.concat(F.lit("[Section: "), F.replace(F.split_part(url, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(" > ")), F.lit("]")).alias("context"),
        S.normal_path(F.concat(F.lit("<a>"), F.replace(url, F.lit("/"), F.lit(" >")))).alias("path"),
    )


@query("C07", """
WITH n AS (SELECT page_id, regexp_replace(regexp_extract(split_part(url, '#', 1), '([^/]*)$', 1), '(?i)\\.md$', '') AS b FROM pages)
SELECT page_id, array_to_string(list_transform(list_filter(regexp_split_to_array(b, '[-_]+'), lambda w: w <> ''), lambda w: CASE WHEN w = lower(w) THEN concat(upper(w[1]), w[2:]) ELSE w END), ' ') AS title FROM n""")
def filename_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", S.filename_title(F.col("url")).alias("title"))


@query("C22 C34", """
SELECT o_orderkey AS id, round(0.3 * least(1, o_totalprice / 500000) + 0.2 * least(1, (o_orderkey % 7) / 5.0) + 0.2 * least(1, (o_orderkey % 3) / 2.0) + 0.3 * (o_custkey % 2), 9)::DOUBLE AS confidence FROM orders""")
def answer_confidence(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    c = S.confidence(F.col("o_totalprice") / 500000, k % 7 / 5.0, k % 3 / 2.0, F.col("o_custkey") % 2)
    return table(spark, sf, "orders").select(k.alias("id"), F.round(c, 9).alias("confidence"))


@query("C23 C24 X04", """
WITH l AS (SELECT l_orderkey AS id, lower(l_returnflag || l_linestatus) AS k, l_returnflag || l_linestatus AS title, l_linenumber - 1 AS o, CAST(l_quantity AS INTEGER) % 4 AS lev FROM lineitem),
d AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY o, lev, title) AS n FROM l WHERE o > 0)
SELECT id, string_agg(title, ';' ORDER BY o, lev, k, title) AS labels FROM d WHERE n = 1 GROUP BY id""")
def citation_labels(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    one = F.struct(
        (F.col("l_linenumber") - 1).cast("int").alias("order"), F.concat("l_returnflag", "l_linestatus").alias("title"),
        (F.col("l_quantity").cast("int") % 4).alias("level"),
    )
    g = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(one).alias("l"))
    kept = g.select("id", context.ordered_labels(F.col("l")).alias("l")).where(F.size("l") > 0)
    return kept.select("id", F.array_join(F.col("l.title"), ";").alias("labels"))


@query("C25", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events""")
def json_properties(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    parsed = F.from_json("props", "k bigint")
    return e.select("event_id", parsed["k"].alias("k"), parsed.isNotNull().alias("valid"))


@query("C26 C27 R03", """
WITH e AS (SELECT vec_id, vec_id // 3 AS doc, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT q.doc AS query_id, d.doc AS id, q.vec_id, max(list_dot_product(q.v, d.v) / ((sqrt(list_dot_product(q.v, q.v)) + 1e-9) * (sqrt(list_dot_product(d.v, d.v)) + 1e-9))) AS c, max(list_dot_product(q.v, d.v)) AS x
  FROM e q JOIN e d ON d.doc = q.doc + 1 GROUP BY ALL)
SELECT query_id, id, round(avg(c), 6) AS mean_cosine, round(sum(x) / 32, 6) AS raw_sum FROM p GROUP BY ALL""")
def max_sim(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, as a group of three vectors, against the one after it."""
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("doc"), F.col("embedding").cast("array<double>").alias("v"))
    m = e.groupBy("doc").agg(F.collect_list("v").alias("m"))
    q = m.select(F.col("doc").alias("query_id"), (F.col("doc") + 1).alias("id"), F.col("m").alias("qm"))
    both = q.join(m.select(F.col("doc").alias("id"), "m"), "id")
    return both.select(
        "query_id", "id", F.round(S.max_sim(F.col("qm"), F.col("m")), 6).alias("mean_cosine"),
        F.round(S.max_sim(F.col("qm"), F.col("m"), False), 6).alias("raw_sum"),
    )


@query("C28 C13 C11 P02 P15 X06", """
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words, CAST(ceil(length(text) / 4) AS BIGINT) AS estimated,
  CASE WHEN length(text) > 200 THEN concat(left(text, 200), '...') ELSE text END AS snippet,
  CASE WHEN len(string_split(text, ' ')) > 20 THEN concat(array_to_string(string_split(text, ' ')[1:20], ' '), '...') ELSE text END AS cut FROM documents""")
def token_counts_snippets(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("bigint").alias("words"),
        F.ceil(F.length(text) / 4).alias("estimated"), context.snippet(text).alias("snippet"), context.truncated_words(text, 20).alias("cut"),
    )


@query("C06 P14")
def slugs_and_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors of the documents' first lines and byte-true cuts (no SQL: NFKD)."""
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    return table(spark, sf, "documents").select("doc_id", S.slug(first).alias("anchor"), S.truncate_bytes(64)(F.col("text")).alias("cut"))


@query("C16")
def longest_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of the benchmark in the documents, the longest at each place (no SQL: each match depends on those before it)."""
    w = F.split("text", r"\s+")
    starts = F.array(*(F.array_join(F.slice(w, 1, n), " ") for n in (2, 3, 5)))
    names = table(spark, sf, "benchmark").select(F.explode(starts).alias("name"))
    return ingest.longest_entities(table(spark, sf, "documents"), names, "doc_id", "text", "name")


@query("P13 S28", """
SELECT event_id, coalesce(nullif(regexp_extract(concat('DocTag: T-', user_id), 'DocTag: ([A-Z]+-[0-9]+)', 1), ''), 'none') AS tag, left(event_type, 4) AS kind FROM events""")
def tags_and_properties(spark: SparkSession, sf: str) -> DataFrame:
    props = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("embedding"), F.lit("x"))
    kept = S.property_filter(props, ("embedding",), 4)
    tag = F.regexp_extract(F.concat(F.lit("DocTag: T-"), F.col("user_id").cast("string")), "DocTag: ([A-Z]+-[0-9]+)", 1)
    return table(spark, sf, "events").select("event_id", F.coalesce(F.nullif(tag, F.lit("")), F.lit("none")).alias("tag"), kept["kind"].alias("kind"))


@query("X02 X03 X07 X12", with_views("chunks", """
b AS (SELECT *, CAST(sum(token_count) OVER (PARTITION BY document_id ORDER BY ord) AS BIGINT) AS used FROM chunks),
c AS (SELECT *, min(CASE WHEN used > 300 THEN ord END) OVER (PARTITION BY document_id) AS stop FROM b)
SELECT document_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY ord)) AS context, CAST(max(used) AS BIGINT) AS tokens FROM c WHERE stop IS NULL OR ord < stop GROUP BY ALL"""))
def assembled_context(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's chunks up to a budget, as one text."""
    kept = context.budget_prefix(chunks(spark, sf), "document_id", ["ord"], "token_count", 300)
    tokens = kept.groupBy("document_id").agg(F.max("used").alias("tokens"))
    return context.joined_text(kept, "document_id", ["ord"], "text").join(tokens, "document_id").select("document_id", F.sha2("context", 256).alias("context"), "tokens")


@query("X01 X08 X09 X11", with_views("entities mentions", """
r AS (SELECT src, e.label, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) AS n FROM mentions JOIN entities e ON e.id = dst)
SELECT src AS chunk_id, string_agg(label, ', ' ORDER BY n) AS evidence, count(*) AS n FROM r WHERE n <= 5 GROUP BY src"""))
def evidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    from inkfathom.sources.adapters import entities

    m = mentions(spark, sf).join(entities(spark, sf).select(F.col("id").alias("dst"), "label"), "dst")
    from pyspark.sql import Window

    w = Window.partitionBy("src").orderBy(F.desc("confidence"), "dst")
    best = m.withColumn("n", F.row_number().over(w)).where("n <= 5")
    g = best.groupBy(F.col("src").alias("chunk_id")).agg(F.sort_array(F.collect_list(F.struct("n", "label"))).alias("l"))
    return g.select("chunk_id", F.array_join(F.col("l.label"), ", ").alias("evidence"), F.size("l").cast("bigint").alias("n"))


@query("P01 P03 P04 P05 P16 P17 P18", """
SELECT d.doc_id, d.lang, d.source, d.text, octet_length(encode(d.text)) > 1000 AS long, l.doc_id IS NOT NULL AS labelled
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang IN ('en', 'de') AND d.source = 'src0'""")
def whole_text_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Filters and a projection that reach the scan, whole texts, and a check of existence."""
    from inkfathom.operators.guards import filters, project

    d = table(spark, sf, "documents")
    kept = d.where(filters({"lang": ["en", "de"], "source": ["src0"], "snapshot_scope": None}, allowed=("lang", "source", "snapshot_scope")))
    labelled = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("labelled"))
    joined = project(kept, ("doc_id", "lang", "source", "text")).join(labelled, "doc_id", "left")
    return joined.select(
        "doc_id", "lang", "source", "text", (F.octet_length("text") > 1000).alias("long"),
        F.coalesce("labelled", F.lit(False)).alias("labelled"),
    )
