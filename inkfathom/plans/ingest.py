"""Queries of parsing, extraction, chunking and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfathom.operators import ingest, markup
from inkfathom.registry import query
from inkfathom.sources.adapters import chunks, table, with_views

_MD = with_views("chunks", """
m AS (SELECT document_id AS doc, ord, CASE WHEN token_count < 6 THEN concat(repeat('#', 1 + ord % 3), ' ', text) ELSE text END AS text FROM chunks),
h AS (SELECT *, regexp_matches(text, '^(#{1,6})\\s+(.*?)\\s*#*$') AS head FROM m),
n AS (SELECT *, CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ord) AS BIGINT) AS n FROM h),
s AS (SELECT doc, n, coalesce(max(CASE WHEN head THEN length(regexp_extract(text, '^(#{1,6})\\s+(.*?)\\s*#*$', 1)) END), 1) AS level,
  coalesce(max(CASE WHEN head THEN regexp_extract(text, '^(#{1,6})\\s+(.*?)\\s*#*$', 2) END), '') AS title,
  coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER (NOT head), '') AS text FROM n GROUP BY doc, n),
f AS (SELECT * FROM s WHERE n > 0 OR trim(text) <> ''),
l AS (SELECT *, max(CASE WHEN level = 1 THEN n END) OVER w AS a1, max(CASE WHEN level = 2 THEN n END) OVER w AS a2,
  last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS t2
  FROM f WINDOW w AS (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc, n, CAST(level AS BIGINT) AS level, title, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS checksum,
  concat_ws(' > ', CASE WHEN level > 1 AND a1 IS NOT NULL THEN t1 END, CASE WHEN level > 2 AND a2 > coalesce(a1, -1) THEN t2 END) AS parent_path,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS tokens FROM l""")


def marked_down(spark: SparkSession, sf: str) -> DataFrame:
    """The documents with their short lines as headings of three levels."""
    line = F.concat_ws("", F.when(F.col("token_count") < 6, F.concat(F.expr("repeat('#', cast(1 + ord % 3 as int))"), F.lit(" "))), F.col("text"))
    c = chunks(spark, sf).select("document_id", "ord", line.alias("line"))
    parts = F.sort_array(F.collect_list(F.struct("ord", "line")))
    return c.groupBy(F.col("document_id").alias("doc_id")).agg(F.array_join(parts["line"], "\n").alias("text"))


@query("S02 W11 A12", _MD)
def md_sections(spark: SparkSession, sf: str) -> DataFrame:
    s = ingest.markdown_sections(marked_down(spark, sf))
    return s.select("doc", "n", F.col("level").cast("bigint").alias("level"), "title", "checksum", "parent_path", "tokens")


def marked_up(spark: SparkSession, sf: str) -> DataFrame:
    """uri, text: the marked-down documents, two in three with front matter, one in two with a table and code after it."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    front = F.format_string("---\ntitle: Document %d\nversion: \"%d.0\"\nplace:\n  source: %s\n  lang: %s\ntags: [%s, a]\n---\n", "doc_id", (F.col("doc_id") % 3), "source", "lang", "lang")
    more = F.format_string("\n\n| key | value |\n|---|---|\n| chars | %d |\n\n```sql\nSELECT %d\n```\n", "n_chars", "doc_id")
    text = F.concat_ws("", F.when(F.col("doc_id") % 3 > 0, front), "text", F.when(F.col("doc_id") % 2 == 0, more))
    return marked_down(spark, sf).join(d, "doc_id").select(F.concat(F.lit("Doc://"), F.col("doc_id").cast("string")).alias("uri"), text.alias("text"))


@query("S01 S04")
def markdown_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their title, version and nested front matter (no SQL: blocks within blocks; tested by hand-made texts)."""
    d = markup.markdown_documents(markup.parsed_markdown(marked_up(spark, sf)))
    at = lambda path: F.variant_get("front_matter", path, "string")
    return d.select("id", "uri", "title", "version", at("$.place.source").alias("source"), at("$.tags[0]").alias("tag"))


@query("S01 S03")
def markdown_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of blocks, with the lines they stand on (no SQL: likewise)."""
    s = markup.markdown_sections(markup.parsed_markdown(marked_up(spark, sf)))
    return s.select(
        "id", "document_id", "order", "level", "title", "anchor", "parent_path", "line_start", "line_end", F.array_join("block_types", ",").alias("block_types"),
        "code_ratio", "is_heading_only", "tokens", "checksum",
    )


@query("S06")
def html_tree_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of the main part of each page, from its tree (no SQL: likewise)."""
    s = markup.html_sections(table(spark, sf, "pages"))
    return s.select("id", "document_id", "uri", "order", "level", "title", "anchor", "text", F.size("tables").alias("tables"), F.size("code_blocks").alias("code_blocks"), "tokens", "checksum")


@query("S06", """
SELECT page_id AS page, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<h[1-6][^>]*>')) AS headings,
  len(regexp_extract_all(html, '<a href="[^"]*"')) AS links, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages""")
def html_fields(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(f"({p})"), F.lit(1))).cast("bigint")
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("page"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        n("<h[1-6][^>]*>").alias("headings"), n('<a href="[^"]*"').alias("links"), n("<p[ >]").alias("paragraphs"),
    )


@query("S06")
def html_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections by an HTML parser (no SQL; tested on small pages)."""
    return ingest.html_sections(table(spark, sf, "pages"))


_CFG = " UNION ALL ".join(
    f"SELECT doc_id AS section, unnest(regexp_extract_all(text, '{p}', 1)) AS name, '{k}' AS kind, CAST({c} AS DOUBLE) AS confidence FROM documents" for p, k, c in ingest.CONFIGS
)


@query("E02 E04", f"SELECT section, name, arg_max(kind, (confidence, kind)) AS kind, max(confidence) AS confidence FROM ({_CFG}) WHERE length(name) > 2 GROUP BY ALL")
def regex_configurations(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.configurations(table(spark, sf, "documents"), "doc_id", "text")


_STARTERS = ", ".join(f"'{s}'" for s in ingest.STARTERS)


@query("E01 E05", f"""
WITH t AS (SELECT doc_id, concat('Run `git push ', doc_id % 9, '` then `', text, '`') AS text FROM documents),
c AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '`([^`]+)`', 1))) AS command FROM t)
SELECT doc_id AS section, split_part(command, ' ', 1) AS name, max(command) AS command, CAST(0.85 AS DOUBLE) AS confidence FROM c WHERE split_part(command, ' ', 1) IN ({_STARTERS}) GROUP BY ALL""")
def regex_commands(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    text = F.concat(F.lit("Run `git push "), (F.col("doc_id") % 9).cast("string"), F.lit("` then `"), F.col("text"), F.lit("`"))
    return ingest.commands(d.select("doc_id", text.alias("text")), "doc_id", "text")


@query("E03", with_views("chunks", """
x AS (SELECT document_id, ord + 1 AS ord, trim(text) AS body FROM chunks WHERE trim(text) <> '')
SELECT CAST(document_id AS VARCHAR) AS section, left(sha256(concat_ws('|', 'proc', document_id, 'steps')), 16) AS procedure_id,
  left(sha256(concat_ws('|', 'step', document_id, ord, left(lower(body), 50))), 16) AS step_id, ord, body AS instruction FROM x"""))
def numbered_procedures(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as numbered lists, one step a line."""
    c = chunks(spark, sf).where(F.trim("text") != "")
    line = F.concat((F.col("ord") + 1).cast("string"), F.lit(". "), F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("ord", line.alias("line"))))
    d = c.groupBy("document_id").agg(F.array_join(parts["line"], "\n").alias("text")).withColumn("title", F.lit("Steps"))
    return ingest.procedures(d, "document_id", "title", "text")


_KINDS = " UNION ALL ".join(
    f"SELECT doc_id AS document, unnest(regexp_extract_all(text, '{p}', 1)) AS hint, '{kind}' AS kind, CAST({sure} AS DOUBLE) AS confidence FROM t"
    for kind, p, sure in ingest.REFERENCES
)


@query("E08 E09 G34 G35 G44 J10", f"""
WITH t AS (SELECT doc_id, concat('[', split_part(text, ' ', 1), '](x.md) ', text, chr(10), 'See also: ', split_part(text, ' ', 3), chr(10), 'Related: ',
  split_part(text, ' ', 4), chr(10), 'Refer to the ', split_part(text, ' ', 5), ' Guide') AS text FROM documents),
f AS ({_KINDS}),
d AS (SELECT document, document AS source, trim(hint) AS hint, kind, confidence, row_number() OVER (PARTITION BY document, lower(trim(hint)) ORDER BY confidence DESC, trim(hint)) AS n FROM f WHERE trim(hint) <> ''),
names AS (SELECT lower(trim(split_part(text, ' ', 2))) AS key, min(doc_id) AS target FROM documents GROUP BY ALL)
SELECT document, source, hint, kind, confidence, target, CASE WHEN target IS NULL THEN 'ghost' ELSE 'resolved' END AS state FROM d LEFT JOIN names ON key = lower(trim(hint)) WHERE n = 1""")
def resolved_references(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's text with a reference of each kind, to its first, third,
    fourth and fifth word; documents are titled by their second."""
    d = table(spark, sf, "documents")
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    text = F.concat(
        F.lit("["), word(1), F.lit("](x.md) "), F.col("text"), F.lit("\nSee also: "), word(3), F.lit("\nRelated: "), word(4),
        F.lit("\nRefer to the "), word(5), F.lit(" Guide"),
    )
    refs = ingest.references(d.select("doc_id", text.alias("text")), "doc_id", "doc_id", "text")
    return ingest.resolve(refs, d.select(F.col("doc_id").alias("document_id"), word(2).alias("title")))


@query("K07 K09", """
WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents),
n AS (SELECT id, w, unnest(generate_series(0, greatest(0, CAST(ceil((len(w) - 20) / 80.0) AS BIGINT) - 1))) AS n FROM d WHERE len(w) > 0)
SELECT id, CAST(n AS INTEGER) AS n, array_to_string(w[n * 80 + 1 : n * 80 + 100], ' ') AS text, len(w[n * 80 + 1 : n * 80 + 100]) AS tokens FROM n""")
def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.token_windows(table(spark, sf, "documents"), "doc_id", "text", 100, 20)


@query("K04 K05 P12", with_views("chunks", """
t AS (SELECT *, sum(token_count) OVER (PARTITION BY document_id) AS total FROM chunks)
SELECT document_id, min_by(chunk_id, ord) AS chunk_id, min(ord) AS ord, CAST(sum(token_count) AS BIGINT) AS token_count, count(*) AS parts FROM t WHERE total <= 200 GROUP BY ALL
UNION ALL SELECT document_id, chunk_id, ord, token_count, 1 FROM t WHERE total > 200"""))
def collapsed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.collapse_small(chunks(spark, sf), 200)


@query("S16 T02 S15", """
SELECT source AS tag, sha256(text) AS checksum, min(doc_id) AS first, count(*) AS offered FROM documents GROUP BY ALL""")
def dedup_checksum(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("source").alias("tag"), F.sha2("text", 256).alias("checksum"), "doc_id")
    return d.groupBy("tag", "checksum").agg(F.min("doc_id").alias("first"), F.count("*").alias("offered"))


@query("G31 G43", with_views("chunks", """
h AS (SELECT document_id, ord, regexp_replace(lower(trim(regexp_replace(text, '[.,!]+$', ''))), '^(the|an|a) ', '') AS canonical FROM chunks WHERE token_count < 6)
SELECT left(sha256(concat_ws(':', 'heading_concept', document_id, canonical)), 24) AS concept_id, document_id, canonical, min(ord) AS first, count(*) AS mentions
FROM h WHERE length(canonical) >= 5 AND NOT regexp_matches(canonical, '^[0-9 ]+$') GROUP BY ALL"""))
def heading_concepts(spark: SparkSession, sf: str) -> DataFrame:
    h = chunks(spark, sf).where("token_count < 6")
    canonical = F.regexp_replace(F.lower(F.trim(F.regexp_replace("text", "[.,!]+$", ""))), "^(the|an|a) ", "")
    h = h.select("document_id", "ord", canonical.alias("canonical")).where((F.length("canonical") >= 5) & ~F.col("canonical").rlike("^[0-9 ]+$"))
    g = h.groupBy("document_id", "canonical").agg(F.min("ord").alias("first"), F.count("*").alias("mentions"))
    return g.withColumn("concept_id", F.substring(F.sha2(F.concat_ws(":", F.lit("heading_concept"), F.col("document_id").cast("string"), "canonical"), 256), 1, 24))
