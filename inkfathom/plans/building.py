"""Queries of references, mentions, metadata, chunk assembly, queues and embedding bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkfathom.operators import building, chunking, ingest
from inkfathom.plans.ingest import marked_down
from inkfathom.plans.search import _WORDS_SQL
from inkfathom.registry import query
from inkfathom.sources.adapters import chunks, table, with_views


def _word(i: int):
    return F.split_part("text", F.lit(" "), F.lit(i))


_MARKED = "concat('[', split_part(text, ' ', 1), '](a.md) See also: ', split_part(text, ' ', 2), '. Related: ', split_part(text, ' ', 3), '. Refer to the ', split_part(text, ' ', 4), ' Guide ', text)"


def _marked(d: DataFrame) -> DataFrame:
    lit = F.lit
    return d.select("doc_id", F.concat(lit("["), _word(1), lit("](a.md) See also: "), _word(2), lit(". Related: "), _word(3), lit(". Refer to the "), _word(4), lit(" Guide "), F.col("text")).alias("text"))


_FAMILIES = " UNION ALL ".join(f"SELECT doc_id AS document, trim(unnest(regexp_extract_all(text, '{p}', 1))) AS hint, '{k}' AS kind, CAST({c} AS DOUBLE) AS confidence FROM t" for k, p, c in ingest.REFERENCES)


@query("E08 E09", f"""
WITH t AS (SELECT doc_id, {_MARKED} AS text FROM documents), f AS ({_FAMILIES}),
d AS (SELECT *, row_number() OVER (PARTITION BY document, lower(hint) ORDER BY confidence DESC, hint) AS n FROM f WHERE hint <> '')
SELECT document, hint, kind, confidence FROM d WHERE n = 1""")
def reference_families(spark: SparkSession, sf: str) -> DataFrame:
    """References of all four kinds in marked-up documents, each hint once by its surest kind."""
    return ingest.references(_marked(table(spark, sf, "documents")), "doc_id", "doc_id", "text").drop("source")


@query("G44", f"""
WITH t AS (SELECT doc_id, {_MARKED} AS text FROM documents), f AS ({_FAMILIES}),
s AS (SELECT document, hint, kind, confidence, row_number() OVER (PARTITION BY document, lower(hint) ORDER BY confidence DESC, hint) AS n FROM f WHERE hint <> '' AND kind <> 'hyperlink'),
u AS (SELECT doc_id AS document, trim(unnest([split_part(text, ' ', 2), split_part(text, ' ', 1)])) AS hint FROM documents),
l AS (SELECT document, hint, row_number() OVER (PARTITION BY document, lower(hint) ORDER BY hint) AS n FROM u WHERE hint <> '' AND NOT contains(hint, ']')),
k AS (SELECT document, hint FROM l WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.n = 1 AND s.document = l.document AND lower(s.hint) = lower(l.hint)))
SELECT document, hint, kind FROM s WHERE n = 1 UNION ALL SELECT document, hint, 'hyperlink' FROM k""")
def merged_hyperlinks(spark: SparkSession, sf: str) -> DataFrame:
    """Hyperlinks of the raw text beside the references of plain text, without those named already."""
    d = table(spark, sf, "documents")
    plain = ingest.references(_marked(d), "doc_id", "doc_id", "text", kinds=("see_also", "related", "refer_to"))
    link = lambda i: F.concat(F.lit("["), _word(i), F.lit("](a.md) "))
    raw = ingest.references(d.select("doc_id", F.concat(link(2), link(1)).alias("text")), "doc_id", "doc_id", "text")
    return building.merge_hyperlinks(plain.select("document", "hint", "kind"), raw.select("document", "hint", "kind"))


@query("G34 G35 J09", """
WITH known AS (SELECT lower(split_part(text, ' ', 2)) AS t, min(doc_id) AS id FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL),
r AS (SELECT doc_id AS document, split_part(text, ' ', 1) AS hint FROM documents),
s AS (SELECT document, hint, lower(hint) AS low, id AS target, CASE WHEN id IS NOT NULL THEN 'resolved' WHEN document % 3 = 0 THEN 'ghost' ELSE 'pending' END AS state FROM r LEFT JOIN known ON t = lower(hint)),
new AS (SELECT lower(split_part(text, ' ', 3)) AS title, min(doc_id) AS found FROM documents WHERE doc_id % 2 = 1 AND split_part(text, ' ', 3) <> '' GROUP BY ALL),
p AS (SELECT DISTINCT low FROM s WHERE state = 'pending' AND low <> ''),
near AS (SELECT low, min(found) AS near FROM p JOIN new ON contains(title, low) OR contains(low, title) GROUP BY low)
SELECT document, hint, CASE WHEN state = 'ghost' AND found IS NOT NULL THEN 'resolved_from_ghost' WHEN state = 'pending' AND near IS NOT NULL THEN 'resolved_from_pending' ELSE state END AS state,
  coalesce(target, CASE state WHEN 'ghost' THEN found WHEN 'pending' THEN near END) AS target FROM s LEFT JOIN new ON title = low LEFT JOIN near USING (low)""")
def references_on_arrival(spark: SparkSession, sf: str) -> DataFrame:
    """References to first words, and what becomes of ghosts and pending ones when odd documents arrive."""
    d = table(spark, sf, "documents")
    known = d.where("doc_id % 2 = 0").groupBy(F.lower(_word(2)).alias("t")).agg(F.min("doc_id").alias("target"))
    refs = d.select(F.col("doc_id").alias("document"), _word(1).alias("hint")).join(known, F.lower("hint") == F.col("t"), "left")
    state = F.when(F.col("target").isNotNull(), "resolved").when(F.col("document") % 3 == 0, "ghost").otherwise("pending")
    new = d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("document_id"), _word(3).alias("title"))
    return building.arrived(refs.select("document", "hint", state.alias("state"), "target"), new)


@query("J11", f"""
WITH t AS (SELECT doc_id AS id, array_to_string(string_split(text, ' ')[1:4], ' ') AS text FROM documents),
h AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:1 + item_id % 3], ' ') AS text, item_id % 10 / 10.0 AS confidence FROM benchmark),
hw AS (SELECT query_id, CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 3 THEN {_WORDS_SQL} END AS words FROM h),
w AS (SELECT id, length(text) AS size, {_WORDS_SQL} AS words FROM t), s AS (SELECT count(*) AS n_docs, avg(len(words)) AS avgdl FROM w),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(words) AS term FROM w) GROUP BY term),
r AS (SELECT query_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5))) AS idf FROM (SELECT query_id, unnest(words) AS term FROM hw) JOIN df USING (term) CROSS JOIN s GROUP BY query_id),
m AS (
  SELECT query_id, id, size, len(w.words) AS dl, len(list_filter(range(1, len(w.words) - len(hw.words) + 2), lambda i: w.words[i:i + len(hw.words) - 1] = hw.words)) AS freq
  FROM hw JOIN w ON contains(concat(' ', array_to_string(w.words, ' '), ' '), concat(' ', array_to_string(hw.words, ' '), ' ')) AND len(hw.words) > 0),
b AS (SELECT query_id, id, size, round(idf * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM m JOIN r USING (query_id) CROSS JOIN s),
k AS (SELECT * FROM b WHERE score > 0.5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, size, id) = 1)
SELECT query_id, CASE WHEN id IS NULL THEN 'pending' ELSE 'resolved' END AS state, id, score,
  round(CASE WHEN id IS NULL THEN confidence ELSE greatest(0.1, confidence - 0.25) END, 6)::DOUBLE AS confidence FROM h LEFT JOIN k USING (query_id)""")
def fuzzy_references(spark: SparkSession, sf: str) -> DataFrame:
    """The likeliest title of each hint, or that it is pending (the first words of documents and passages stand for titles and hints)."""
    first = lambda n: F.array_join(F.slice(F.split("text", " "), 1, n), " ")
    titles = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), first(4).alias("text"))
    hints = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), first((1 + F.col("item_id") % 3).cast("int")).alias("text"), (F.col("item_id") % 10 / 10.0).alias("confidence"))
    return building.fuzzy(hints, titles)


@query("J16", """
WITH p AS (SELECT page_id, regexp_extract(url, '^(.*/)', 1) AS dir, length(html) AS n FROM pages)
SELECT page_id, near FROM (SELECT a.page_id, b.page_id AS near, row_number() OVER (PARTITION BY a.page_id ORDER BY b.n, b.page_id) AS k FROM p a JOIN p b ON a.dir = b.dir AND a.page_id <> b.page_id) WHERE k <= 2""")
def directory_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The two shortest other pages whose path begins with a page's directory: equality on the derived prefix."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^(.*/)", 1).alias("dir"), F.length("html").alias("n"))
    w = Window.partitionBy("dir").orderBy("n", "page_id")
    first = p.withColumn("k", F.row_number().over(w)).where("k <= 3").select("dir", F.col("page_id").alias("near"), "k")
    both = p.select("page_id", "dir").join(first, "dir").where("page_id <> near")
    return both.withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("k"))).where("k <= 2").select("page_id", "near")


@query("G43", """
WITH s AS (SELECT l_orderkey AS chunk, l_partkey % 20 AS entity, l_linenumber AS pos, 'pattern' AS source, 1 AS n FROM lineitem),
m AS (SELECT l_orderkey, l_suppkey % 20, l_linenumber, 'model', 0 FROM lineitem WHERE l_quantity > 30),
u AS (SELECT * FROM s UNION ALL SELECT * FROM m)
SELECT chunk, entity, arg_min(source, (n, pos)) AS source, arg_min(pos, (n, pos)) AS pos FROM u GROUP BY ALL""")
def remapped_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as sections, orders as the chunks made of them."""
    li = table(spark, sf, "lineitem")
    section = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    made = li.groupBy(F.col("l_orderkey").alias("chunk")).agg(F.collect_set(section).alias("section_ids"))
    structural = li.select(section.alias("section"), (F.col("l_partkey") % 20).alias("entity"), F.col("l_linenumber").alias("pos"))
    named = li.where("l_quantity > 30").select(F.col("l_orderkey").alias("chunk"), (F.col("l_suppkey") % 20).alias("entity"), F.col("l_linenumber").alias("pos"))
    return building.remapped_mentions(made, structural, named)


@query("G30 K10", with_views("chunks", """
o AS (SELECT chunk_id, document_id, ord, token_count, contains(text, '=') AS has_code FROM chunks),
n AS (SELECT chunk_id, token_count + 1 AS token_count, CASE WHEN ord % 2 = 0 THEN true END AS has_code FROM chunks WHERE ord % 3 = 0)
SELECT o.chunk_id, coalesce(n.token_count, o.token_count) AS token_count, coalesce(n.has_code, o.has_code) AS has_code,
  CASE WHEN ord % 4 > 0 THEN CAST(floor(ord * 10 + (ord % 4) * (ord % 7 + 1) / 4.0) AS BIGINT) ELSE ord * 10 END AS line_start,
  CASE WHEN ord % 4 > 0 THEN CAST(floor(ord * 10 + (ord % 4 + 1) * (ord % 7 + 1) / 4.0) AS BIGINT) ELSE ord * 10 + ord % 7 + 1 END AS line_end FROM o LEFT JOIN n USING (chunk_id)"""))
def updated_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk metadata after an update of every third, and the lines that pieces of a section stand for."""
    c = chunks(spark, sf).select("chunk_id", "document_id", "ord", "token_count", F.contains("text", F.lit("=")).alias("has_code"))
    news = c.where("ord % 3 = 0").select("chunk_id", (F.col("token_count") + 1).alias("token_count"), F.when(F.col("ord") % 2 == 0, True).alias("has_code"))
    u = building.updated(c, news, "chunk_id", ["token_count", "has_code"])
    o = F.col("ord")
    a, b = building.piece_lines(o * 10, o * 10 + o % 7 + 1, o % 4, F.when(o % 4 > 0, 4).otherwise(1))
    return u.select("chunk_id", "token_count", "has_code", a.cast("bigint").alias("line_start"), b.cast("bigint").alias("line_end"))


@query("C09", with_views("chunks", """
t AS (SELECT document_id, ord, CASE WHEN contains(text, '|') THEN 'table' WHEN contains(text, '=') THEN 'Code ' WHEN token_count < 6 THEN 'list' ELSE 'paragraph' END AS kind FROM chunks),
b AS (SELECT document_id, lower(trim(kind)) AS kind, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT document_id, sum(n) AS total, max(n) AS most, arg_max(kind, (n, kind)) AS kind, count(*) AS kinds, bool_or(kind = 'table') AS tab FROM b GROUP BY document_id)
SELECT document_id, CASE WHEN document_id % 9 = 0 THEN 'code' WHEN tab THEN 'table' WHEN most <= total / 2 AND kinds > 1 THEN 'mixed' ELSE kind END AS block_type FROM g"""))
def block_types(spark: SparkSession, sf: str) -> DataFrame:
    """One word for each document's blocks; every ninth is taken to be mostly code."""
    text = F.col("text")
    kind = F.when(F.contains(text, F.lit("|")), "table").when(F.contains(text, F.lit("=")), "Code ").when(F.col("token_count") < 6, "list").otherwise("paragraph")
    g = chunks(spark, sf).groupBy("document_id").agg(F.collect_list(kind).alias("types"))
    return g.select("document_id", building.block_type(F.col("types"), F.when(F.col("document_id") % 9 == 0, 0.7).otherwise(0.1)).alias("block_type"))


@query("C33", with_views("chunks", """
k AS (SELECT document_id, ord // 3 AS k, concat('k', document_id, '-', ord // 3) AS chunk_id, min(ord) AS first, list(concat(document_id, '-', ord)) AS ids FROM chunks GROUP BY ALL),
p AS (SELECT *, CASE WHEN k = 0 THEN NULL WHEN k % 5 = 4 THEN concat(document_id, '-x') WHEN k % 5 = 3 THEN chunk_id ELSE concat(document_id, '-', first - 2) END AS parent FROM k),
h AS (SELECT unnest(ids) AS original, chunk_id FROM k WHERE k % 5 <> 3 UNION ALL SELECT chunk_id, chunk_id FROM k WHERE k % 5 = 3)
SELECT p.chunk_id, p.parent AS parent_original, h.chunk_id AS parent_chunk_id, CASE WHEN p.parent IS NULL THEN 'none' WHEN h.chunk_id IS NULL THEN 'missing' WHEN h.chunk_id = p.parent THEN 'same' ELSE 'remapped' END AS outcome
FROM p LEFT JOIN h ON h.original = p.parent"""))
def canonical_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of three lines whose parents are named by lines, by themselves, or by nothing there is."""
    k = F.floor(F.col("ord") / 3)
    text = F.col("document_id").cast("string")
    c = chunks(spark, sf).withColumn("k", k).groupBy("document_id", "k").agg(F.min("ord").alias("first"), F.collect_list(F.concat_ws("-", text, F.col("ord").cast("string"))).alias("ids"))
    own = F.concat(F.lit("k"), text, F.lit("-"), F.col("k").cast("string"))
    parent = F.when(F.col("k") == 0, None).when(F.col("k") % 5 == 4, F.concat(text, F.lit("-x"))).when(F.col("k") % 5 == 3, own).otherwise(F.concat_ws("-", text, (F.col("first") - 2).cast("string")))
    none = F.array().cast("array<string>")
    rows = c.select(own.alias("chunk_id"), F.col("first").alias("ord"), F.when(F.col("k") % 5 == 3, none).otherwise(F.col("ids")).alias("original_ids"), parent.alias("parent_original"))
    return building.canonical_parents(rows)


_NAMES = "list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: regexp_replace(x, '[.,!?]+$', '')), lambda x: regexp_matches(x, '^[A-Z][a-z]{3,}$') AND lower(x) NOT IN ('this', 'that', 'with', 'from'))"


@query("E05", f"""
WITH f AS (SELECT doc_id, text, {_NAMES} AS names FROM documents),
u AS (SELECT doc_id, unnest(names) AS name, generate_subscripts(names, 1) AS n FROM f),
o AS (SELECT doc_id, arg_min(name, n) AS name, min(n) AS n FROM u GROUP BY doc_id, lower(name)),
g AS (SELECT doc_id, string_agg(concat('name: ', name), '; ' ORDER BY n) AS context, count(*) AS entities FROM o GROUP BY doc_id)
SELECT doc_id, coalesce(entities, 0) AS entities, md5(CASE WHEN context IS NULL THEN text ELSE concat(text, chr(10), chr(10), '[Context: ', context, ']') END) AS embedding_text FROM f LEFT JOIN g USING (doc_id)""")
def enriched_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with the names in them as context for an embedding."""
    words = F.transform(F.split("text", r"\s+"), lambda x: F.regexp_replace(x, "[.,!?]+$", ""))
    found = F.transform(F.filter(words, lambda x: x.rlike("^[A-Z][a-z]{3,}$")), lambda x: F.struct(x.alias("name"), F.lit("name").alias("type")))
    e = building.enriched(table(spark, sf, "documents").select("doc_id", "text"), found)
    return e.select("doc_id", F.size("entities").cast("bigint").alias("entities"), F.md5("embedding_text").alias("embedding_text"))


_DOCUMENTED = "concat('The `', lower(split_part(text, ' ', 1)), '` command. `ls-all` - lists; `the` - no. ', text)"


@query("E01 E02", f"""
WITH t AS (SELECT doc_id, {_DOCUMENTED} AS text, concat('Key_one: 1', chr(10), '  sub-key:  2', chr(10), text) AS yaml FROM documents),
c AS (SELECT doc_id, unnest(list_concat({', '.join(f"regexp_extract_all(text, '{p}', 1)" for p in building.DOCUMENTED)})) AS name FROM t),
k AS (SELECT doc_id, unnest(regexp_extract_all(yaml, '{building.YAML_KEY}', 1)) AS key FROM t),
cs AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS commands FROM c WHERE lower(name) NOT IN ({", ".join(f"'{x}'" for x in building.NO_COMMANDS)}) GROUP BY doc_id),
ks AS (SELECT doc_id, string_agg(DISTINCT key, ',' ORDER BY key) AS keys FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(commands, '') AS commands, coalesce(keys, '') AS keys FROM t LEFT JOIN cs USING (doc_id) LEFT JOIN ks USING (doc_id)""")
def described_commands_and_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Commands that documents describe, and keys of YAML lines."""
    text = F.concat(F.lit("The `"), F.lower(_word(1)), F.lit("` command. `ls-all` - lists; `the` - no. "), F.col("text"))
    yaml = F.concat(F.lit("Key_one: 1\n  sub-key:  2\n"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(building.documented_commands(text), ",").alias("commands"), F.array_join(building.yaml_keys(yaml), ",").alias("keys"))


@query("S15", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, user_id % 10 = 0 AS urgent FROM events)
SELECT event_id, event_type, n <= 300 AS accepted, CASE WHEN n <= 300 THEN row_number() OVER (PARTITION BY event_type, n <= 300 ORDER BY urgent DESC, CASE WHEN urgent THEN -n ELSE n END) END AS place FROM n""")
def queue_places(spark: SparkSession, sf: str) -> DataFrame:
    """Events as jobs of a queue for each type, which takes 300; every tenth user's go in front."""
    e = table(spark, sf, "events").select("event_id", "event_type", "ts", "user_id")
    return building.queued(e, "event_type", ["ts", "event_id"], F.col("user_id") % 10 == 0, 300).select("event_id", "event_type", "accepted", "place")


_PATHS = "CASE page_id % 4 WHEN 0 THEN concat('/data/ingest/cat', page_id % 7, '/guide-', page_id, '.md') WHEN 1 THEN concat('/x/scope', page_id % 5, '__slug-', page_id, '.html') WHEN 2 THEN concat('/data/ingest/top-', page_id, '.md') ELSE concat('plain-', page_id, '.v1.md') END"


@query("S28", f"""
WITH p AS (SELECT page_id, {_PATHS} AS path, CASE WHEN page_id % 5 = 0 THEN concat('x doctag:  T_', page_id, ' y') ELSE '' END AS content FROM pages),
s AS (SELECT *, nullif(regexp_extract(content, '(?i)DocTag:\\s*([A-Za-z0-9_\\-]+)', 1), '') AS said, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem,
  nullif(regexp_extract(path, '^.*?ingest/([^/]+)/', 1), '') AS cat FROM p)
SELECT page_id, coalesce(said, CASE WHEN contains(stem, '__') THEN regexp_extract(stem, '^.*?__(.*)$', 1) END, cat, stem) AS doc_tag, CASE WHEN said IS NULL THEN cat END AS category,
  CASE WHEN said IS NULL AND contains(stem, '__') THEN regexp_extract(stem, '^(.*?)__', 1) END AS scope FROM s""")
def derived_tags(spark: SparkSession, sf: str) -> DataFrame:
    content = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("x doctag:  T_"), F.col("page_id").cast("string"), F.lit(" y"))).otherwise("")
    p = table(spark, sf, "pages").select("page_id", F.expr(_PATHS.replace("page_id,", "cast(page_id AS string),").replace("% 7,", "% 7,")).alias("path"), content.alias("content"))
    return p.select("page_id", *(c.alias(n) for n, c in building.derived_tags(F.col("path"), F.col("content")).items()))


@query("K05 P12", with_views("chunks", """
t AS (SELECT *, CAST(sum(token_count) OVER (PARTITION BY document_id) AS BIGINT) AS total FROM chunks),
s AS (SELECT document_id, arg_max(chunk_id, (ord, chunk_id)) AS last, max(ord) AS ord, count(*) AS n, any_value(total) AS total FROM t WHERE total <= 200 GROUP BY document_id)
SELECT document_id, chunk_id, ord, token_count, total, total <= 200 AS doc_is_microdoc, false AS is_stub FROM t
UNION ALL SELECT document_id, sha256(concat_ws('|', document_id, last, concat('microdoc-stub-', n))), ord + 1, 0, total, true, true FROM s"""))
def microdoc_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Small documents' chunks marked, with a stub behind the last; searches leave stubs out."""
    return building.microdoc_annotations(chunks(spark, sf), 200)


@query("K09", """
WITH d AS (SELECT doc_id AS id, text, regexp_extract_all(text, '(^\\s+|\\S+\\s*)', 1) AS w FROM documents),
n AS (SELECT id, text, w, greatest(1, CAST(ceil((len(w) - 15) / 60.0) AS BIGINT)) AS total FROM d WHERE len(w) > 0),
k AS (SELECT id, text, w, total, unnest(generate_series(0, total - 1)) AS n FROM n)
SELECT id, CAST(n AS INTEGER) AS n, total, sha256(array_to_string(w[n * 60 + 1 : n * 60 + 75], '')) AS checksum, len(w[n * 60 + 1 : n * 60 + 75]) AS tokens, n > 0 AS overlap_start, n + 1 < total AS overlap_end,
  array_to_string(w, '') = text AS whole FROM k""")
def lossless_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return building.lossless_pieces(table(spark, sf, "documents"), "doc_id", "text", 75, 15)


@query("V21", with_views("chunks", """
w(document_id, ord, batch, n, chars) AS (
  SELECT document_id, ord, 0, 1, length(text) FROM chunks WHERE ord = 0
  UNION ALL SELECT c.document_id, c.ord, CASE WHEN n >= 8 OR chars + length(text) > 1500 THEN batch + 1 ELSE batch END, CASE WHEN n >= 8 OR chars + length(text) > 1500 THEN 1 ELSE n + 1 END,
    CASE WHEN n >= 8 OR chars + length(text) > 1500 THEN length(text) ELSE chars + length(text) END FROM w JOIN chunks c ON c.document_id = w.document_id AND c.ord = w.ord + 1)
SELECT document_id, ord, batch FROM w"""))
def embedding_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's lines in batches of at most 8 and 1500 characters."""
    c = chunks(spark, sf).select("document_id", "ord", F.length("text").alias("size"))
    return building.text_batches(c, "document_id", "ord", "size", 8, 1500)


_PLACE = "instr('0123456789abcdef', md5(w)[1]) - 1"


@query("V20 V22", f"""
WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS ws FROM conversations),
u AS (SELECT conv_id, turn, unnest(ws) AS w FROM t),
d AS (SELECT conv_id, turn, {_PLACE} AS at, sum(CASE WHEN instr('0123456789abcdef', md5(w)[2]) > 8 THEN -1.0 ELSE 1.0 END)::DOUBLE AS x FROM u GROUP BY ALL),
g AS (SELECT conv_id, turn, sqrt(sum(x * x)) AS norm, sum(x) AS total, max(abs(x)) AS top FROM d GROUP BY ALL),
s AS (SELECT conv_id, turn, count(DISTINCT w) AS terms FROM u GROUP BY ALL)
SELECT t.conv_id, t.turn, len(ws) AS tokens, coalesce(terms, 0) AS terms, round(CASE WHEN norm > 0 THEN total / norm ELSE 0 END, 6)::DOUBLE AS dense_sum, round(CASE WHEN norm > 0 THEN top / norm ELSE 0 END, 6)::DOUBLE AS dense_top
FROM t LEFT JOIN g USING (conv_id, turn) LEFT JOIN s USING (conv_id, turn)""")
def embedding_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Dense, sparse and token parts of each turn by a hash embedder, in one row."""
    c = building.hash_bundle(table(spark, sf, "conversations"), ["conv_id", "turn"], "text")
    total = F.aggregate("dense", F.lit(0.0), lambda s, x: s + x)
    return c.select(
        "conv_id", "turn", "tokens", F.size("sparse").cast("bigint").alias("terms"), F.round(total, 6).alias("dense_sum"),
        F.round(F.array_max(F.transform("dense", F.abs)), 6).alias("dense_top"),
    )


def _sections(spark: SparkSession, sf: str) -> DataFrame:
    s = ingest.markdown_sections(marked_down(spark, sf))
    key = F.concat_ws("#", F.col("doc").cast("string"), F.col("n").cast("string"))
    return s.select(F.col("doc").alias("document_id"), key.alias("section_id"), F.col("n").cast("bigint").alias("ord"), F.col("level").cast("bigint").alias("level"), F.col("title").alias("heading"), "text")


@query("K01 K03 K11")
def greedy_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Sections joined by structure, tails balanced, oversize ones split (no SQL: each depends on those before it; tested by hand-made sections)."""
    c = chunking.assembler("greedy")(_sections(spark, sf), least=60, target=200, hard=400)
    return c.withColumn("sections", F.size("section_ids")).drop("section_ids")


@query("K06 K08")
def semantic_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Sections cut where sentences stop being alike (no SQL: likewise)."""
    return chunking.assembler("semantic")(_sections(spark, sf), target=120, least=20).drop("section_ids")
