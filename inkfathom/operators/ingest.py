"""From raw texts to sections, chunks, entities and references."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

HEADING = r"^(#{1,6})\s+(.*?)\s*#*$"
FENCE = r"^\s*```"
#: Words that begin a command line.
STARTERS = "sudo docker kubectl curl git npm pip python bash systemctl ls cd cp mv cat grep mount umount aws ssh".split()


def markdown_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each section: doc, n, level, title, parent_path, text, tokens,
    has_code, has_table, checksum.

    A heading outside fenced code begins a section; what stands before the first
    is section 0 of level 1 without title. Front matter is left out. Lines are
    numbered by ``posexplode``, so nothing but a document's own lines is sorted.
    """
    body = F.regexp_replace(text_col, r"(?s)\A---\n.*?\n---\n", "")
    lines = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(body, "\n")).alias("line", "text"))
    w = Window.partitionBy("doc").orderBy("line")
    fence = F.col("text").rlike(FENCE)
    lines = lines.withColumn("fenced", (F.sum(fence.cast("int")).over(w) % 2 == 1) | fence)
    head = ~F.col("fenced") & F.col("text").rlike(HEADING)
    lines = lines.withColumn("n", F.sum(head.cast("int")).over(w))
    first = F.min_by(F.when(F.col("n") > 0, F.struct(F.length(F.regexp_extract("text", HEADING, 1)).alias("level"), F.regexp_extract("text", HEADING, 2).alias("title"))), "line")
    rows = F.sort_array(F.collect_list(F.when(~head, F.struct("line", "text"))))
    sections = lines.groupBy("doc", "n").agg(
        first.alias("h"), F.array_join(rows["text"], "\n").alias("text"), F.max("fenced").alias("has_code"),
        F.max(F.col("text").rlike(r"^\s*\|.*\|\s*$")).alias("has_table"),
    )
    s = sections.select(
        "doc", "n", F.coalesce("h.level", F.lit(1)).alias("level"), F.coalesce("h.title", F.lit("")).alias("title"), "text", "has_code", "has_table"
    )
    s = s.where((F.col("n") > 0) | (F.trim("text") != ""))
    return s.withColumn("parent_path", parent_path(s)).withColumn(
        "tokens", F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("bigint")
    ).withColumn("checksum", F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256))


def parent_path(sections: DataFrame) -> Column:
    """Titles of the headings above, joined by `` > ``: of each shallower level
    the last heading, if none shallower has come since."""
    w = Window.partitionBy("doc").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    parts: list[Column] = []
    above = F.lit(-1)
    for level in range(1, 6):
        here = F.col("level") == level
        at = F.max(F.when(here, F.col("n"))).over(w)
        title = F.last(F.when(here, F.col("title")), ignorenulls=True).over(w)
        live = (F.col("level") > level) & (at > above)
        parts.append(F.when(live, title))
        above = F.greatest(above, F.coalesce(at, F.lit(-1)))
    return F.concat_ws(" > ", *parts)


def found_spans(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


#: Patterns of configuration names, their kind and how sure they are.
CONFIGS = (
    (r"(/etc/[a-z0-9/\-_.]+\.(?:conf|cfg))", "file", 0.85),
    (r"([a-z0-9\-_]+\.(?:yaml|yml|json|toml|ini))", "file", 0.85),
    (r"([A-Z_][A-Z0-9_]{2,})\s*=", "parameter", 0.75),
    (r"`([a-z][a-z0-9\-_.]+)`\s*:\s*", "parameter", 0.75),
    (r"--([a-z][a-z0-9\-]+)(?:\s|=)", "parameter", 0.75),
    (r"\$\{([A-Z][A-Z0-9_]+)\}", "environment", 0.9),
    (r"\$([A-Z][A-Z0-9_]+)(?:\s|$|/)", "environment", 0.9),
)


def _tagged(found: Column, name: str, kind: str, confidence: float) -> Column:
    """An array of matches as structs that say what they are."""
    return F.transform(
        found, lambda x: F.struct(x.alias(name), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))
    )


def configurations(sections: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """section, name, kind, confidence: each name once, by its surest pattern."""
    found = F.concat(*(_tagged(found_spans(F.col(text_col), p), "name", k, c) for p, k, c in CONFIGS))
    rows = sections.select(F.col(id_col).alias("section"), F.inline(found)).where(F.length("name") > 2)
    best = F.max_by("kind", F.struct("confidence", "kind"))
    return rows.groupBy("section", "name").agg(best.alias("kind"), F.max("confidence").alias("confidence"))


def commands(sections: DataFrame, id_col: str, text_col: str, tools: tuple[str, ...] = ()) -> DataFrame:
    """section, name, command, confidence: lines of fenced code and inline code that begin like a command, or like one of ``tools``."""
    text = F.col(text_col)
    code = F.transform(found_spans(text, r"(?s)```[a-z]*\n(.*?)```"), lambda b: F.split(b, "\n"))
    lines = F.transform(F.flatten(code), lambda x: F.struct(F.trim(x).alias("command"), F.lit(0.9).alias("confidence")))
    inline = F.transform(found_spans(text, r"(?<!`)`([^`\n]+)`(?!`)"), lambda x: F.struct(F.trim(x).alias("command"), F.lit(0.85).alias("confidence")))
    rows = sections.select(F.col(id_col).alias("section"), F.inline(F.concat(lines, inline)))
    name = F.split_part("command", F.lit(" "), F.lit(1))
    rows = rows.withColumn("name", name).where(F.col("name").isin(*STARTERS, *tools))
    return rows.groupBy("section", "name").agg(F.max_by("command", F.struct("confidence", "command")).alias("command"), F.max("confidence").alias("confidence"))


def procedures(sections: DataFrame, id_col: str, title_col: str, text_col: str) -> DataFrame:
    """section, procedure_id, step_id, ord, instruction of numbered steps."""
    text = F.col(text_col)
    step = r"(?m)^\s*(\d+)[.)]\s+(.+)$"
    both = F.arrays_zip(found_spans(text, step, 1).alias("ord"), found_spans(text, step, 2).alias("instruction"))
    rows = sections.select(F.col(id_col).cast("string").alias("section"), F.lower(title_col).alias("title"), F.inline(both))
    short = lambda *parts: F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
    body = F.trim("instruction")
    return rows.select(
        "section", short(F.lit("proc"), F.col("section"), F.col("title")).alias("procedure_id"),
        short(F.lit("step"), F.col("section"), F.col("ord"), F.substring(F.lower(body), 1, 50)).alias("step_id"),
        F.col("ord").cast("bigint").alias("ord"), body.alias("instruction"),
    )


#: Kinds of references, surest first.
REFERENCES = (
    ("hyperlink", r"(?i)\[([^\]]+)\]\([^)]+\.md\)", 0.95),
    ("see_also", r"(?i)see\s+also:?\s+([A-Z][^\n.,\[]{0,200})", 0.85),
    ("related", r"(?i)related:\s*([A-Z][^\n.,\[]{0,200})", 0.80),
    ("refer_to", r"(?i)refer\s+to\s+(?:the\s+)?([A-Z][^.\n]{0,200}?(?:Guide|Manual|Documentation|Configuration))", 0.70),
)


def references(chunks: DataFrame, doc_col: str, id_col: str, text_col: str, kinds: tuple[str, ...] = ("hyperlink", "see_also", "related", "refer_to")) -> DataFrame:
    """document, source, hint, kind, confidence: each hint of a document once, by its surest kind, then first chunk."""
    found = F.concat(*(_tagged(found_spans(F.col(text_col), p), "hint", k, c) for k, p, c in REFERENCES if k in kinds))
    rows = chunks.select(F.col(doc_col).alias("document"), F.col(id_col).alias("source"), F.inline(found))
    rows = rows.withColumn("hint", F.trim("hint")).where("hint <> ''")
    w = Window.partitionBy("document", F.lower("hint")).orderBy(F.desc("confidence"), "source", "hint")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def resolve(references_: DataFrame, titles: DataFrame) -> DataFrame:
    """Adds target and state: resolved where a document has the title, else ghost.

    ``titles``: document_id, title; of equal titles the least id wins.
    """
    by_title = titles.groupBy(F.lower(F.trim("title")).alias("key")).agg(F.min("document_id").alias("target"))
    joined = references_.withColumn("key", F.lower(F.trim("hint"))).join(by_title, "key", "left").drop("key")
    return joined.withColumn("state", F.when(F.col("target").isNotNull(), "resolved").otherwise("ghost"))


def token_windows(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """id, n, text, tokens: windows of ``size`` words, each ``overlap`` words into the one before."""
    words = F.filter(F.split(text_col, r"\s+"), lambda w: w != "")
    step = max(1, size - overlap)
    d = docs.select(F.col(id_col).alias("id"), words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - overlap) / F.lit(step)) - 1)
    rows = d.select("id", "w", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("n"))
    part = F.slice("w", F.col("n") * step + 1, F.lit(size))
    return rows.select("id", "n", F.array_join(part, " ").alias("text"), F.size(part).cast("bigint").alias("tokens"))


#: First words of names that are looked up before runs are made of the words.
_HEADS = 2000


def longest_entities(docs: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str, most: int = 5) -> DataFrame:
    """id, place, entity: names found in each text's lower-case words, from left to
    right, at each word the longest of at most ``most`` words; a match's words
    are not looked at again.

    Runs of words meet the names by an equi-join: those that begin with a name's first
    word, or all if names have more than ``_HEADS`` first words. What is taken depends on
    the matches before it, hence a fold over each text's own matches.
    """
    words = F.split(F.lower(F.trim(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"\s+", " "))), " ")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words.alias("w"))
    run = lambda at, n: F.struct(at.alias("place"), n.alias("n"), F.array_join(F.slice("w", at, n), " ").alias("entity"))
    sizes = lambda at: F.sequence(F.lit(1), F.least(F.lit(most), F.size("w") - at + 1))
    known = names.select(F.lower(F.trim(F.regexp_replace(name_col, r"\s+", " "))).alias("entity")).where("entity <> ''").distinct()
    heads = [r["head"] for r in known.select(F.split_part("entity", F.lit(" "), F.lit(1)).alias("head")).distinct().limit(_HEADS + 1).collect()]
    places = F.sequence(F.lit(1), F.size("w"))
    if len(heads) <= _HEADS:
        places = F.filter(places, lambda at: F.element_at("w", at).isin(heads))
    every = F.flatten(F.transform(places, lambda at: F.transform(sizes(at), lambda n: run(at, n))))
    runs = rows.select("row", "id", F.inline(every))
    hits = runs.join(known, "entity")
    best = hits.groupBy("row", "id", "place").agg(F.max(F.struct("n", "entity")).alias("m"))
    listed = best.groupBy("row", "id").agg(F.sort_array(F.collect_list(F.struct("place", "m.n", "m.entity"))).alias("l"))
    kind = "array<struct<place:int,n:int,entity:string>>"
    taken = F.aggregate(
        "l",
        F.array().cast(kind),
        lambda done, x: F.when((F.size(done) > 0) & (x["place"] < F.element_at(done, -1)["place"] + F.element_at(done, -1)["n"]), done).otherwise(F.concat(done, F.array(x))),
    )
    return listed.select("id", F.inline(taken.cast(kind))).select("id", "place", "entity")


def mark_micro(chunks: DataFrame, limit: int = 200) -> DataFrame:
    """Adds document_total_tokens and doc_is_microdoc."""
    total = F.sum("token_count").over(Window.partitionBy("document_id"))
    return chunks.withColumn("document_total_tokens", total).withColumn("doc_is_microdoc", F.col("document_total_tokens") <= limit)


def collapse_small(chunks: DataFrame, limit: int) -> DataFrame:
    """Documents of at most ``limit`` tokens as one chunk, others as they are."""
    c = mark_micro(chunks, limit)
    small = c.where("doc_is_microdoc").groupBy("document_id").agg(
        F.min_by("chunk_id", "ord").alias("chunk_id"), F.min("ord").alias("ord"), F.sum("token_count").alias("token_count"), F.count("*").alias("parts")
    )
    rest = c.where("not doc_is_microdoc").select("document_id", "chunk_id", "ord", "token_count", F.lit(1).cast("bigint").alias("parts"))
    return small.unionByName(rest)


#: Pages whose sections are given at once.
_PAGES = 50


def html_sections(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page, n, level, title, text: headings begin sections; navigation, headers,
    footers, scripts and styles are skipped; a page without headings is one."""
    from inkfathom.sources.html import sections_of

    id_type = pages.schema[id_col].dataType.simpleString()

    schema = f"page {id_type}, n int, level int, title string, text string"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _PAGES):  # so many pages are held as Python's own values, not a whole batch
                part = b.slice(at, _PAGES)
                rows = [(page, *s) for page, html in zip(part.column(0).to_pylist(), part.column(1)) for s in sections_of(html.as_py() or "")]
                columns = zip(*rows) if rows else [[]] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, out)], schema=out)

    return pages.select(F.col(id_col).alias("page"), F.col(html_col).alias("html")).mapInArrow(run, schema)
