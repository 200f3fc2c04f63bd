"""Documents and sections of Markdown and HTML.

Tasks read each text into blocks; sections, ids, checksums and paths are made of
these by Spark. All that is grouped or sorted together is one document's blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfathom.functions.scalars import slug
from inkfathom.sources import html as pages_of
from inkfathom.sources.markdown import document_blocks, rendered

_BLOCK = "kind string, level int, text string, said string, start int, end int"
_PARSED = f"uri string, front string, body string, blocks array<struct<{_BLOCK.replace(' ', ':').replace(',:', ',')}>>"


def parsed_markdown(docs: DataFrame, uri_col: str = "uri", text_col: str = "text") -> DataFrame:
    """uri, front (JSON), body (the text without it) and blocks (kind, level, text, said, start, end)."""
    rows = docs.select(F.col(uri_col).cast("string").alias("uri"), F.col(text_col).alias("text"))
    kinds = [("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("said", pa.string()), ("start", pa.int32()), ("end", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                found = [document_blocks(t.as_py()) for t in part.column("text")]
                made = [[{"kind": x.kind, "level": x.level, "text": x.text, "said": rendered(x), "start": x.start, "end": x.end} for x in bs] for _, _, bs in found]
                columns = [part.column("uri"), pa.array([f for f, _, _ in found]), pa.array([t for _, t, _ in found]), pa.array(made, pa.list_(pa.struct(kinds)))]
                yield pa.RecordBatch.from_arrays(columns, names=["uri", "front", "body", "blocks"])

    return rows.mapInArrow(run, _PARSED)


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("bigint")


def document_id(uri: Column) -> Column:
    return F.sha2(F.lower(F.trim(uri)), 256)


def _first_line(body: Column) -> Column:
    """The first heading-like line, else the first line of at most 100 characters, else Untitled."""
    head = F.regexp_extract(body, r"(?m)^#+\s*(.+)$", 1)
    lines = F.filter(F.transform(F.split(body, "\n"), F.trim), lambda x: x != "")
    return F.coalesce(F.when(head != "", F.trim(head)), F.substring(F.get(lines, F.lit(0)), 1, 100), F.lit("Untitled"))


def markdown_documents(parsed: DataFrame) -> DataFrame:
    """id, uri, title, version, front_matter (VARIANT): the title is that of the front matter, the first heading or the first line."""
    heading = F.get(F.filter("blocks", lambda b: b["kind"] == "heading"), F.lit(0))["text"]
    said = lambda name: F.get_json_object("front", f"$.{name}")
    title = F.coalesce(F.nullif(said("title"), F.lit("")), F.nullif(heading, F.lit("")), _first_line(F.col("body")))
    return parsed.select(
        document_id(F.col("uri")).alias("id"), "uri", title.alias("title"), F.coalesce(said("version"), F.lit("1.0")).alias("version"),
        F.parse_json("front").alias("front_matter"),
    )


def markdown_sections(parsed: DataFrame) -> DataFrame:
    """Sections of parsed texts, a row each.

    A heading begins one; blocks before the first belong to none. A section without
    content stands for its title if it is deeper than level 1, else it is left out. A
    text without headings is one section. Lines count from 0 after the front matter;
    ``line_end`` is the line after the last block.
    """
    with_place = F.transform("blocks", lambda b, i: b.withField("place", i))
    blocks = parsed.select("uri", F.inline(with_place))
    w = Window.partitionBy("uri").orderBy("place")
    placed = blocks.withColumn("n", F.sum((F.col("kind") == "heading").cast("int")).over(w)).where("n > 0")
    content = F.col("said").isNotNull()
    own = F.sort_array(F.collect_list(F.when(content, F.struct("place", "kind", "said", "text"))))
    head = lambda c: F.max(F.when(F.col("kind") == "heading", F.col(c))).alias(c)
    ends = F.max(F.when(content | F.col("kind").isin("heading", "html", "rule"), F.col("end"))).alias("line_end")
    sections = placed.groupBy("uri", "n").agg(head("level"), head("text"), head("start"), ends, own.alias("own")).withColumnRenamed("text", "title")
    above = Window.partitionBy("uri").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    path, top = [], F.lit(0)
    for level in range(1, 6):
        # The last heading of this level counts if none shallower came after it.
        at = F.max(F.when(F.col("level") == level, F.col("n"))).over(above)
        name = F.max_by(F.when(F.col("level") == level, F.col("title")), F.when(F.col("level") == level, F.col("n"))).over(above)
        path.append(F.when((F.col("level") > level) & (at > top), name))
        top = F.greatest(top, F.coalesce(at, F.lit(0)))
    sections = sections.withColumn("parent_path", F.concat_ws(" > ", *path))
    of = lambda kind: F.transform(F.filter("own", lambda x: x["kind"] == kind), lambda x: x["text"])
    body = F.array_join(F.transform("own", lambda x: x["said"]), "\n\n")
    bare = (_squeezed(body) == "") & (F.size(of("code")) == 0) & (F.size(of("table")) == 0)
    made = sections.select(
        "uri", "n", "level", "title", "parent_path", F.col("start").alias("line_start"), "line_end", bare.alias("is_heading_only"),
        F.when(bare, F.trim("title")).otherwise(body).alias("text"), F.transform("own", lambda x: x["kind"]).alias("block_types"),
        of("code").alias("code_blocks"), of("table").alias("tables"),
    ).where("not is_heading_only or (level > 1 and text <> '')")
    none = F.array().cast("array<string>")
    headless = parsed.where(~F.exists("blocks", lambda b: b["kind"] == "heading") & (_squeezed(F.col("body")) != "")).select(
        "uri", F.lit(1).alias("n"), F.lit(1).alias("level"), _first_line(F.col("body")).alias("title"), F.lit("").alias("parent_path"), F.lit(0).alias("line_start"),
        F.lit(None).cast("int").alias("line_end"), F.lit(False).alias("is_heading_only"), F.col("body").alias("text"), F.array(F.lit("paragraph")).alias("block_types"),
        none.alias("code_blocks"), none.alias("tables"),
    )
    both = made.unionByName(headless)
    share = F.when(F.size("block_types") > 0, F.size(F.filter("block_types", lambda k: k == "code")) / F.size("block_types")).otherwise(0.0)
    both = both.withColumns(
        {
            "order": F.row_number().over(Window.partitionBy("uri").orderBy("n")) - 1, "anchor": slug("title"), "checksum": F.sha2(_squeezed(F.col("text")), 256),
            "tokens": _words(F.col("text")), "code_ratio": F.bround(share, 3), "document_id": document_id(F.col("uri")),
        }
    )
    identity = F.sha2(F.concat("uri", F.lit("#"), "anchor", F.lit("|"), "checksum"), 256)
    return both.withColumn("id", identity).drop("n")


def html_sections(pages: DataFrame, uri_col: str = "url", html_col: str = "html") -> DataFrame:
    """uri, order, level, title, anchor, text, code_blocks, tables, checksum, tokens, id, document_id of each section of a page."""
    rows = pages.select(F.col(uri_col).cast("string").alias("uri"), F.col(html_col).alias("html"))
    schema = "uri string, order int, level int, title string, anchor string, text string, code_blocks array<string>, tables array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                made = [(u, *s) for u, h in zip(part.column("uri").to_pylist(), part.column("html")) for s in pages_of.tree_sections(h.as_py() or "")]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
                columns = zip(*made) if made else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=re.findall(r"(\w+) (?:string|int|array)", schema))

    squeezed = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("text"), r"(?U)^\s+|\s+$", ""), "\r\n", "\n"), " +", " ")
    normal = F.regexp_replace(squeezed, "\n\n+", "\n\n")
    return rows.mapInArrow(run, schema).withColumns(
        {
            "checksum": F.sha2("text", 256), "tokens": _words(F.col("text")), "document_id": document_id(F.col("uri")),
            "id": F.sha2(F.concat(F.trim("uri"), F.lit("#"), F.trim("anchor"), normal), 256),
        }
    )
