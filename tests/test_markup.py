"""Markdown blocks, front matter and HTML trees."""

import hashlib
import json
import re

from pyspark.sql import functions as F

from inkfathom.operators import markup
from inkfathom.sources import html
from inkfathom.sources.markdown import blocks, document_blocks, list_text


def kinds(text):
    return [(b.kind, b.start, b.end) for b in document_blocks(text)[2]]


def test_block_kinds_and_lines():
    text = "Lead\n====\n\nOne\ntwo\n\n~~~ py\n# not a heading\n```\n~~~\n    - not code, as no\n\n* a\n* b\n\n| x | y |\n|:-|-:|\n| 1 |\nafter\n> q\n> > deeper\nlazy\n\n***\n\n    code\n\n    more\n\n<div>\nraw\n\n### End ##\n"
    assert kinds(text) == [
        ("heading", 0, 2), ("paragraph", 3, 5), ("code", 6, 10), ("code", 10, 11), ("list", 12, 15), ("table", 15, 19), ("blockquote", 19, 22),
        ("rule", 23, 24), ("code", 25, 28), ("html", 29, 31), ("heading", 32, 33),
    ]
    got = document_blocks(text)[2]
    assert [(b.level, b.text) for b in got if b.kind == "heading"] == [(1, "Lead"), (3, "End")]
    assert got[2].lang == "py" and got[2].text == "# not a heading\n```\n" and got[8].text == "code\n\nmore\n"
    assert got[5].text == "x | y\n1 | \nafter | "


def test_lists_are_containers():
    (b,) = blocks("1. one\n   still one\n2. two\n   - in\n     - deeper\n   - in too\n\n   second par\n3. three\n   ```\n   1. code\n   ```".split("\n"))
    assert (b.kind, b.ordered, b.start, b.end, len(b.items)) == ("list", True, 0, 12, 3)
    assert [x.kind for x in b.items[1]] == ["paragraph", "list", "paragraph"] and b.items[1][1].start == 3
    assert list_text(b) == "1. one\nstill one\n2. two   - in   - deeper\n  - in too second par\n3. three"
    assert [x.kind for x in blocks(["- a", "+ b", "1. c", "1) d"])] == ["list"] * 4
    deep = blocks([">" * 5000 + " x"])
    assert deep[0].kind == "blockquote" and [x.kind for x in blocks(["-" + " -" * 300 + " x"])] == ["list"]


def sections(spark, *docs):
    d = spark.createDataFrame([(f"test://{i}.md", t, "x", "y") for i, t in enumerate(docs)], "uri string, text string, title string, id string")
    return sorted(markup.markdown_sections(markup.parsed_markdown(d)).collect(), key=lambda r: (r["uri"], r["order"]))


def test_sections(spark):
    text = "before any heading\n\n# Parent!\n\nContent.\n\n## Child\n\n### Grand child\n\nDeep.\n\n## Sibling\n\n```\nx = 1\n```\n\ntext\n\n| a |\n|---|\n| b |\n\n# Empty\n"
    got = sections(spark, text)
    assert [(r["order"], r["level"], r["title"], r["parent_path"]) for r in got] == [
        (0, 1, "Parent!", ""), (1, 2, "Child", "Parent!"), (2, 3, "Grand child", "Parent! > Child"), (3, 2, "Sibling", "Parent!"),
    ]
    assert [(r["line_start"], r["line_end"]) for r in got] == [(2, 5), (6, 7), (8, 11), (12, 23)]
    assert [r["block_types"] for r in got] == [["paragraph"], [], ["paragraph"], ["code", "paragraph", "table"]]
    assert [r["is_heading_only"] for r in got] == [False, True, False, False] and got[1]["text"] == "Child"
    last = got[3]
    assert last["code_ratio"] == 0.333 and last["code_blocks"] == ["x = 1\n"] and last["tables"] == ["a\nb"] and last["anchor"] == "sibling"
    assert last["text"] == "[CODE]\nx = 1\n\n[/CODE]\n\ntext\n\n[TABLE]\na\nb\n[/TABLE]"
    for r in got:
        checksum = hashlib.sha256(re.sub(r"\s+", " ", r["text"].strip()).encode()).hexdigest()
        assert r["checksum"] == checksum and r["tokens"] == len(r["text"].split())
        assert r["id"] == hashlib.sha256(f"test://0.md#{r['anchor']}|{checksum}".encode()).hexdigest()
        assert r["document_id"] == hashlib.sha256(b"test://0.md").hexdigest()


def test_levels_headless_and_empty_texts(spark):
    six = "\n".join(f"{'#' * i} H{i}\n\nbody {i}\n" for i in range(1, 7))
    got = sections(spark, six, "Just some content\nwithout headings.\n", None, "", "  \n")
    assert [r["level"] for r in got if r["uri"] == "test://0.md"] == [1, 2, 3, 4, 5, 6]
    assert [r["parent_path"] for r in got][5] == "H1 > H2 > H3 > H4 > H5"
    (one,) = [r for r in got if r["uri"] == "test://1.md"]
    assert (one["title"], one["block_types"], one["line_start"], one["line_end"]) == ("Just some content", ["paragraph"], 0, None)
    assert {r["uri"] for r in got} == {"test://0.md", "test://1.md"}


def test_front_matter(spark):
    texts = [
        '---\ntitle: My Document\nversion: "2.0"\nauthor: {name: Test, tags: [a, b]}\n---\n# Other\n\nx\n', "# Just a Heading\n", "---\n: [broken\n---\n\ntext here\n", "---\nversion: 3\n---\nplain\n", None,
    ]
    d = spark.createDataFrame([(f" T{i} ", t) for i, t in enumerate(texts)], "uri string, text string")
    got = sorted(markup.markdown_documents(markup.parsed_markdown(d)).withColumn("json", F.to_json("front_matter")).withColumn("tag", F.variant_get("front_matter", "$.author.tags[1]", "string")).collect(), key=lambda r: r["uri"])
    assert [r["title"] for r in got] == ["My Document", "Just a Heading", ": [broken", "plain", "Untitled"]
    assert [r["version"] for r in got] == ["2.0", "1.0", "1.0", "3", "1.0"] and got[0]["tag"] == "b"
    assert json.loads(got[0]["json"])["author"] == {"name": "Test", "tags": ["a", "b"]} and got[1]["json"] == "{}"
    assert got[0]["id"] == hashlib.sha256(b"t0").hexdigest()


PAGE = """<html><head><title> The page </title></head><body><header><h1>Top</h1></header><div class="sidebar"><p>menu menu menu</p></div>
<div class="Page-Content"><p>before the first heading</p><h1>One &amp; two</h1><p>A first paragraph<p>A second <b>bold</b> one
<ul><li>an item here<li>another item</ul><table><tr><th>k<th>v<tr><td>a<td><table><tr><td>in</td><td>ner</td></tr></table><tr><td>b<td>c</table>
<nav><p>skipped in the nav</p></nav><pre><code>x = 1
</code></pre><h2 id="own">Sub</h2><p>short</p><code>y()</code></div><p>after it all, outside</p></body></html>"""


def test_html_tree(spark):
    got = html.tree_sections(PAGE)
    assert [s[:4] for s in got] == [(0, 1, "One & two", "one-two"), (1, 2, "Sub", "own")]
    assert got[0][6] == ["k | v\na | inner | in | ner\nin | ner\nb | c", "in | ner"] and got[0][5] == ["x = 1\n"]
    assert got[0][4].split("\n\n")[:3] == ["A first paragraph", "A second bold one", "an item here another item"]
    assert got[1][4] == "[CODE]\ny()\n[/CODE]" and "skipped" not in got[0][4] and "outside" not in got[1][4]
    assert [s[1:4] for s in html.tree_sections("<title>T</title><p>no headings <b>here</b>")] == [(1, "T", "content")]
    assert html.tree_sections("")[0][4] == ""
    for main in ("<article><h1>a</h1></article><main><h1>m</h1></main>", "<div class=content><h1>x</h1></div><article><h1>m</h1></article>"):
        assert html.tree_sections(main)[0][2] == "m"
    d = spark.createDataFrame([("http://a/ ", PAGE, "t"), (None, None, None)], "url string, html string, text string")
    rows = markup.html_sections(d).where("uri is not null").orderBy("order").collect()
    text = rows[1]["text"]
    assert rows[1]["id"] == hashlib.sha256(f"http://a/#own{text.strip()}".encode()).hexdigest() and rows[1]["checksum"] == hashlib.sha256(text.encode()).hexdigest()
    assert len(rows) == 2 and rows[0]["tokens"] == len(rows[0]["text"].split())


def test_nested_tables_against_a_plain_reading():
    """Random tables, written with all their end tags, against a reading that counts them."""
    import random

    rng = random.Random(1)

    def make(depth):
        rows = []
        for _ in range(rng.randint(1, 3)):
            cells = [make(depth - 1) if depth and rng.random() < 0.3 else f"c{rng.randint(0, 99)}" for _ in range(rng.randint(1, 3))]
            rows.append(cells)
        return rows

    say = lambda t: "<table>" + "".join("<tr>" + "".join(f"<td>{say(c) if isinstance(c, list) else c}</td>" for c in r) + "</tr>" for r in t) + "</table>"
    flat = lambda t: "".join(flat(c) if isinstance(c, list) else c for r in t for c in r)

    def cells(row):
        return [x for c in row for x in ([flat(c), *(y for r in c for y in cells(r))] if isinstance(c, list) else [c])]

    def lines(t):
        return [x for r in t for x in (" | ".join(cells(r)), *(y for c in r if isinstance(c, list) for y in lines(c)))]

    for _ in range(60):
        t = make(3)
        found = next(x for x in html.tree(say(t)).walk() if x.tag == "table")
        assert html.table_text(found) == "\n".join(lines(t))


def test_a_product_names_its_own_command(spark):
    from inkfathom.functions import scalars
    from inkfathom.operators import ingest

    q = spark.createDataFrame([("acme status of the command",), ("acme mount x",)], "q string")
    got = [tuple(r) for r in q.select(scalars.query_type(F.col("q")), scalars.query_type(F.col("q"), "acme"), scalars.linked(F.col("q"))["command"], scalars.linked(F.col("q"), "acme")["command"]).collect()]
    assert got == [("conceptual", "cli", None, "acme status"), ("conceptual", "conceptual", None, "acme mount")]
    code = spark.createDataFrame([(1, "`acme up` and `git pull`")], "i int, t string")
    assert {r["name"] for r in ingest.commands(code, "i", "t").collect()} == {"git"} and {r["name"] for r in ingest.commands(code, "i", "t", ("acme",)).collect()} == {"git", "acme"}
