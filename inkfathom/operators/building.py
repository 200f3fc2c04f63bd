"""Building the store: references by containment and by likeness, mentions, metadata, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfathom.operators.ordered import by_group
from inkfathom.operators.search import term_counts, terms, top_k


def _grams(text: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def containing(wide: DataFrame, narrow: DataFrame) -> DataFrame:
    """text, part of every pair in which the text contains the part (not empty).

    ``wide``: distinct texts; ``narrow``: distinct parts. A part meets only texts
    that have its rarest three letters (or itself, if it is no longer), by an equi-join.
    """
    text, part = F.col("text"), F.col("part")
    w = wide.where("text <> ''").select("text", F.explode(F.array_distinct(F.concat(*(_grams(text, n) for n in (1, 2, 3))))).alias("gram"))
    counts = w.groupBy("gram").agg(F.count("*").alias("n"))
    own = F.when(F.length(part) <= 3, F.array(part)).otherwise(F.array_distinct(_grams(part, 3)))
    named = narrow.where("part <> ''").select("part", F.explode(own).alias("gram")).join(counts, "gram", "left")
    rarest = named.groupBy("part").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(w, "gram").where(F.contains("text", "part")).select("text", "part")


def arrived(references: DataFrame, titles: DataFrame) -> DataFrame:
    """References after new documents have come: document, hint, state, target.

    ``references``: document, hint, state (resolved, ghost, pending), target;
    ``titles``: document_id, title of the new ones. A ghost takes the document of
    its very title, a pending one a document whose title contains its hint or is
    contained in it; of several the least id. Whatever their case.
    """
    new = titles.groupBy(F.lower("title").alias("title")).agg(F.min("document_id").alias("found")).where("title <> ''")
    refs = references.withColumn("low", F.lower("hint"))
    hints = refs.where("state = 'pending'").select("low").distinct()
    own = new.select("title")
    longer = containing(own.select(F.col("title").alias("text")), hints.select(F.col("low").alias("part"))).select(F.col("text").alias("title"), F.col("part").alias("low"))
    shorter = containing(hints.select(F.col("low").alias("text")), own.select(F.col("title").alias("part"))).select(F.col("part").alias("title"), F.col("text").alias("low"))
    near = longer.unionByName(shorter).join(new, "title").groupBy("low").agg(F.min("found").alias("near"))
    joined = refs.join(new.select(F.col("title").alias("low"), F.col("found").alias("same")), "low", "left").join(near, "low", "left")
    ghost, pending = F.col("state") == "ghost", F.col("state") == "pending"
    to = F.when(ghost, F.col("same")).when(pending, F.col("near"))
    state = F.when(to.isNull(), F.col("state")).when(ghost, "resolved_from_ghost").otherwise("resolved_from_pending")
    return joined.select("document", "hint", state.alias("state"), F.coalesce("target", to).alias("target"))


def fuzzy(hints: DataFrame, titles: DataFrame, least: float = 0.5, penalty: float = 0.25, shortest: int = 3) -> DataFrame:
    """query_id, state, id, score, confidence of each hint.

    ``hints``: query_id, text, confidence; ``titles``: id, text. A title fits that has the
    hint's words one after the other; its score is the BM25 of the phrase (the sum of its
    words' inverse frequencies, by how often the phrase comes and the title's length),
    which has to be above ``least``. The best is taken, of equal ones the shorter title, then
    the least id. A hint of fewer than ``shortest`` characters, or that no title fits, is pending.
    """
    said = lambda c: F.concat(F.lit(" "), F.array_join(terms(c), " "), F.lit(" "))
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", r"[\x00-\x1F\x7F]", " "), r"\s+", " "))
    h = hints.select("query_id", "confidence", F.when(F.length(clean) >= shortest, said(clean)).alias("part"))
    t = titles.select("id", said(F.col("text")).alias("padded"), F.length("text").alias("size"))
    asked = h.where("part is not null").select("part").distinct().withColumn("term", F.explode(terms(F.col("part"))))
    counts = term_counts(titles.select("id", "text"), asked)
    stats = counts.where("term = ''").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    df = counts.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rare = asked.join(df, "term").crossJoin(F.broadcast(stats)).groupBy("part").agg(F.sum(idf).alias("idf"), F.first("avgdl").alias("avgdl"))
    met = containing(t.select(F.col("padded").alias("text")).distinct(), asked.select("part").distinct()).join(rare, "part")
    words, phrase = terms(F.col("text")), terms(F.col("part"))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - F.size(phrase) + 1)), lambda i: F.slice(words, i, F.size(phrase)) == phrase)
    freq = F.size(starts)
    score = F.col("idf") * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * F.size(words) / F.col("avgdl")))
    scored = met.select("part", F.col("text").alias("padded"), F.round(score, 6).alias("score")).where(F.col("score") > least)
    # Titles of one text share a score: each text stands for the best of its titles.
    best_title = t.groupBy("padded").agg(F.min(F.struct("size", "id")).alias("best"))
    best = top_k(scored.join(best_title, "padded").select("part", "score", "best.size", "best.id"), "part", [F.desc("score"), "size", "id"], 1)
    j = h.join(best.select("part", "id", "score"), "part", "left")
    found = F.col("id").isNotNull()
    sure = F.when(found, F.greatest(F.lit(0.1), F.col("confidence") - penalty)).otherwise(F.col("confidence"))
    return j.select("query_id", F.when(found, "resolved").otherwise("pending").alias("state"), "id", "score", F.round(sure, 6).alias("confidence"))


def merge_hyperlinks(section_refs: DataFrame, raw_refs: DataFrame) -> DataFrame:
    """References of the sections, and hyperlinks of the raw text whose hint those lack."""
    key = lambda d: d.withColumn("__hint", F.lower("hint"))
    links = key(raw_refs.where("kind = 'hyperlink'"))
    more = links.join(key(section_refs).select("document", "__hint"), ["document", "__hint"], "left_anti").drop("__hint")
    return section_refs.unionByName(more.select(*section_refs.columns))


def remapped_mentions(chunks: DataFrame, structural: DataFrame, named: DataFrame) -> DataFrame:
    """chunk, entity, source: mentions of sections given to the chunks made of them.

    ``chunks``: chunk, section_ids; ``structural``: section, entity, pos;
    ``named``: chunk, entity, pos, by a model, which come first. Each entity once.
    """
    own = chunks.select("chunk", F.explode("section_ids").alias("section")).join(structural, "section")
    both = named.select("chunk", "entity", "pos", F.lit("model").alias("source"), F.lit(0).alias("n")).unionByName(
        own.select("chunk", "entity", "pos", F.lit("pattern").alias("source"), F.lit(1).alias("n"))
    )
    first = F.min(F.struct("n", "pos", "source"))
    return both.groupBy("chunk", "entity").agg(first.alias("f")).select("chunk", "entity", "f.source", F.col("f.pos").alias("pos"))


def canonical_parents(chunks: DataFrame) -> DataFrame:
    """chunk_id, parent_original, parent_chunk_id, outcome: a parent named by an
    original section becomes the chunk that holds it (the first by ord), else null."""
    listed = F.when(F.size("original_ids") > 0, F.col("original_ids")).otherwise(F.array("chunk_id"))
    holders = chunks.select("ord", F.col("chunk_id").alias("parent_chunk_id"), F.explode(listed).alias("parent_original"))
    holder = holders.groupBy("parent_original").agg(F.min_by("parent_chunk_id", F.struct("ord", "parent_chunk_id")).alias("parent_chunk_id"))
    j = chunks.select("chunk_id", "parent_original").join(holder, "parent_original", "left")
    to, own = F.col("parent_chunk_id"), F.col("parent_original")
    outcome = F.when(own.isNull(), "none").when(to.isNull(), "missing").when(to == own, "same").otherwise("remapped")
    return j.withColumn("outcome", outcome)


def updated(rows: DataFrame, news: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the news' values where those are not null."""
    n = news.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    j = rows.join(n, key, "left")
    return j.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def block_type(types: Column, code: Column) -> Column:
    """One word for a section's blocks: code, table, the usual type, or mixed."""
    known = F.filter(F.transform(types, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    n = F.size(known)
    counted = F.transform(F.array_distinct(known), lambda t: F.struct(F.size(F.filter(known, lambda x: x == t)).alias("n"), t.alias("t")))
    best = F.array_max(counted)
    return (
        F.when(F.coalesce(n, F.lit(0)) <= 0, "paragraph").when(code > 0.5, "code").when(F.array_contains(known, "table"), "table")
        .when((best["n"] <= n / 2) & (F.size(F.array_distinct(known)) > 1), "mixed").otherwise(best["t"])
    )


def piece_lines(start: Column, end: Column, index: Column, total: Column) -> tuple[Column, Column]:
    """Lines of a section's piece, as if all pieces had equally many."""
    each = F.greatest(F.lit(1), end - start) / total
    cut = (total > 1) & start.isNotNull() & end.isNotNull()
    at = lambda k: F.floor(start + k * each)
    return F.when(cut, at(index)).otherwise(start), F.when(cut, at(index + 1)).otherwise(end)


#: Names too common to tell anything.
EXCLUDED = ("this", "that", "with", "from")


def enriched(chunks: DataFrame, found: Column, text: str = "text", excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Adds entities, each (name, type) once in order and none excluded, and
    embedding_text, the text with them as context. ``found``: array of struct(name, type)."""
    kind = "array<struct<name:string,type:string>>"
    same = lambda a, b: (F.lower(a["name"]) == F.lower(b["name"])) & (a["type"] == b["type"])
    kept = F.filter(found, lambda x: ~F.lower(x["name"]).isin(*excluded)).cast(kind)
    once = F.aggregate(kept, F.array().cast(kind), lambda seen, x: F.when(F.exists(seen, lambda s: same(s, x)), seen).otherwise(F.concat(seen, F.array(x))))
    c = chunks.withColumn("entities", once)
    listed = F.array_join(F.transform("entities", lambda x: F.concat(x["type"], F.lit(": "), x["name"])), "; ")
    return c.withColumn("embedding_text", F.when(F.size("entities") > 0, F.concat(F.col(text), F.lit("\n\n[Context: "), listed, F.lit("]"))).otherwise(F.col(text)))


#: How documents speak of a command, and words that are none.
DOCUMENTED = (r"(?i)The\s+`([a-z][a-z0-9\-_]+)`\s+command", r"(?i)`([a-z][a-z0-9\-_]+)`\s*-\s+")
NO_COMMANDS = ("and", "the", "for", "with", "from", "this", "that", "are", "can")
YAML_KEY = r"(?im)^[ \t]*([a-z][a-z0-9_\-]+):[ \t]"


def documented_commands(text: Column) -> Column:
    """Names of the commands that a text describes, each once, sorted."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in DOCUMENTED))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~F.lower(x).isin(*NO_COMMANDS))))


def yaml_keys(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(YAML_KEY), F.lit(1))))


def queued(jobs: DataFrame, queue: str, order: list[str], urgent: Column, most: int) -> DataFrame:
    """Adds accepted and place: jobs beyond ``most`` are refused; urgent ones stand
    in front, the latest first, the others behind in order of arrival."""
    w = Window.partitionBy(queue).orderBy(*order)
    j = jobs.withColumn("__n", F.row_number().over(w)).withColumn("accepted", F.col("__n") <= most).withColumn("__urgent", urgent)
    at = Window.partitionBy(queue, "accepted").orderBy(F.desc("__urgent"), F.when(F.col("__urgent"), -F.col("__n")).otherwise(F.col("__n")))
    return j.withColumn("place", F.when(F.col("accepted"), F.row_number().over(at).cast("bigint"))).drop("__n", "__urgent")


def derived_tags(path: Column, content: Column) -> dict[str, Column]:
    """doc_tag, category and scope: a DocTag line, a file name ``scope__tag``, the
    directory after one that ends in ingest, or the file's own name."""
    said = F.nullif(F.regexp_extract(F.coalesce(content, F.lit("")), r"(?i)DocTag:\s*([A-Za-z0-9_\-]+)", 1), F.lit(""))
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    category = F.nullif(F.regexp_extract(path, "^.*?ingest/([^/]+)/", 1), F.lit(""))
    two = F.contains(stem, F.lit("__"))
    scope = F.when(said.isNull() & two, F.regexp_extract(stem, "^(.*?)__", 1))
    tag = F.coalesce(said, F.when(two, F.regexp_extract(stem, "^.*?__(.*)$", 1)), category, stem)
    return {"doc_tag": tag, "category": F.when(said.isNull(), category), "scope": scope}


def microdoc_annotations(chunks: DataFrame, threshold: int) -> DataFrame:
    """Chunks with doc_is_microdoc, and a stub after the last of each small document."""
    total = F.sum("token_count").over(Window.partitionBy("document_id"))
    c = chunks.select("document_id", "chunk_id", "ord", "token_count", total.alias("total"))
    c = c.withColumn("doc_is_microdoc", F.col("total") <= threshold).withColumn("is_stub", F.lit(False))
    small = c.where("doc_is_microdoc").groupBy("document_id").agg(F.max_by("chunk_id", F.struct("ord", "chunk_id")).alias("last"), F.max("ord").alias("ord"), F.count("*").alias("n"), F.first("total").alias("total"))
    name = F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), "last", F.concat(F.lit("microdoc-stub-"), F.col("n").cast("string"))), 256)
    stubs = small.select("document_id", name.alias("chunk_id"), F.col("ord") + 1, F.lit(0).cast("bigint"), "total", F.lit(True), F.lit(True))
    return c.union(stubs)


def lossless_pieces(docs: DataFrame, id_col: str, text_col: str, size: int, overlap: int) -> DataFrame:
    """id, n, total, text, tokens, overlap_start, overlap_end, checksum, whole: windows of
    words with their white space; ``whole``: the new parts together are the text."""
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"(^\s+|\S+\s*)"), F.lit(1))
    step = size - overlap
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__t"), words.alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - overlap) / F.lit(step)) - 1).cast("int")
    part = lambda k: F.slice("w", k * step + 1, F.lit(size))
    news = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.when(k == 0, part(k)).otherwise(F.slice("w", k * step + 1 + overlap, F.lit(step))), ""))
    rows = d.select("id", "w", (F.array_join(news, "") == F.col("__t")).alias("whole"), (last + 1).alias("total"), F.explode(F.sequence(F.lit(0), last)).alias("n"))
    text = F.array_join(part(F.col("n")), "")
    return rows.select(
        "id", "n", F.col("total").cast("bigint").alias("total"), F.sha2(text, 256).alias("checksum"), F.size(part(F.col("n"))).cast("bigint").alias("tokens"),
        (F.col("n") > 0).alias("overlap_start"), (F.col("n") + 1 < F.col("total")).alias("overlap_end"), "whole",
    )


def text_batches(rows: DataFrame, group: str, order: str, size: str, most: int, chars: int) -> DataFrame:
    """group, order, batch: each group's texts in order, at most ``most`` and ``chars``
    characters to a batch. One pass over a group's own sizes, as a batch's end decides the next."""
    kind = {c: rows.schema[c].dataType.simpleString() for c in (group, order)}

    def run(own: list[dict]) -> list[dict]:
        batch, n, used = 0, 0, 0
        for r in own:
            x = r[size]
            if n and (n >= most or used + x > chars):
                batch, n, used = batch + 1, 0, 0
            n, used = n + 1, used + x
            r["batch"] = batch
        return own

    sized = rows.select(group, order, F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias(size))
    return by_group(sized, group, [order, size], run, f"{group} {kind[group]}, {order} {kind[order]}, batch int")


def hash_bundle(rows: DataFrame, keys: list[str], text_col: str, size: int = 16) -> DataFrame:
    """keys, dense, sparse and tokens of each text by hashes of its words: the
    shapes that an embedding service gives, without a model. dense has unit length."""
    words = F.filter(F.split(F.lower(text_col), r"\s+"), lambda w: w != "")
    terms = rows.select(*keys, F.explode_outer(words).alias("term")).groupBy(*keys, "term").agg(F.count("term").alias("weight"))
    digit = lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(F.md5("term"), i, 1)) - 1
    signed = terms.withColumn("at", digit(1)).withColumn("x", F.when(digit(2) > 7, -1.0).otherwise(1.0) * F.col("weight"))
    sums = F.array(*(F.sum(F.when(F.col("at") == d, F.col("x")).otherwise(0.0)) for d in range(size)))
    g = signed.groupBy(*keys).agg(
        sums.alias("raw"), F.sort_array(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "weight")))).alias("sparse"), F.sum("weight").alias("tokens")
    )
    g = g.withColumn("norm", F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x)))
    dense = F.transform("raw", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(0.0))
    return g.select(*keys, dense.alias("dense"), "sparse", "tokens")
