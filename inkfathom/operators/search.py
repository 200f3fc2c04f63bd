"""Candidate search: exact vector search in blocks, sparse dot products, BM25."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfathom.sources.scratch import written

#: Rows to a block of an exact vector search.
BLOCK = 20_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(n > 0, n, np.inf)[:, None]


def _first(row: np.ndarray, kept: np.ndarray, k: int | None) -> np.ndarray:
    """The k of ``kept`` of largest value, ties by place, in that order; only what can be among them is sorted."""
    if k is not None and k < len(kept):
        kept = kept[row[kept] >= np.partition(row[kept], len(kept) - k)[len(kept) - k]]
    return kept[np.argsort(-row[kept], kind="stable")[:k]]


_FOUND = "query_id bigint, field int, id bigint, score double"


#: Queries that are scored at once.
_AT_ONCE = 64


def _found(parts: list[tuple]) -> pd.DataFrame:
    """Of (query, field, ids, scores) a row for each id."""
    if not parts:
        return pd.DataFrame({"query_id": [], "field": [], "id": [], "score": []})
    query, field, ids, score = zip(*parts)
    sizes = list(map(len, ids))
    return pd.DataFrame({"query_id": np.repeat(query, sizes), "field": np.repeat(field, sizes), "id": np.concatenate(ids), "score": np.concatenate(score)})


def _units(r: pd.DataFrame, fields: dict[str, slice]) -> dict[int, tuple]:
    """Of a block of rows, by the length of their vectors: ids in order, their grp, and unit vectors of each field."""
    lengths, out = r["vector"].map(len), {}
    for size in sorted(set(lengths)):
        own = r[lengths == size].sort_values("id", ignore_index=True)
        whole = np.stack([np.asarray(v, np.float64) for v in own["vector"]])
        out[size] = own["id"].to_numpy(), own["grp"].to_numpy(), [_unit(whole[:, dims]) for dims in fields.values()]
    return out


def _nearest(units: dict[int, tuple], q: pd.DataFrame, k: int | None, fields: dict[str, slice], least: float | None, unlike: bool) -> Iterator[pd.DataFrame]:
    """What queries find in such a block, some queries at a time. A query's own ``floor``, if there is one, is the least score of it."""
    lengths = q["asked"].map(len)
    for size in sorted(set(units) & set(lengths)):
        ids, grp, unit = units[size]
        ask = q[lengths == size]
        for at in range(0, len(ask), _AT_ONCE):
            part, out = ask.iloc[at : at + _AT_ONCE], []
            asked = np.stack([np.asarray(v, np.float64) for v in part["asked"]])
            floors = part["floor"] if "floor" in part else [least] * len(part)
            for name, (dims, x) in enumerate(zip(fields.values(), unit)):
                s = np.round(_unit(asked[:, dims]) @ x.T, 9)
                for row, query, its, floor in zip(s, part["query_id"], part["own"], floors):
                    ok = np.ones(len(row), bool)
                    if floor is not None:
                        ok &= row >= floor
                    if unlike:
                        ok &= grp != its
                    best = _first(row, np.flatnonzero(ok), k)
                    out.append((query, name, ids[best], row[best]))
            yield _found(out)


def _block_search(k: int | None, fields: dict[str, slice], least: float | None, unlike: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The search of a block of queries in a block of rows, as one frame."""

    def search(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not r.size or not q.size:  # a block of one side alone has no columns of the other
            return _found([])
        parts = list(_nearest(_units(r, fields), q, k, fields, least, unlike))
        return pd.concat(parts, ignore_index=True) if parts else _found([])

    return search


def _in_blocks(held: DataFrame, asked: DataFrame, hold: Callable, ask: Callable) -> DataFrame:
    """Rows of ``held``, block by block, and those of ``asked`` that meet them (both of the same columns, with block).

    A block comes as one sorted stream: of its rows ``hold`` makes what is kept, and then
    what is asked comes in batches, of which ``ask`` gives frames at once. So what a
    task holds does not grow with what is asked or found.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows, own = None, [], None
        for batch in batches:
            for (block, is_asked), part in batch.groupby(["block", "asks"], sort=False):
                if block != at:
                    at, rows, own = block, [], None
                if not is_asked:
                    rows.append(part)
                    continue
                if rows:
                    own, rows = hold(pd.concat(rows, ignore_index=True)), []
                if own is not None:
                    yield from ask(own, part)

    both = held.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)))
    return both.repartition("block").sortWithinPartitions("block", "asks").mapInPandas(stream, _FOUND)


def knn(
    rows: DataFrame,
    queries: DataFrame,
    k: int | None,
    dims: slice = slice(None),
    least: float | None = None,
    unlike: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, id, score, rank: ``knn_fields`` of one field."""
    return knn_fields(rows, queries, k, {"": dims}, least, unlike, block).drop("field")


def knn_fields(
    rows: DataFrame,
    queries: DataFrame,
    k: int | None,
    fields: dict[str, slice],
    least: float | None = None,
    unlike: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """query_id, field, id, score, rank: for each field (a part of the vector) the
    k rows of largest cosine, ties by id; without k all rows, and no rank.

    ``rows``: id, vector, grp; ``queries``: query_id, vector, grp. ``unlike``:
    only rows of another grp. Rows are dealt into blocks, which all queries meet in
    turn, some of them as one matrix product a field; each block gives its own k
    best, of which the best are picked, so what is shuffled beside the vectors is k a
    query, field and block of rows. Null vectors and those with null or
    non-finite components are left out; vectors meet only those of their length.
    """
    fine = F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    blocks = max(1, -(-rows.count() // block))
    held = rows.where(fine).select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.col("id").cast("bigint").alias("id"), "vector", "grp")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = queries.where(fine).select(every.alias("block"), F.col("query_id").cast("bigint").alias("id"), "vector", "grp")
    named = {"id": "query_id", "vector": "asked", "grp": "own"}
    found = _in_blocks(held, asked, lambda r: _units(r, fields), lambda own, q: _nearest(own, q.rename(columns=named), k, fields, least, unlike))
    found = found.withColumn("field", F.get(F.array(*map(F.lit, fields)), F.col("field")))
    return found if k is None else top_k(found, ["query_id", "field"], [F.desc("score"), "id"], k)


#: Rows to a cell of ``knn_near`` on average, and cells at most.
CELL, CELLS = 1000, 4000


def knn_near(rows: DataFrame, queries: DataFrame, k: int, least: float, unlike: bool = False, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """query_id, id, score, rank: what ``knn`` gives with ``least`` (above 0), without meeting all pairs: for vectors of few dimensions.

    Rows belong to the nearest of some rows drawn as centres (one for ``cell`` rows, ``CELLS`` at most; they
    change the work, not the result). A query searches its own cell first; the k-th score
    there is its floor. Then it goes to those cells alone in which, by the triangle
    inequality of angles, a row may reach the floor, and only such rows are given. Cells of more than
    ``block`` rows or queries meet in parts. Vectors of another length than most go by ``knn``.
    """
    assert least > 0
    fine = F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows, queries = rows.where(fine), queries.where(fine)
    size = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return knn(rows, queries, k, least=least, unlike=unlike, block=block)
    dims, same = size["d"], F.size("vector") == size["d"]
    centres = rows.where(same & F.exists("vector", lambda v: v != 0)).orderBy(F.xxhash64("id"), "id").limit(max(1, min(CELLS, size["n"] // cell)))
    middle = _unit(np.array([r["vector"] for r in centres.select("vector").collect()], np.float64).reshape(-1, dims))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) and len(middle):
                for at in range(0, len(b), 2048):
                    part = b.iloc[at : at + 2048]
                    cos = _unit(np.stack([np.asarray(v, np.float64) for v in part["vector"]])) @ middle.T
                    best = cos.argmax(1)
                    yield part.assign(cell=best, angle=np.arccos(np.clip(cos[np.arange(len(part)), best], -1, 1)))

    kind = lambda df: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    own = written(rows.where(same).select("id", "vector", "grp").transform(lambda d: d.mapInPandas(placed, f"{kind(d)}, cell int, angle double")), "cells")
    ask = queries.where(same).select("query_id", "vector", "grp").transform(lambda d: d.mapInPandas(placed, f"{kind(d)}, cell int, angle double"))
    ask = written(ask.select("query_id", F.col("vector").alias("asked"), F.col("grp").alias("own"), "cell"), "asked")
    cells = {r["cell"]: (r["wide"], r["n"]) for r in own.groupBy("cell").agg(F.max("angle").alias("wide"), F.count("*").alias("n")).collect()}
    wide = np.array([cells.get(c, (-np.inf, 0))[0] for c in range(len(middle))])

    def met(asked: DataFrame) -> DataFrame:
        """Queries in the rows of their ``cell``, with ``floor``."""
        sized = own.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("of"))
        many = asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("of"))
        part = lambda key: F.pmod(F.xxhash64(key), F.col("of")).cast("int")
        every = lambda df, name: df.select("cell", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias(name))
        r = own.join(F.broadcast(sized), "cell").withColumn("b", part("id")).drop("of").join(F.broadcast(every(many, "a")), "cell")
        q = asked.join(F.broadcast(many), "cell").withColumn("a", part("query_id")).drop("of").join(F.broadcast(every(sized, "b")), "cell")
        keys = ["cell", "a", "b"]
        found = r.select(*keys, "id", "vector", "grp").groupBy(*keys).cogroup(q.select(*keys, "query_id", "asked", "own", "floor").groupBy(*keys))
        return found.applyInPandas(_block_search(k, {"": slice(None)}, None, unlike), _FOUND).select("query_id", "id", "score")

    def elsewhere(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                angle = np.arccos(np.clip(_unit(np.stack([np.asarray(v, np.float64) for v in part["asked"]])) @ middle.T, -1, 1))
                # Scores are rounded to nine places, hence the 1e-8; arc cosines near 1 lose half of their places, hence the 1e-6.
                may = angle - wide <= np.arccos(np.clip(part["floor"].to_numpy() - 1e-8, -1, 1))[:, None] + 1e-6
                may[np.arange(len(part)), part["cell"]] = False
                which, to = np.nonzero(may)
                yield part.iloc[which].assign(cell=to)

    first = written(met(ask.withColumn("floor", F.lit(float(least)))), "near")
    floors = top_k(first, "query_id", [F.desc("score"), "id"], k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    floored = ask.join(floors.hint("merge"), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float(least))))
    more = written(floored.mapInPandas(elsewhere, kind(floored)), "asked")
    found = first.unionByName(met(more))
    rest, others = rows.where(~same), queries.where(~same)
    if not rest.isEmpty() and not others.isEmpty():
        found = found.unionByName(knn(rest, others, k, least=least, unlike=unlike, block=block).drop("rank"))
    return top_k(found, "query_id", [F.desc("score"), "id"], k)


def top_k(rows: DataFrame, group: str | list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group, with their rank (a place, never shared)."""
    w = Window.partitionBy(group).orderBy(*order)
    best = rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
    return best.withColumn(rank, F.col(rank).cast("bigint"))


def sparse_scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, score: dot products of sparse vectors, (id, term, weight)
    against (query_id, term, weight); disjoint vectors give no row."""
    q = queries.select("query_id", "term", F.col("weight").alias("__q"))
    return docs.join(q, "term").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("__q")).alias("score"))


def terms(text: Column) -> Column:
    """Lower-cased words between blanks and line ends; an empty array for an empty text."""
    cut = F.btrim(F.lower(text), F.lit(" \n"))
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, "[ \n]+"))


def term_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, dl, term, tf of the terms ``wanted`` in docs (id, text), as a table of its own.

    A text is cut into words once: its length comes along as the count of the
    empty term, which is no word, so documents without a wanted term are there too.
    """
    wanted = wanted.select("term").union(docs.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    words = docs.select("id", F.coalesce(terms(F.col("text")), F.array().cast("array<string>")).alias("words"))
    each = words.select("id", F.size("words").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("term"))
    return written(each.join(wanted, "term", "left_semi").groupBy("id", "dl", "term").agg(F.count("*").alias("tf")), "counts")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term of the distinct words of queries (query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def bm25_weights(counts: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, term, weight: what each term adds to the score of a document."""
    stats = counts.where("term = ''").agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    found = counts.where("term <> ''")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return found.join(df, "term").crossJoin(F.broadcast(stats)).select("id", "term", part.alias("weight"))


#: Pairs of a query and a document that a task of ``bm25`` may have to hold.
PAIRS = 1_000_000


def _idf(docs: DataFrame, asked: DataFrame, is_kept: Column) -> tuple[DataFrame, DataFrame]:
    """Counts of the terms ``asked`` (the empty one stands for all docs), and term, avgdl, idf. Only counts by term are shuffled."""
    words = docs.select(F.coalesce(terms(F.col("text")), F.array().cast("array<string>")).alias("words"), is_kept.alias("kept"))
    wanted = asked.select("term").distinct().unionAll(docs.sparkSession.range(1).select(F.lit("").alias("term")))
    once = words.select("kept", F.size("words").alias("dl"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("words"))).alias("term"))
    found = written(
        once.join(F.broadcast(wanted), "term").groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl"), F.count_if("kept").alias("kept")), "terms"
    )
    whole = found.where("term = ''").select(F.col("df").alias("n_docs"), (F.col("dl") / F.col("df")).alias("avgdl"))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return found, found.where("term <> ''").crossJoin(whole).select("term", "avgdl", idf.alias("idf"))


def bm25_by(docs: DataFrame, keys: list[str], queries: DataFrame, kept: Column | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """keys, query_id, score: BM25 over all docs (keys, text and what ``kept`` reads), of those that are ``kept``.

    Two reads of the texts. The first counts the queries' terms, and only counts by
    term are shuffled. The second deals the texts that are kept by the first of
    the keys and scores them where they are: neither words nor pairs are
    shuffled, and what is grouped by that key next is not either. The queries' terms are
    broadcast.
    """
    asked = written(query_terms(queries), "asked")
    is_kept = F.lit(True) if kept is None else F.coalesce(kept, F.lit(False))
    found, weighty = _idf(docs, asked, is_kept)
    size = found.where("term = ''").crossJoin(asked.agg(F.count_distinct("query_id").alias("n"))).select(F.col("kept") * F.col("n")).first()
    parts = max(1, -(-(size[0] if size else 0) // PAIRS))
    own = docs.where(is_kept).select(*keys, "text").repartition(parts, keys[0])
    each = own.select(*keys, terms(F.col("text")).alias("words")).select(*keys, F.size("words").alias("dl"), F.explode("words").alias("term"))
    counts = each.join(F.broadcast(weighty), "term").groupBy(*keys, "dl", "term", "idf", "avgdl").agg(F.count("*").alias("tf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weights = counts.select(*keys, "term", part.alias("weight"))
    return weights.join(F.broadcast(asked), "term").groupBy(*keys, "query_id").agg(F.sum("weight").alias("score"))


#: Texts to a block of ``bm25_best``.
_TEXTS = 8000


def _postings(r: pd.DataFrame) -> tuple:
    """Of a block of texts (id, codes, weights): ids in order; place and weight of each posting by code; the codes and where each begins."""
    r = r.sort_values("id", ignore_index=True)
    codes, weights = np.concatenate(r["codes"].tolist()), np.concatenate(r["weights"].tolist())
    order = np.argsort(codes, kind="stable")
    distinct, begins = np.unique(codes[order], return_index=True)
    return r["id"].to_numpy(), np.repeat(np.arange(len(r)), r["codes"].map(len))[order], weights[order], distinct, np.append(begins, len(codes))


def _best_texts(postings: tuple, q: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    """The k best of a block for each query (id, codes), scores rounded to six places, some queries at a time."""
    ids, places, weights, distinct, begins = postings
    for at in range(0, len(q), _AT_ONCE):
        part, out = q.iloc[at : at + _AT_ONCE], []
        for query, codes in zip(part["id"], part["codes"]):
            here = np.flatnonzero(np.isin(distinct, codes))
            if len(here):
                own = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in here])
                score = np.bincount(places[own], weights[own], len(ids))
                kept = np.flatnonzero(score > 0)
                score = np.round(score, 6)
                best = _first(score, kept, k)
                out.append((query, 0, ids[best], score[best]))
        yield _found(out)


def bm25_best(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, score, rank: the k texts of best BM25 of each query, scores rounded to six places, equal ones by id.

    ``docs``: id, text; ``queries``: query_id, text. Texts are dealt into blocks, and each becomes its
    weights of the queries' terms where it is. All queries meet a block in turn, and it gives k
    of each: neither pairs nor what is found are held or shuffled beyond that.
    """
    asked = written(query_terms(queries), "asked")
    found, weighty = _idf(docs, asked, F.lit(True))
    coded = written(weighty.withColumn("code", F.monotonically_increasing_id()), "codes")
    size = found.where("term = ''").select("df").first()
    blocks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-(size[0] if size else 0) // _TEXTS))
    own = docs.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.col("id").cast("bigint").alias("id"), "text").repartition(blocks, "block")
    each = own.select("block", "id", terms(F.col("text")).alias("words")).select("block", "id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    counts = each.join(F.broadcast(coded), "term").groupBy("block", "id", "dl", "code", "idf", "avgdl").agg(F.count("*").alias("tf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    held = counts.select("block", "id", F.struct("code", part.alias("weight")).alias("x")).groupBy("block", "id").agg(F.collect_list("x").alias("x"))
    codes = asked.join(F.broadcast(coded.select("term", "code")), "term").groupBy(F.col("query_id").cast("bigint").alias("id")).agg(F.collect_list("code").alias("codes"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    met = _in_blocks(
        held.select("block", "id", F.col("x.code").alias("codes"), F.col("x.weight").alias("weights")),
        codes.select(every, "id", "codes", F.lit(None).cast("array<double>").alias("weights")),
        _postings, lambda own, q: _best_texts(own, q, k),
    )
    return top_k(met.drop("field"), "query_id", [F.desc("score"), "id"], k)


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, score of every document that shares a term.

    ``docs``: id, text; ``queries``: query_id, text. For the best few of short
    queries see ``impacts.best_bm25``.
    """
    return bm25_by(docs, ["id"], queries, None, k1, b).select("query_id", "id", "score")


def query_vectors(vector: Column, weights: dict[str, float], max_field: str, field: str = "content") -> Column:
    """What each strategy sends: array of struct(strategy, field, vector). Weighted
    scales the vector for each field of a weight above 0."""
    one = lambda s, f, v: F.struct(F.lit(s).alias("strategy"), F.lit(f).alias("field"), v.alias("vector"))
    times = lambda w: F.transform(vector, lambda x: x * w)
    scaled = [one("weighted", f, times(w)) for f, w in weights.items() if w > 0]
    return F.array(one("content_only", field, vector), one("max_field", max_field, vector), *(scaled or [one("weighted", field, vector)]))


def dense_fields(embeddings: DataFrame) -> dict[str, slice]:
    """The named vectors that the adapters cut from one embedding."""
    return {"content": slice(None), "title": slice(0, 32), "doc_title": slice(32, 64)}
