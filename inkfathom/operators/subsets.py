"""The k best of sparse scores where vectors are short, as those of titles are.

A document's score for a query is known by the terms that both have, with the document's
weights: a key. Of all documents that hold a key only the first by id can be among
the k best, for each of them scores no less than the key gives and equal scores go
to smaller ids. So each subset of a document's terms (2^n - 1, hence short vectors)
keeps a bounded list of ids, and a query reads the lists of its own subsets, from the best
down to the first that is full. What is made and shuffled grows with the
number of documents and queries, not with that of the pairs that share a term.

Lists and ids meet by sorted shuffles: by their files' sizes, which dictionaries of
terms make small, Spark would send the lists to the driver to broadcast them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfathom.operators import impacts
from inkfathom.sources.scratch import written

#: Terms of a vector that is short.
SHORT = 6


def _subsets(items: Column) -> Column:
    none = F.slice(F.array(items), 1, 0)
    every = F.aggregate(items, F.array(F.slice(items, 1, 0)), lambda done, x: F.concat(done, F.transform(done, lambda s: F.concat(s, F.array(x)))))
    return F.filter(F.coalesce(every, none), lambda s: F.size(s) > 0)


def _keys(rows: DataFrame, ids: list[str]) -> DataFrame:
    """ids, terms, weights, h: a row for each subset of a vector's terms."""
    items = rows.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("items"))
    each = items.select(*ids, F.explode(_subsets(F.col("items"))).alias("s"))
    return each.select(*ids, F.col("s.term").alias("terms"), F.col("s.weight").alias("weights")).withColumn("h", F.xxhash64("terms"))


def _best(postings: DataFrame, queries: DataFrame, k: int, alone: bool) -> DataFrame:
    keys = _keys(postings, ["id", "grp"])
    first = lambda df, by, n: df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("n") <= n).drop("n")
    # Of another grp than a query's there are k in a list of ``full``: its own grp takes k places at most.
    full = k + 1 if alone else 2 * k
    own = keys if alone else first(keys, ["h", "terms", "weights", "grp"], k)
    lists = first(own, ["h", "terms", "weights"], full).groupBy("h", "terms", "weights").agg(F.collect_list(F.struct("id", "grp")).alias("ids"))
    lists = written(lists.withColumn("n", F.size("ids")), "lists").hint("merge")
    asked = _keys(queries, ["query_id", "grp"]).select("query_id", F.col("grp").alias("own"), "h", "terms", F.col("weights").alias("q"))
    score = F.aggregate(F.zip_with("q", "weights", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    met = asked.join(lists.select("h", "terms", "weights", "n"), ["h", "terms"]).withColumn("score", score)
    least = F.max(F.when(F.col("n") >= full, F.col("score"))).over(Window.partitionBy("query_id"))
    read = met.withColumn("least", least).where(F.col("least").isNull() | (F.col("score") >= F.col("least") * (1 - 1e-12) - 1e-6))
    found = read.select("query_id", "own", "h", "terms", "weights", "score").join(lists.drop("n"), ["h", "terms", "weights"])
    pairs = found.select("query_id", "own", "score", F.inline("ids")).where(~F.col("grp").eqNullSafe(F.col("own")))
    return pairs.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def best_sparse(postings: DataFrame, queries: DataFrame, k: int, slack: float = 0.0, alone: bool = False) -> DataFrame:
    """What ``impacts.best_sparse`` gives with ``unlike``, if scores are rounded to six places and equal ones go by id.

    ``alone``: each document is a grp of its own. Vectors of more than ``SHORT`` terms, as
    documents or as queries, are searched by ``impacts``.
    """
    p = written(impacts._clean(postings, ["id", "term", "grp"]), "postings")
    q = written(impacts._clean(queries, ["query_id", "term", "grp"]), "asked")
    long = lambda df, key: df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > SHORT).select(key)
    long_p, long_q = (written(long(df, key), "long").hint("merge") for df, key in ((p, "id"), (q, "query_id")))
    few_p, few_q = (df.join(l, key, "left_anti") for df, l, key in ((p, long_p, "id"), (q, long_q, "query_id")))
    parts = [_best(few_p, few_q, k, alone)]
    if not long_p.isEmpty():
        parts.append(impacts.best_sparse(p.join(long_p, "id", "left_semi"), few_q, k, slack, True))
    if not long_q.isEmpty():
        parts.append(impacts.best_sparse(p, q.join(long_q, "query_id", "left_semi"), k, slack, True))
    return reduce(DataFrame.unionByName, parts)
