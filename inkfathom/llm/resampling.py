"""Importance resampling towards a target distribution of hashed n-gram features.

A document's features are its runs of ``orders`` consecutive words, with repeats.
Every distinct feature of all texts is a row of a dictionary: strings are counted
first (in each task, then over all), and each distinct string is hashed to its
bucket once. Buckets add up the dictionary's counts in the source and in the
target, which gives each bucket a gain, the log ratio of its smoothed shares.

Gains are joined back to the documents' own counts of features. A feature is
frequent if its share of all source features is more than (its bytes + 16) /
``HOT_BYTES``; as shares add up to one, the frequent ones' strings take less than
``HOT_BYTES`` together, at any corpus size. They and their gains are broadcast and
joined where the texts are read. The rest, which no few of can be hot keys, are
joined by a shuffle on the feature and added up by document.

A document's score is its weight (the sum of its gains) and Gumbel noise by a
hash of its id, which makes the highest scores a draw without replacement in
proportion to the importance weights. Ranks come from a range partitioning by
score: each partition numbers its rows, and the counts of those before it are
added.

Defined cases: a null text has no features; a null id is hashed as an empty text
and comes last of equal scores; repeated rows each get a score and a rank of
their own, in an order of their own; empty tables give no row, and an empty target
a gain for each bucket all the same; a long text is counted in pieces; only the
named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import map_batches, spool

ORDERS, BUCKETS, SALT = (1, 1), 10000, 2024
#: Words of a document that may be drawn; per cent of those documents that are drawn.
LEAST_WORDS, PERCENT = 20, 10
HOT_BYTES = 4 << 20
#: Distinct features that a task counts before it hands them on; bytes of text cut into words at once.
_HELD, _PIECE = 1 << 18, 1 << 22

#: Bytes of words: digits, a-z (of A-Z too) and all of other characters; the rest are blanks.
_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in pieces."""
    raw = (text or "").encode().translate(_BYTES)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + _PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def features(text: str | None, orders: tuple[int, int] = ORDERS) -> tuple[Counter, int]:
    """How often each feature occurs, and the number of words."""
    low, high = orders
    found: Counter = Counter()
    tail: list[bytes] = []
    n = 0
    for piece in words(text):
        n += len(piece)
        if (low, high) == (1, 1):
            found.update(piece)
            continue
        whole = tail + piece
        for size in range(low, high + 1):
            first = max(0, len(tail) - size + 1)
            found.update(b" ".join(whole[i : i + size]) for i in range(first, len(whole) - size + 1))
        tail = whole[len(whole) - high + 1 :] if high > 1 else []
    return found, n


def _counts(orders: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], names=["feature", "n"]
            )

        for b in batches:
            for text in b.column("text"):
                if orders == (1, 1):
                    for piece in words(text.as_py()):
                        found.update(piece)
                else:
                    found.update(features(text.as_py(), orders)[0])
                if len(found) > _HELD:
                    yield rows()
                    found.clear()
        yield rows()

    return run


def dictionary(source: DataFrame, target: DataFrame, orders: tuple[int, int], buckets: int) -> DataFrame:
    """feature, s, t (its counts in both) and bucket, a row a distinct feature. Both: text."""
    counted = [
        map_batches(d, _counts(orders), "feature string, n bigint").select("feature", *(F.col("n") * int(i == j) for j in (0, 1)))
        for i, d in enumerate((source, target))
    ]
    both = counted[0].toDF("feature", "s", "t").unionByName(counted[1].toDF("feature", "s", "t"))
    each = both.groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    return each.withColumn("bucket", (F.crc32(F.col("feature").cast("binary")) % buckets).cast("int"))


def gains(known: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """bucket and gain of the buckets that features fall in, and the number of source features."""
    per = known.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    per = spool(per, "buckets")
    total = per.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    d = lambda c, more: (F.col(c) if isinstance(c, str) else F.lit(c)).cast("double") + F.lit(float(more))
    ratio = (d("t", 1) * d(total["s"], buckets)) / (d("s", 1) * d(total["t"], buckets))
    return per.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")), total["s"]


def _weights(shared, orders: tuple[int, int]):
    """Each document with its weight so far and the features that are not broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rid = shared.value, TaskContext.get().partitionId() << 36
        for b in batches:
            many, size, weight, rest, times, ends = [], [], [], [], [], [0]
            for text in b.column("text"):
                found, n = features(text.as_py(), orders)
                total = 0
                for feature, k in found.items():
                    gain = hot.get(feature)
                    if gain is None:
                        rest.append(feature)
                        times.append(k)
                    else:
                        total += gain * k
                many.append(found.total())
                size.append(n)
                weight.append(total)
                ends.append(len(rest))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(rid, rid + b.num_rows), pa.int64()),
                    b.column("doc_id"),
                    *(pa.array(x, pa.int64()) for x in (many, size, weight)),
                    pa.ListArray.from_arrays(offsets, pa.array(rest, pa.binary()).cast(pa.string())),
                    pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                ],
                names=["rid", "doc_id", "n_features", "n_words", "weight", "rest", "times"],
            )
            rid += b.num_rows

    return run


def weigh(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    orders: tuple[int, int] = ORDERS,
    buckets: int = BUCKETS,
    hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """rid, doc_id, n_features, n_words and weight of every document."""
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    known = spool(dictionary(given.select("text"), target.select(F.col(target_col).alias("text")), orders, buckets), "features")
    of_bucket, total = gains(known, buckets)
    of_bucket = F.broadcast(of_bucket)  # a row a bucket at most
    frequent = known.where(F.col("s") * float(hot_bytes) > (F.octet_length("feature") + 16) * float(total))
    found = frequent.join(of_bucket, "bucket").select(F.col("feature").cast("binary").alias("feature"), "gain").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(found["feature"].to_pylist(), found["gain"].to_pylist())))
    schema = "rid bigint, doc_id bigint, n_features bigint, n_words bigint, weight bigint, rest array<string>, times array<bigint>"
    own = spool(map_batches(given, _weights(shared, orders), schema), "documents")
    rest = own.select("rid", F.inline(F.arrays_zip(F.col("rest").alias("feature"), F.col("times").alias("k"))))
    rare = rest.join(known.where("s > 0").select("feature", "bucket").hint("merge"), "feature").join(of_bucket, "bucket")
    nothing = F.lit(None).cast("bigint")
    parts = own.select("rid", "doc_id", "n_features", "n_words", "weight").unionByName(
        rare.select("rid", *(nothing.alias(c) for c in ("doc_id", "n_features", "n_words")), (F.col("gain") * F.col("k")).alias("weight"))
    )
    return parts.groupBy("rid").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "n_features", "n_words")), F.sum("weight").alias("weight")
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        yield b.append_column("part", pa.array([part] * b.num_rows, pa.int32())).append_column(
            "place", pa.array(range(n + 1, n + 1 + b.num_rows), pa.int64())
        )
        n += b.num_rows


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    orders: tuple[int, int] = ORDERS,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    salt: int = SALT,
    hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """The id, n_features, weight, score and rank (null if it is not drawn) of every document."""
    weighed = weigh(docs, target, id_col, text_col, target_col, orders, buckets, hot_bytes)
    said = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = spool(
        weighed.select("rid", "doc_id", "n_features", (F.col("n_words") >= least_words).alias("fit"), "weight", (F.col("weight") + noise).alias("score")),
        "scored",
    )
    drawn = scored.agg(F.count_if("fit")).first()[0] * percent // 100
    order = [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("rid")]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = "rid bigint, doc_id bigint, n_features bigint, fit boolean, weight bigint, score bigint"
    placed = spool(map_batches(dealt, _numbered, kinds + ", part int, place bigint"), "placed")
    before, firsts = 0, []
    for part, n in sorted(tuple(r) for r in placed.groupBy("part").count().collect()):  # a row a partition
        firsts.append((part, before))
        before += n
    begins = docs.sparkSession.createDataFrame(firsts, "part int, before bigint")
    rank = F.col("before") + F.col("place")
    return placed.join(F.broadcast(begins), "part").select(
        F.col("doc_id").alias(id_col), "n_features", "weight", "score", F.when(F.col("fit") & (rank <= drawn), rank).alias("rank")
    )
