"""Language identification by nearest centroid.

A text's hashed letter 1- to 3-grams make a TF-IDF vector of unit length. The
document frequencies cover all labelled training rows. Each language's vectors,
from a bounded sample of labelled rows, are clustered by spherical k-means into
several centroids, each language in a task of its own; the driver gets centroids
only. A text takes the language of the centroid of largest cosine,
and is rejected when that cosine lies far below what training texts of its
length reach.

Defined cases: a null text and one without letters are ``und``, score 0 and
rejected; rows of null language teach nothing; without any training row all
are ``und``; of equal cosines the first language by name wins; more than
``MOST_LANGS`` values of the language column are an error; repeated rows
give repeated results; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfathom.llm.common import fold, map_batches, spool
from inkfathom.llm.ngrams import hashed, letters, new_letters

BITS = 13
ORDERS = (1, 2, 3)
#: Labelled rows of each language, in expectation, that are clustered.
SAMPLE = 1000
CENTROIDS = 4
#: More languages are an error: their centroids, ``CENTROIDS`` vectors of 64 KB each, are broadcast (128 MB at most).
MOST_LANGS = 500
#: Share of the lowest training cosine that a text must reach.
REACH = 0.6
_SCALE = 12.0


def counts(text: str) -> tuple[np.ndarray, int]:
    total, size = np.zeros(1 << BITS, np.int64), 0
    for codes, seen in letters(text):
        size += new_letters(codes, seen)
        for n in ORDERS:
            total += np.bincount(hashed(codes, seen, n, BITS), minlength=1 << BITS)
    return total, size


def unit(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-zero places and values of the TF-IDF vector of unit length."""
    at = np.flatnonzero(found)
    value = np.log1p(found[at]) * idf[at]
    norm = np.sqrt(value @ value)
    return at, value / norm if norm > 0 else value


def _bucket(size: int) -> int:
    return min(int(size).bit_length(), 16)


@dataclass
class Model:
    langs: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, cosine, rejected."""
        found, size = counts(text or "")
        if not size or not self.langs:
            return "und", 0.0, 0.0, True
        at, value = unit(found, self.idf)
        cosines = value @ self.centroids[at]
        best = np.full(len(self.langs), -1.0)
        np.maximum.at(best, self.owner, cosines)
        k = int(best.argmax())
        soft = np.exp(_SCALE * (best - best[k]))
        return self.langs[k], float(1 / soft.sum()), float(best[k]), bool(best[k] < self.floor[_bucket(size)])


def kmeans(x: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Unit centroids; seeds are picked farthest first, so no chance is involved."""
    seeds = [int((x @ x.sum(0)).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(1).argmin()))
    c = x[seeds]
    for _ in range(steps):
        near = (x @ c.T).argmax(1)
        new = np.stack([x[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))])
        c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
    return c


def dense(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Rows of at and value as vectors in full."""
    x = np.zeros((rows.num_rows, 1 << BITS), np.float32)
    for k, (at, value) in enumerate(zip(rows["at"], rows["value"])):
        x[k, at.values.to_numpy()] = value.values.to_numpy()
    return x


def document_frequency(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each bucket, and all documents, over all ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((1 << BITS) + 1, np.int64)
        for b in batches:
            for t in b.column("text"):
                df[:-1] += counts(t.as_py() or "")[0] > 0
                df[-1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(df), dtype=np.int32)), pa.array(df)], names=["bucket", "n"]
        )

    got = map_batches(rows.select("text"), run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = np.zeros((1 << BITS) + 1, np.int64)
    for r in got.collect():
        df[r["bucket"]] = r["n"]
    return df[:-1], int(df[-1])


def train(rows: DataFrame, id_col: str, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """``rows``: id_col, text and lang (not null) of all labelled training rows."""
    df, n = document_frequency(rows)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} values of the language column: is it one?")
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros(0, int), np.zeros((1 << BITS, 0)), idf, np.zeros(17))
    share = F.create_map(*(x for g in langs for x in (F.lit(g), F.lit(min(1.0, sample / sizes[g])))))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("langid")), 1 << 30) / float(1 << 30)
    drawn = rows.select("text", "lang", draw.alias("draw")).where(F.col("draw") < share[F.col("lang")])
    # Where one id stands for many rows more may be drawn than expected: no task clusters more than twice the sample.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")))
    drawn = drawn.withColumn("place", place).where(F.col("place") <= 2 * sample)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, value, size = [], [], []
            for t in b.column("text"):
                found, letters_in = counts(t.as_py() or "")
                i, v = unit(found, idf)
                at.append(i.astype(np.int32))
                value.append(v.astype(np.float32))
                size.append(letters_in)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("lang"),
                    pa.array(at, pa.list_(pa.int32())),
                    pa.array(value, pa.list_(pa.float32())),
                    pa.array(size, pa.int64()),
                ],
                names=["lang", "at", "value", "size"],
            )

    found = map_batches(drawn.select("text", "lang"), vectors, "lang string, at array<int>, value array<float>, size bigint")
    found = spool(found.where("size > 0"), "langid")

    def clustered(own: pa.Table) -> pa.Table:
        """Centroids of one language, of whose rows there are about ``sample``."""
        c = kmeans(dense(own), centroids)
        rows = {"lang": [own["lang"][0].as_py()] * len(c), "n": range(len(c)), "centroid": list(c)}
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), (pa.string(), pa.int32(), pa.list_(pa.float32())))})

    made = found.groupBy("lang").applyInArrow(clustered, "lang string, n int, centroid array<float>").orderBy("lang", "n").toArrow()
    if not made.num_rows:
        return Model([], np.zeros(0, int), np.zeros((1 << BITS, 0)), idf, np.zeros(17))
    centres = made["centroid"].combine_chunks().flatten().to_numpy().reshape(made.num_rows, -1)
    place = {g: k for k, g in enumerate(langs)}
    owner = np.array([place[g] for g in made["lang"].to_pylist()])
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lowest = np.full(18, np.inf)
        for b in batches:
            if b.num_rows:
                np.minimum.at(lowest, [_bucket(s) for s in b.column("size").to_pylist()], (dense(b) @ shared.value.T).max(1).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(range(18), pa.int32()), pa.array(lowest)], names=["size", "least"])

    parts = map_batches(found, nearest, "size int, least double").groupBy("size").agg(F.min("least").alias("least"))
    lowest = np.array([r["least"] for r in parts.orderBy("size").collect()])
    floor = np.minimum.accumulate(lowest[::-1])[::-1][:17]
    floor = np.where(np.isfinite(floor), floor, floor[np.isfinite(floor)].max()) * REACH
    return Model(langs, owner, np.ascontiguousarray(centres.T.astype(np.float64)), idf, floor)


def identify(
    docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep=()
) -> DataFrame:
    """Adds lang_pred, score, cosine and rejected to id, text and ``keep``.

    ``learn``: which rows may teach; those of null language never do.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"), *keep)
    taught = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    model = train(
        taught.select(F.col(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), id_col
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shared.value.predict(t.as_py()) for t in b.column("text")]
            cols = list(zip(*out)) if out else [()] * 4
            types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(c, t) for c, t in zip(cols, types))],
                names=[*b.schema.names, "lang_pred", "score", "cosine", "rejected"],
            )

    had = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return map_batches(rows, run, f"{had}, lang_pred string, score double, cosine double, rejected boolean")


def held_out(id_col: str = "doc_id") -> Column:
    return fold(id_col, 4) == 2
