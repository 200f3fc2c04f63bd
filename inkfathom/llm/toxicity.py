"""Toxicity by non-negative positive-unlabelled learning.

Positives are texts confirmed as toxic; the unlabelled texts are drawn from all
training rows, toxic ones among them. A linear model in numpy minimises the
risk  pi R_p+ + max(0, R_u- - pi R_p-)  with the class prior pi taken from the
labels; where the second part turns negative, its gradient is turned round.
A feature is how often a text has a hashed 5- or 6-gram of letters, with the
words' edges; those kept are clearly more usual among positives. The number
of words and its logarithm are features too, as chance finds grow with the text.

Both training samples are bounded (``POSITIVES``, ``UNLABELLED``, in
expectation) and drawn by a hash of the id.

Defined cases: null and empty texts hold no feature and take the model's base
score; a label is positive if any of its rows says 1; null labels are none;
without a positive nothing is toxic (score 0); repeated rows give repeated
results; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import map_batches, spool
from inkfathom.llm.ngrams import hashed, letters, words_ended

BITS = 22
ORDERS = (5, 6)
POSITIVES = 2000
UNLABELLED = 6000
#: A feature of toxic texts alone is 1/prior times as usual among positives as
#: among unlabelled texts. Kept are those of LIFT of that or more, whose count is
#: DEVIATIONS over what the unlabelled texts make likely; the KEPT most telling.
LIFT, DEVIATIONS, KEPT = 0.6, 4.0, 400
THRESHOLD = 0.7


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of the whole text, their counts, and the number of words."""
    found, words = [], 0
    for codes, seen in letters(text or ""):
        found += [hashed(codes, seen, n, BITS, inner=True) for n in ORDERS]
        words += words_ended(codes, seen)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    return *np.unique(np.concatenate(found), return_counts=True), words


def nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 0.3):
    """Weights and bias of least non-negative risk under the logistic loss."""
    decay /= len(p)
    w, b = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        w32 = w.astype(np.float32)  # the matrices are not to be copied
        gp, gu = (p @ w32).astype(float) + b, (u @ w32).astype(float) + b
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        up, uu = prior * (sp - 1) / len(p), su / len(u)
        over = prior * sp / len(p)
        rp, ru = (up - over, uu) if negative >= 0 else (over, -uu)
        gw = rp.astype(np.float32) @ p + ru.astype(np.float32) @ u + decay * w
        gb = rp.sum() + ru.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return w, b


@dataclass
class Model:
    bucket: np.ndarray
    weight: np.ndarray
    length: np.ndarray
    bias: float

    @cached_property
    def column(self) -> np.ndarray:
        """The weight's place for each bucket, -1 for none."""
        column = np.full(1 << BITS, -1, np.int16)
        column[self.bucket] = np.arange(len(self.bucket))
        return column

    def score(self, text: str | None) -> float:
        g, words = self.bias, 0
        for codes, seen in letters(text or ""):
            words += words_ended(codes, seen)
            for n in ORDERS:
                c = self.column[hashed(codes, seen, n, BITS, inner=True)]
                g += float(self.weight[c[c >= 0]].sum())
        g += float(self.length @ extent(words))
        return float(1 / (1 + np.exp(-np.clip(g, -50, 50))))


def extent(words: int) -> np.ndarray:
    return np.array([words / 100, np.log1p(words)])


#: Occurrences in a text that count for the choice of features; fewer positives than SUPPORT never deviate enough.
CLIP, SUPPORT = 4, 5
_FLUSH = 1 << 21


def _counted(texts: DataFrame, within: np.ndarray | None = None) -> pa.Table:
    """bucket, texts and times (clipped) over whole ``texts``, only for buckets
    ``within``, or else those of SUPPORT texts or more. Counted on the executors."""
    spark = texts.sparkSession
    marks = None if within is None else spark.sparkContext.broadcast(np.packbits(np.isin(np.arange(1 << BITS), within)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if marks is None else np.unpackbits(marks.value).astype(bool)
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def out() -> pa.RecordBatch:
            bucket, at = np.unique(np.concatenate([s[0] for s in seen]), return_inverse=True)
            times = np.bincount(at, np.concatenate([s[1] for s in seen])).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket.astype(np.int32)), pa.array(np.bincount(at).astype(np.int64)), pa.array(times)],
                names=["bucket", "texts", "times"],
            )

        for b in batches:
            for t in b.column("text"):
                bucket, count, _ = features(t.as_py())
                if wanted is not None:
                    count, bucket = count[wanted[bucket]], bucket[wanted[bucket]]
                seen.append((bucket, np.minimum(count, CLIP)))
                held += len(bucket)
                if held >= _FLUSH:
                    yield out()
                    seen, held = [], 0
        if held:
            yield out()

    sums = map_batches(texts.select("text"), run, "bucket int, texts bigint, times bigint").groupBy("bucket")
    sums = sums.agg(F.sum("texts").alias("texts"), F.sum("times").alias("times"))
    return (sums.where(F.col("texts") >= SUPPORT) if within is None else sums).toArrow()


def choose(texts_p, times_p, texts_u, times_u, n_p: int, n_u: int, prior: float) -> np.ndarray:
    """Places of the features kept, of the given counts among positives and unlabelled texts."""
    share = n_p / n_u
    likely = (texts_u + 1) * share
    excess = (texts_p - likely) / np.sqrt(likely + 1)
    good = np.flatnonzero((times_p * prior >= LIFT * (times_u + 1) * share) & (excess >= DEVIATIONS))
    return np.sort(good[np.argsort(-excess[good], kind="stable")[:KEPT]])


def _rows(texts: DataFrame, kept: np.ndarray) -> np.ndarray:
    """Counts of the kept features and the extent of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column("text"):
                bucket, count, words = features(t.as_py())
                row = np.zeros(len(kept) + 2, np.float32)
                at = np.minimum(np.searchsorted(kept, bucket), max(len(kept) - 1, 0))
                hit = kept[at] == bucket if len(kept) else np.zeros(len(bucket), bool)
                row[at[hit]] = count[hit]
                row[-2:] = extent(words)
                found.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float32()))], names=["row"])

    got = map_batches(texts.select("text"), run, "row array<float>").toArrow()["row"].combine_chunks()
    return got.values.to_numpy().reshape(len(got), len(kept) + 2)


_NONE = Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(2), -50.0)


def fit(positive: DataFrame, unlabelled: DataFrame, prior: float) -> Model:
    """``positive``, ``unlabelled``: text. What reaches the driver is a count for
    each n-gram of SUPPORT positives or more, and KEPT numbers a text."""
    n_p, n_u = positive.count(), unlabelled.count()
    if not n_p or not n_u or not 0 < prior < 1:
        return _NONE
    p = _counted(positive)
    order = np.argsort(p["bucket"].to_numpy())
    bucket, texts_p, times_p = (p[c].to_numpy()[order] for c in ("bucket", "texts", "times"))
    texts_u, times_u = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
    if len(bucket):
        u = _counted(unlabelled, bucket)
        at = np.searchsorted(bucket, u["bucket"].to_numpy())
        texts_u[at], times_u[at] = u["texts"].to_numpy(), u["times"].to_numpy()
    kept = bucket[choose(texts_p, times_p, texts_u, times_u, n_p, n_u, prior)].astype(np.int64)
    w, b = nnpu(_rows(positive, kept), _rows(unlabelled, kept), prior)
    return Model(kept, w[:-2], w[-2:], b)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """``docs``: doc_id, text of the training rows; ``labels``: doc_id, toxic of theirs."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    said = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not said["n"] or not said["toxic"]:
        return _NONE
    prior = min(said["toxic"] / said["n"], 0.9)
    # The ids are at most ``positives``, so their broadcast is bounded.
    toxic = known.where("toxic = 1").orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id").limit(positives)
    p = docs.join(F.broadcast(toxic.select("doc_id")), "doc_id", "left_semi").select("text").limit(2 * positives)
    n = docs.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), 1 << 30) / float(1 << 30)
    u = docs.where(draw < min(1.0, unlabelled / max(n, 1))).select("text").limit(2 * unlabelled)
    return fit(spool(p, "positives"), spool(u, "unlabelled"), prior)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score and predicted to the columns of ``docs`` (text among them)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([shared.value.score(t.as_py()) for t in b.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=[*b.schema.names, "score", "predicted"],
            )

    had = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, run, f"{had}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = THRESHOLD, keep=()) -> DataFrame:
    """doc_id, text, ``keep``, score and predicted. ``learn`` holds for doc_ids that may teach."""
    rows = docs.select("doc_id", "text", *keep)
    model = train(docs.select("doc_id", "text").where(learn), labels.select("doc_id", "toxic").where(learn))
    return score(rows, model, threshold)
