"""Language-model scores from a log-bilinear model trained with
noise-contrastive estimation in numpy.

Words are A-Z lower-cased runs of other than ASCII white space, and each text
ends with one end token; a word of more than ``LONG`` bytes stands as a digest.
The corpus's word counts are exact and distributed.

A token's probability has two levels. The outputs of the first are the ``WORDS``
most frequent words and ``CLASSES`` classes that share all other words out by
their last bytes. In a class each word of ``LEAST`` occurrences or more has a
vector of its own (so their number grows with the corpus, up to ``HOT``), and one
slot holds the class's other words, which take their smoothed share of its count,
and half a count for all its words never seen. Every word has just one place, so
the probabilities after each context sum to one.

First level: the outputs of the two words before a token are projected, by one
matrix for each place, to a predicted vector, whose products with the outputs'
vectors plus biases are the scores. Training minimises the NCE loss against noise
from the unigram counts, with noise shared by a batch so that it is a matrix
product: a start on a bounded sample, then one pass over all training rows in
which each partition goes on from the start, and the average of the outcomes by
tokens (so it depends on how the rows are split). Batched products over all pairs
of context outputs give the normalised log probabilities as one table.

Second level: the same pass counts, over all training rows, how often each place
of a class follows each output. Each class is fitted as a task of its own, by
whole-batch steps on the expected NCE loss of those counts, and normalised by
products over all contexts.

The ``HOT`` most frequent words and their counts are broadcast (a bounded
table); any other word of a text finds its count by a join.

Defined cases: a null or empty text is the end token alone; without training
rows every token's base probability is 1 and the model is its starting point;
a null id counts as '' for the fold; repeated rows give repeated results; only
the named columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import map_batches, spool

END = b""
WORDS, CLASSES, DIM = 192, 64, 24
HOT, LONG = 200_000, 64
#: Occurrences from which a word has a vector in its class, and the vectors' size.
LEAST, WITHIN = 50, 8
SAMPLE_ROWS = 1000
BATCH, NOISE = 4096, 64
#: Characters of text read at once.
READ = 1 << 20
_FLUSH = 300_000
#: What stands in each class for all its words never seen.
UNSEEN = 0.5


def tokens(text: str | None) -> list[bytes]:
    found = (text or "").encode().lower().split()
    if found and max(map(len, found)) > LONG:
        found = [w if len(w) <= LONG else hashlib.blake2b(w, digest_size=LONG - 2).digest() + w[-3:] for w in found]
    found.append(END)
    return found


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def count_words(rows: DataFrame) -> DataFrame:
    """word (binary) and c over all whole texts of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"]
            )

        seen: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column("text"):
                seen.update(tokens(t.as_py()))
                if len(seen) >= _FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return map_batches(rows.select("text"), run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def grouped(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in groups of some READ characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= READ:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class Tokens:
    """The tokens of some texts: codes of hot words (-1: another), outputs, the
    outputs one and two before, and where each text begins."""

    words: list[bytes]
    starts: np.ndarray
    codes: np.ndarray
    out: np.ndarray
    one: np.ndarray
    two: np.ndarray


@dataclass
class Lexicon:
    """Hot words, most frequent first, and what the corpus says of the others.

    A place is a word with a vector in its class, or the class's slot for the
    rest; a class's places follow each other, the rest last.
    """

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    mass: np.ndarray

    @cached_property
    def code(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    @cached_property
    def inside(self) -> int:
        return min(WORDS, len(self.words))

    @property
    def outputs(self) -> int:
        return self.inside + CLASSES

    @cached_property
    def output(self) -> np.ndarray:
        """The output of each hot word."""
        return np.array([i if i < self.inside else self.inside + word_class(w) for i, w in enumerate(self.words)], np.int64)

    @cached_property
    def _places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place of each hot word, the classes' first places, the places' smoothed counts."""
        own = np.arange(len(self.words)) >= self.inside
        with_vector = np.flatnonzero(own & (self.counts >= LEAST))
        cls = self.output[with_vector] - self.inside
        order = np.argsort(cls, kind="stable")
        sizes = np.bincount(cls, minlength=CLASSES) + 1
        first = np.concatenate(([0], np.cumsum(sizes)))
        place = np.full(len(self.words), -1, np.int64)
        place[own] = (first[1:] - 1)[self.output[own] - self.inside]
        place[with_vector[order]] = np.arange(len(order)) + cls[order]
        mass = np.zeros(first[-1])
        mass[place[with_vector]] = self.counts[with_vector] + 0.5
        mass[first[1:] - 1] = np.maximum(self.mass - np.bincount(cls, self.counts[with_vector] + 0.5, CLASSES), UNSEEN)
        return place, first, mass

    @property
    def place(self) -> np.ndarray:
        return self._places[0]

    @property
    def first(self) -> np.ndarray:
        return self._places[1]

    @property
    def place_mass(self) -> np.ndarray:
        return self._places[2]

    @cached_property
    def base_norm(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))

    @cached_property
    def share(self) -> np.ndarray:
        """log10 of each hot word's share of its place."""
        own = np.arange(len(self.words)) >= self.inside
        return np.where(own, np.log10(self.counts + 0.5) - np.log10(self.place_mass[self.place]), 0.0)

    def read(self, texts: list[str | None]) -> Tokens:
        lists = [tokens(t) for t in texts]
        words = list(chain.from_iterable(lists))
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        starts = np.cumsum(sizes) - sizes
        codes = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        out = self.output[codes]
        for i in np.flatnonzero(codes < 0).tolist():
            out[i] = self.inside + word_class(words[i])
        one, two = np.empty_like(out), np.empty_like(out)
        one[1:], two[2:] = out[:-1], out[:-2]
        one[starts] = two[starts] = self.outputs
        two[starts[sizes > 1] + 1] = self.outputs
        return Tokens(words, starts, codes, out, one, two)

    def places(self, t: Tokens) -> np.ndarray:
        """Each token's place in its class, -1 for a word of the first level."""
        found = self.place[t.codes]
        rare = t.codes < 0
        found[rare] = (self.first[1:] - 1)[t.out[rare] - self.inside]
        return found

    def unigram(self) -> np.ndarray:
        """Smoothed counts of the outputs."""
        return np.concatenate((self.counts[: self.inside] + 0.5, self.mass))


def frequent(counts: DataFrame) -> DataFrame:
    """Words of the greatest counts, at most HOT: all from a least count up that
    a histogram of counts gives, so that no task sorts or merges the words."""
    named = counts.where(F.length("word") > 0)
    level = F.floor(F.log2("c") * 64).cast("int")  # some thousands of levels for any corpus
    sizes = named.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("c")).collect()
    taken, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["level"]):
        taken += r["n"]
        if taken > HOT:
            break
        least = r["c"]
    return named.where(F.lit(False) if least is None else F.col("c") >= least)


def lexicon(counts: DataFrame) -> Lexicon:
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.length("word") == 0, F.col("c"))).alias("ends")).first()
    top = frequent(counts).toArrow()
    order = sorted(zip(top["c"].to_pylist(), top["word"].to_pylist()), key=lambda x: (-x[0], x[1]))
    words = [END, *(w for _, w in order)]
    n = np.array([whole["ends"] or 0, *(c for c, _ in order)], np.int64)
    cls = F.crc32(F.substring("word", -3, 3)) % CLASSES
    outside = counts.where(~F.col("word").isin([bytearray(w) for w in words[:WORDS]]))
    mass = np.full(CLASSES, UNSEEN)
    for r in outside.groupBy(cls.alias("k")).agg((F.sum("c") + 0.5 * F.count("*")).alias("m")).collect():
        mass[r["k"]] += float(r["m"])
    return Lexicon(words, n, int(whole["n"] or 0), int(whole["v"]), mass)


class LogBilinear:
    """score(w | u, v) = (R[u] C1 + R[v] C2) . Q[w] + b[w]; u is the output just before."""

    def __init__(self, unigram: np.ndarray):
        rng = np.random.default_rng(1)
        self.out = len(unigram)
        self.shapes = {"R": (self.out + 1, DIM), "C1": (DIM, DIM), "C2": (DIM, DIM), "Q": (self.out, DIM), "b": (self.out,)}
        self.noise = unigram / unigram.sum()
        self.p = {k: rng.normal(0, 0.1, shape) for k, shape in self.shapes.items()}
        self.p["C1"] += np.eye(DIM)
        self.p["C2"] += np.eye(DIM)
        self.p["b"] = np.log(self.noise)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.shapes])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, shape in self.shapes.items():
            n = int(np.prod(shape))
            self.p[k] = flat[at : at + n].reshape(shape).copy()
            at += n

    def train(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, rate: float, rng, state: dict) -> None:
        """A step of Adagrad on the NCE loss for each batch; ``one`` is the output just before."""
        expect = np.log(NOISE * self.noise)
        for at in range(0, len(target), BATCH):
            u, v, w = one[at : at + BATCH], two[at : at + BATCH], target[at : at + BATCH]
            R, C1, C2, Q, b = (self.p[k] for k in self.shapes)
            r = (R @ C1)[u] + (R @ C2)[v]
            drawn = rng.choice(self.out, NOISE, p=self.noise)
            s_data = np.einsum("ij,ij->i", r, Q[w]) + b[w] - expect[w]
            s_noise = r @ Q[drawn].T + (b - expect)[drawn]
            g_data = (1 / (1 + np.exp(-np.clip(s_data, -30, 30))) - 1) / len(w)
            g_noise = 1 / (1 + np.exp(-np.clip(s_noise, -30, 30))) / len(w)
            d_r = g_data[:, None] * Q[w] + g_noise @ Q[drawn]
            grad = {k: np.zeros_like(self.p[k]) for k in self.shapes}
            _add(grad["Q"], w, g_data[:, None] * r)
            np.add.at(grad["Q"], drawn, g_noise.T @ r)
            grad["b"] += np.bincount(w, g_data, self.out)
            np.add.at(grad["b"], drawn, g_noise.sum(0))
            by_one, by_two = np.zeros_like(R), np.zeros_like(R)
            _add(by_one, u, d_r)
            _add(by_two, v, d_r)
            grad["R"] = by_one @ C1.T + by_two @ C2.T
            grad["C1"], grad["C2"] = R.T @ by_one, R.T @ by_two
            for k, g in grad.items():
                state[k] = state.get(k, 1e-8) + g * g
                self.p[k] -= rate * g / np.sqrt(state[k])

    def table(self) -> np.ndarray:
        """log10 P(output | one, two) at [(one * (out + 1) + two), output]."""
        n = self.out + 1
        R, C1, C2, Q, b = (self.p[k].astype(np.float32) for k in self.shapes)
        first, second = R @ C1 @ Q.T, R @ C2 @ Q.T + b
        found = np.empty((n * n, self.out), np.float32)
        for u in range(n):
            s = first[u] + second
            s -= s.max(1, keepdims=True)
            s -= np.log(np.exp(s).sum(1, keepdims=True))
            found[u * n : (u + 1) * n] = s / np.float32(np.log(10))
        return found


def _add(to: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """to[rows] += values, with repeated rows, by sorting."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    to[ordered[first]] += np.add.reduceat(values[order], first, axis=0)


@dataclass
class Within:
    """The second level: P(place | class, output before) is the softmax over the
    class's places of U[class, before] . Q[place] + b[place], log-normalised by Z."""

    U: np.ndarray
    Q: np.ndarray
    b: np.ndarray
    Z: np.ndarray

    def score(self, cls: np.ndarray, place: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 P of each token."""
        u = self.U[cls, before]
        return (np.einsum("ij,ij->i", u, self.Q[place]) + self.b[place] - self.Z[cls, before]) / np.log(10)


def within_start(lex: Lexicon) -> Within:
    """The unigram shares, as they are for a class that training never meets."""
    sizes = np.diff(lex.first)
    b = np.log(lex.place_mass / np.repeat(np.add.reduceat(lex.place_mass, lex.first[:-1]), sizes))
    n = lex.outputs + 1
    return Within(np.zeros((CLASSES, n, WITHIN), np.float32), np.zeros((len(b), WITHIN), np.float32), b.astype(np.float32), np.zeros((CLASSES, n), np.float32))


def fit_class(counts: np.ndarray, noise: np.ndarray, steps: int = 80, rate: float = 0.05, draws: int = NOISE):
    """U, Q, b, Z of a class from how often each place follows each output.

    Adam on the expected NCE loss, with ``draws`` noise places from ``noise`` for
    each token and a standard normal prior on U and Q.
    """
    rng, total = np.random.default_rng(4), counts.sum()
    b = np.log(noise).astype(np.float32)
    U = rng.normal(0, 0.1, (len(counts), WITHIN)).astype(np.float32)
    Q = rng.normal(0, 0.1, (len(noise), WITHIN)).astype(np.float32)
    if total and len(noise) > 1:
        data = (counts / total).astype(np.float32)
        drawn = draws * data.sum(1, keepdims=True) * noise.astype(np.float32)
        expect = np.log(draws * noise).astype(np.float32)
        p = {"U": U, "Q": Q, "b": b}
        m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            true = 1 / (1 + np.exp(np.clip(expect - b - U @ Q.T, -30, 30)))
            g = drawn * true - data * (1 - true)
            grad = {"U": g @ Q + U / total, "Q": g.T @ U + Q / total, "b": g.sum(0)}
            for k, x in p.items():
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.99 * v[k] + 0.01 * grad[k] ** 2
                x -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + np.float32(1e-9))
    s = U @ Q.T + b
    top = s.max(1)
    return U, Q, b, top + np.log(np.exp(s - top[:, None]).sum(1))


def start(lex: Lexicon, rows: DataFrame, id_col: str, sample: int = SAMPLE_ROWS, epochs: int = 3) -> LogBilinear:
    """A model trained on the driver, on some ``sample`` training rows drawn by a hash of the id."""
    model = LogBilinear(lex.unigram())
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("lm")), 1 << 30) / float(1 << 30)
    drawn = rows.where(draw < min(1.0, sample / max(n, 1))).limit(2 * sample)
    shared = rows.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts in grouped(b.column("text").to_pylist()):
                t = shared.value.read(texts)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int16)) for x in (t.one, t.two, t.out)], names=["one", "two", "out"])

    got = map_batches(drawn.select("text"), run, "one smallint, two smallint, out smallint").toArrow()
    if got.num_rows:
        one, two, target = (got[c].to_numpy().astype(np.int64) for c in ("one", "two", "out"))
        rng, state = np.random.default_rng(2), {}
        for _ in range(epochs):
            order = rng.permutation(len(target))
            model.train(one[order], two[order], target[order], 0.1, rng, state)
    return model


def go_on(lex: Lexicon, model: LogBilinear, rows: DataFrame) -> tuple[LogBilinear, Within]:
    """One pass over all rows: partitions' parameters averaged by tokens, and the
    counts from which each class is fitted."""
    spark = rows.sparkSession
    width = len(lex.place_mass)
    shared = spark.sparkContext.broadcast((lex, model.flat()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lx, flat = shared.value
        own = LogBilinear(lx.unigram())
        own.load(flat)
        rng, state, seen = np.random.default_rng(3), {k: np.full(s, 1e-4) for k, s in own.shapes.items()}, 0
        class_of = np.repeat(np.arange(CLASSES), np.diff(lx.first)).astype(np.int32)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def cells() -> tuple[np.ndarray, np.ndarray]:
            cell, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return cell, np.bincount(at, np.concatenate([h[1] for h in held])).astype(np.int64)

        def out(cls: np.ndarray, place: np.ndarray, x: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(place), pa.array(x), pa.array(n)], names=["cls", "place", "x", "n"])

        def out_cells() -> pa.RecordBatch:
            cell, n = cells()
            return out(class_of[cell % width], cell, np.zeros(len(cell)), n)

        for b in batches:
            for texts in grouped(b.column("text").to_pylist()):
                t = lx.read(texts)
                order = rng.permutation(len(t.out))
                own.train(t.one[order], t.two[order], t.out[order], 0.02, rng, state)
                seen += len(t.out)
                place = lx.places(t)
                low = place >= 0
                held.append(np.unique(t.one[low] * width + place[low], return_counts=True))
                if sum(len(h[0]) for h in held) >= 8 * _FLUSH:
                    held = [cells()]
                    if len(held[0][0]) >= 4 * _FLUSH:
                        yield out_cells()
                        held = []
        if held:
            yield out_cells()
        if seen:
            x = own.flat()
            yield out(np.full(len(x), -1, np.int32), np.arange(len(x)), x * seen, np.full(len(x), seen))

    parts = map_batches(rows.select("text"), run, "cls int, place bigint, x double, n bigint")
    sums = spool(parts.groupBy("cls", "place").agg(F.sum("x").alias("x"), F.sum("n").alias("n")), "trained")
    got = sums.where("cls = -1").select("place", (F.col("x") / F.col("n")).alias("x")).toArrow()
    if got.num_rows:
        flat = np.empty(got.num_rows)
        flat[got["place"].to_numpy()] = got["x"].to_numpy()
        model.load(flat)

    def fit(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        lx, _ = shared.value
        a, z = lx.first[key[0]], lx.first[key[0] + 1]
        counts = np.zeros((lx.outputs + 1, z - a), np.float32)
        cell = found["place"].to_numpy()
        counts[cell // width, cell % width - a] = found["n"].to_numpy()
        noise = lx.place_mass[a:z] / lx.place_mass[a:z].sum()
        return pd.DataFrame({"cls": [key[0]], **{k: [x.ravel().tolist()] for k, x in zip("uqbz", fit_class(counts, noise))}})

    within = within_start(lex)
    floats = ", ".join(f"{k} array<float>" for k in "uqbz")
    for r in sums.where("cls >= 0").groupBy("cls").applyInPandas(fit, f"cls int, {floats}").toArrow().to_pylist():
        k, part = r["cls"], slice(lex.first[r["cls"]], lex.first[r["cls"] + 1])
        within.U[k], within.Z[k] = np.reshape(r["u"], within.U[k].shape), r["z"]
        within.Q[part], within.b[part] = np.reshape(r["q"], (-1, WITHIN)), r["b"]
    return model, within


_kept: dict[int, np.ndarray] = {}


def _table_of(key: int, model: LogBilinear) -> np.ndarray:
    """A worker keeps the last model's table."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = model.table()
    return _kept[key]


def token_scores(lex: Lexicon, table: np.ndarray, within: Within, t: Tokens) -> np.ndarray:
    """log10 probability of each token, of one that is not hot without its share of its place."""
    found = table[t.one * (lex.outputs + 1) + t.two, t.out].astype(np.float64)
    place = lex.places(t)
    low = np.flatnonzero(place >= 0)
    found[low] += within.score(t.out[low] - lex.inside, place[low], t.one[low])
    found += np.where(t.codes >= 0, lex.share[t.codes], -np.log10(lex.place_mass[place]))
    return found


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """id, ``keep``, n_tokens, n_known, train_tokens, base_score and score of each row.

    ``learn``: which rows train.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), *keep)
    taught = docs.where(learn).select(F.col(id_col), F.col(text_col).alias("text"))
    counts = spool(count_words(taught), "words")
    lex = lexicon(counts)
    model, within = go_on(lex, start(lex, taught, id_col), taught)
    shared = docs.sparkSession.sparkContext.broadcast((lex, model, within))
    key = hash(model.flat().tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lx, m, w = shared.value
        table = _table_of(key, m)
        hot_base = np.log10(lx.counts + 0.5)
        known = lx.counts > 0
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
        for b in batches:
            cols: list[list] = [[] for _ in kinds]
            for texts in grouped(b.column("text").to_pylist()):
                t = lx.read(texts)
                hot = t.codes >= 0
                sums = lambda x: np.add.reduceat(x, t.starts)  # noqa: E731, B023
                n = np.diff(np.append(t.starts, len(t.codes)))
                cols[0] += n.tolist()
                cols[1] += sums((hot & known[t.codes]).astype(np.int64)).tolist()
                cols[2] += (sums(np.where(hot, hot_base[t.codes], 0.0)) - n * lx.base_norm).tolist()
                cols[3] += sums(token_scores(lx, table, w, t)).tolist()
                rare: list[Counter[bytes]] = [Counter() for _ in texts]
                at = np.flatnonzero(~hot)
                for i, text in zip(at.tolist(), (np.searchsorted(t.starts, at, "right") - 1).tolist()):
                    rare[text][t.words[i]] += 1
                cols[4] += [list(r) for r in rare]
                cols[5] += [list(r.values()) for r in rare]
            rest = [(n, c) for n, c in zip(b.schema.names, b.columns) if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(c for _, c in rest), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=[*(n for n, _ in rest), "n_tokens", "hot_known", "hot_base", "hot_score", "rare", "times"],
            )

    had = [f for f in rows.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in had)
    scored = map_batches(
        rows,
        run,
        schema + ", n_tokens bigint, hot_known bigint, hot_base double, hot_score double, rare array<binary>, times array<bigint>",
    )
    scored = spool(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    one_each = scored.select("row", F.inline(F.arrays_zip("rare", "times"))).withColumnRenamed("rare", "word")
    share = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    found = one_each.join(counts, "word", "left").select(
        "row",
        (F.col("times") * share).alias("part"),
        (F.col("times") * F.when(F.col("c") > 0, share).otherwise(F.lit(float(np.log10(UNSEEN))))).alias("own"),
        F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("known"),
    )
    sums = found.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("part", "own", "known")))
    none = F.lit(0.0)
    return scored.join(sums, "row", "left").select(
        *(f.name for f in had),
        "n_tokens",
        (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("bigint").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("part", none)).alias("base_score"),
        (F.col("hot_score") + F.coalesce("own", none)).alias("score"),
    )
