"""Order-preserving packing of documents into sequences, by dynamic programming.

The documents of a partition, each encoded and closed by an end id, make one
stream of ids in the table's order. Cutting it into windows of at most ``size``
ids costs the padding of each window plus a penalty for a cut within a document:
small at the end of a sentence, larger elsewhere. With f(j) the least cost up to
candidate cut j at place P(j),

    f(j) = penalty(j) + min over P(j) - P(i) <= size of f(i) + size - (P(j) - P(i))

(and a small constant for each window, against needlessly short ones) the
minimum of f(i) + P(i) over the sliding window of i is at the head of a monotone
queue. Windows whose length is a power of two are never padded, so they
cost nothing but their cut. Where no boundary comes for a while, places on a
coarse grid are candidates too, so that a window always exists.

A stream is planned in blocks of ``BLOCK`` ids; the plan of a block is kept up to
its best cut in the last window, and the next block goes on from there. Memory
is a block's and the longest document's ids.

Defined cases: a null or empty text is its end id alone; every id lies in one
piece; repeated rows are packed as they come; a null id is kept; an empty table
gives no row; only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.bpe import WORD, Codec, default_path, packed
from inkfathom.llm.common import map_batches

SIZE = 1024
END_ID = 0
BLOCK = 1 << 18
#: Costs of a cut, in ids of padding.
SENTENCE_CUT, HARD_CUT = 3.0, 40.0
#: Cost of a window besides its padding and its cut.
WINDOW = 16.0
#: Places of candidate cuts in stretches without a boundary.
GRID = 64

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


def sentence_ends(c: Codec) -> np.ndarray:
    """For each id, whether a sentence or a line may end with it."""
    return np.array([b"\n" in t or t.rstrip(b"\"')]") .endswith((b".", b"!", b"?")) for t in c.token], bool)


def candidates(n: int, doc_ends: np.ndarray, sentences: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Places in (0, n] where the stream may be cut, and their penalties."""
    place = np.union1d(doc_ends, sentences)
    place = np.union1d(place, [0, n])
    grid = max(1, min(GRID, size // 4))
    gaps = np.flatnonzero(np.diff(place) > 2 * grid)
    if len(gaps):
        place = np.union1d(place, np.concatenate([np.arange(place[g] + grid, place[g + 1], grid) for g in gaps]))
    penalty = np.full(len(place), HARD_CUT)
    penalty[np.isin(place, sentences, assume_unique=True)] = SENTENCE_CUT
    penalty[np.isin(place, doc_ends, assume_unique=True) | (place == n)] = 0.0
    return place, penalty + WINDOW


def plan(place: np.ndarray, penalty: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least cost up to each candidate and the candidate before it. place[0] is 0."""
    n = len(place)
    exact: list[list[int]] = [[] for _ in range(n)]
    power = 1
    while power <= size:
        at = np.searchsorted(place, place - power)
        hit = np.flatnonzero((place >= power) & (place[np.minimum(at, n - 1)] == place - power))
        for j in hit.tolist():
            exact[j].append(int(at[j]))
        power *= 2
    p, w = place.tolist(), penalty.tolist()
    f, came = [0.0] * n, [0] * n
    queue = deque([0])
    for j in range(1, n):
        while p[j] - p[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        best = f[i] + p[i] + size - p[j]
        for k in exact[j]:
            if f[k] < best:
                best, i = f[k], k
        f[j], came[j] = best + w[j], i
        key = f[j] + p[j]
        while queue and f[queue[-1]] + p[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    return np.array(f), np.array(came)


def cuts(place: np.ndarray, penalty: np.ndarray, size: int, last: bool) -> np.ndarray:
    """Where windows end. Unless it is the ``last`` block, up to the best place
    in the last window only."""
    f, came = plan(place, penalty, size)
    at = len(place) - 1
    if not last:
        near = int(np.searchsorted(place, place[-1] - size, "right"))
        at = near + int(np.argmin(f[near:-1] + 0.0)) if near < len(place) - 1 else at
    found = []
    while at:
        found.append(place[at])
        at = came[at]
    return np.array(found[::-1], np.int64)


class FastCodec(Codec):
    """The same ids; the words that are in no cache go to a native encoder."""

    def __init__(self, path: str):
        super().__init__(path)
        ranks = {t: i for i, t in enumerate(self.token) if i not in self.special.values()}
        self._native = tiktoken.Encoding("file", pat_str=WORD, mergeable_ranks=ranks, special_tokens={})

    def _build(self, plain: dict[str, int]) -> None:
        self._goto = []

    def _words_of(self, text: str) -> bytes:
        return packed(self._native.encode_ordinary(text))


@lru_cache(2)
def fast_codec(path: str) -> FastCodec:
    return FastCodec(path)


class Packer:
    """Takes documents in order and gives rows of pieces."""

    def __init__(self, ends: np.ndarray, size: int, first_sequence: int):
        self.ends, self.size, self.sequence = ends, size, first_sequence
        self.pending: list[np.ndarray] = []
        self.count = 0
        #: doc_id, its ids, and where it begins, from the first pending id.
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids), self.count))
        self.pending.append(ids)
        self.count += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch | None:
        if not self.count:
            return None
        ids = np.concatenate(self.pending)
        begins = np.array([d[2] for d in self.docs])
        doc_ends = begins + [d[1] for d in self.docs]
        place, penalty = candidates(len(ids), doc_ends, np.flatnonzero(self.ends[ids]) + 1, self.size)
        windows = cuts(place, penalty, self.size, last)
        done = int(windows[-1])
        edges = np.union1d(np.concatenate(([0], doc_ends[doc_ends < done])), windows)
        left, right = edges[:-1], edges[1:]
        doc = np.searchsorted(begins, left, "right") - 1
        window = np.searchsorted(windows, left, "right")
        window_begin = np.concatenate(([0], windows[:-1]))[window]
        raw = ids.astype("<u4").tobytes()
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(left.tolist(), right.tolist())]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([self.docs[d][0] for d in doc], pa.int64()),
                pa.array(left - begins[doc]),
                pa.array(right - left),
                pa.array(crc, pa.int64()),
                pa.array([self.docs[d][1] for d in doc], pa.int64()),
                pa.array(self.sequence + window),
                pa.array(left - window_begin),
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )
        self.sequence += len(windows)
        self.pending = [ids[done:]]
        self.count = len(ids) - done
        self.docs = [(i, n, at - done) for (i, n, at), end in zip(self.docs, doc_ends.tolist()) if end > done]
        return out


def pack(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE
) -> DataFrame:
    """One row for each piece of a document, as in ``SCHEMA``.

    A sequence belongs to one partition of ``docs``, whose number is in the
    upper half of its sequence_id; each partition pads its last sequence only.
    """
    path = path or default_path()
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = fast_codec(path)
        packer = Packer(sentence_ends(c), size, TaskContext.get().partitionId() << 32)
        end = np.array([END_ID], "<u4")
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                packer.add(doc_id, np.concatenate((np.frombuffer(c.encode(text.as_py()), "<u4"), end)))
                if packer.count >= BLOCK:
                    yield packer.flush(last=False)
        if packer.count:
            yield packer.flush(last=True)

    return map_batches(rows, run, SCHEMA)
