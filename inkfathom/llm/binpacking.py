"""Best-fit packing of documents into sequences, certified by lower bounds.

A document's ids and an end id are cut only if they are more than ``size``: into
pieces of ``size``, of which the first may be shorter. Pieces of ``size`` fill a
sequence each. The others (items) are dealt to partitions of about ``items``,
which pack them by best-fit decreasing: the longest first, each into the fullest
sequence that has room for it.

Dual-feasible functions u map lengths so that what fits one sequence adds up to
1 at most; the sum of u over all items, rounded up, is then a lower bound of
the number of sequences, and since such sums add up over partitions, of all
partitions together. A partition whose count equals its bound is certified. The
partitions with a gap exchange their documents: these are dealt anew, into
partitions ``merge`` times as large, and best-fit decreasing runs again; the
result is taken if it has fewer sequences. Certified partitions still leave one
sequence or so with room each (bounds are rounded up in each), so the loosest
sequences of every partition, as many as it has sequences of room, are
exchanged as well. This goes on until the count of all partitions equals the
bound of all, an exchange between full-sized partitions brings nothing, or one
partition holds all that is left.

What is dealt and packed is one short row an item, never a text. A partition is
packed from counts by length, so its time grows with lengths and sequences
visited; its memory is that of its items.

Defined cases: a null or empty text is its end id alone; repeated rows are
packed as they come; a null id is kept; an empty table gives no row; only the
named columns are read. A length that many items have is no hot key: items are
dealt by a hash of their place.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.bpe import default_path
from inkfathom.llm.common import map_batches, spool
from inkfathom.llm.packing import END_ID, fast_codec

SIZE = 2048
#: Items dealt to a partition at first, and at most after exchanges.
ITEMS, MOST_ITEMS = 1 << 16, 1 << 20
#: How many partitions meet in one in an exchange.
MERGE = 4
#: Functions of Fekete and Schepers' first family that are tried.
LEVELS = 64

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, rid bigint"


# -- bounds ------------------------------------------------------------------
@lru_cache(4)
def dual_feasible(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Functions of the lengths 0..size, a row each, as numerators and their row's denominator.

    Length over size; for k up to ``LEVELS`` the rounding to k-ths that is
    strict unless (k + 1) lengths fill a sequence; for each eps up to half the
    size: lengths above size - eps as 1 and those below eps as 0; and for a grid
    of eps, multiples of eps counted from the full end for lengths above a half.
    """
    x = np.arange(size + 1, dtype=np.int64)
    rows, below = [x], [size]
    for k in range(1, LEVELS + 1):
        exact = (k + 1) * x % size == 0
        rows.append(np.where(exact, k * x, (k + 1) * x // size * size))
        below.append(k * size)
    for eps in _grid(size // 2, 256):
        rows.append(np.where(x > size - eps, size, np.where(x < eps, 0, x)))
        below.append(size)
        per = size // eps
        rows.append(np.where(2 * x > size, per - (size - x) // eps, np.where(x >= eps, 1, 0)))
        below.append(per)
    return np.array(rows), np.array(below, np.int64)


def _grid(most: int, points: int) -> np.ndarray:
    return np.unique(np.linspace(1, max(most, 1), min(points, max(most, 1))).astype(np.int64))


def dual_sums(counts: np.ndarray, size: int) -> np.ndarray:
    """The sum of each function over the items counted by length (numerators)."""
    return dual_feasible(size)[0] @ counts


def least_bins(sums: np.ndarray, size: int) -> int:
    """No fewer sequences than this hold the items."""
    below = dual_feasible(size)[1]
    return int((-(-sums // below)).max(initial=0))


# -- best-fit decreasing --------------------------------------------------------
def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, by best-fit decreasing, and how full each bin is.

    Items of one length go in together: a bin with room r takes r // length of
    them before another bin is the fullest that fits.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(size + 1)]
    some, used, at = 0, 0, 0  # a bit for each room that some bin has
    values, many = np.unique(lengths, return_counts=True)
    for s, left in zip(values[::-1].tolist(), many[::-1].tolist()):
        while left:
            fits = some >> s << s
            if fits:
                r = (fits & -fits).bit_length() - 1
                each = r // s
                here = room[r][-(-(-left // each)) :]
                del room[r][len(room[r]) - len(here) :]
                if not room[r]:
                    some &= ~(1 << r)
            else:
                r, each = size, size // s
                here = list(range(used, used + -(-left // each)))
                used += len(here)
            n = min(left, each * len(here))
            part = order[at : at + n]
            bins[part] = np.repeat(here, each)[:n]
            offsets[part] = size - r + s * (np.arange(n) % each)
            last = n - each * (len(here) - 1)  # the last bin may take fewer
            for count, them in ((each, here[:-1]), (last, here[-1:])):
                if them:
                    room[r - s * count] += them
                    some |= 1 << (r - s * count)
            left -= n
            at += n
    full = np.zeros(used, np.int64)
    np.add.at(full, bins, lengths)
    return bins, offsets, full


# -- rounds --------------------------------------------------------------------
def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, size: int) -> DataFrame:
    """A row for each piece, as ``PIECES``; rid tells equal rows apart."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, end, rid = fast_codec(path), np.array([END_ID], "<u4").tobytes(), TaskContext.get().partitionId() << 36
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                raw = c.encode(text.as_py()) + end
                n = len(raw) // 4
                cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                for piece, (i, j) in enumerate(zip(cuts, cuts[1:])):
                    out.append((doc_id, piece, i, j - i, zlib.crc32(raw[4 * i : 4 * j]), rid))
                    rid += 1
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4)
            columns = zip(*out) if out else [[]] * len(kinds)
            names = [f.split()[0] for f in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=names)

    return map_batches(rows, run, PIECES)


def _packed(size: int, turn: int, most_items: int):
    """Packs one partition; keeps what it was given if that has no more sequences."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        length = rows["length"].to_numpy()
        group = rows["grp"][0].as_py()
        bins, offset, full = best_fit(length, size)
        sequence = (turn << 58 | group << 26) + bins
        if turn:
            old, bins_old = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)
            if len(old) <= len(full):
                bins, sequence, offset = bins_old, rows["sequence_id"].to_numpy(), rows["offset"].to_numpy()
                full = np.zeros(len(old), np.int64)
                np.add.at(full, bins, length)
        certified = len(full) == least_bins(dual_sums(np.bincount(length, minlength=size + 1), size), size)
        free = len(full) * size - int(length.sum())
        loose = np.zeros(len(full), bool)
        loose[np.argsort(full, kind="stable")[: -(-free // size)]] = True
        again = loose[bins] | (not certified and len(length) * MERGE <= most_items)
        found = {"sequence_id": sequence, "offset": offset, "again": again, "certified": np.full(len(bins), certified)}
        return pa.table({**{c: rows[c] for c in rows.column_names if c not in found}, **found}).select(_NAMES)

    return run


_PLACED = PIECES + ", grp bigint, sequence_id bigint, offset bigint, again boolean, certified boolean"
_NAMES = [f.split()[0] for f in _PLACED.split(", ")]


def pack_best_fit(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    items: int = ITEMS,
    most_items: int = MOST_ITEMS,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and certified, a row a piece.

    ``certified``: the last partition that packed the piece holds no more
    sequences than any packing of its items needs.
    """
    every = spool(pieces(docs, path or default_path(), id_col, text_col, size), "pieces")
    short = every.where(F.col("length") < size)
    counts = np.zeros(size + 1, np.int64)
    for r in short.groupBy("length").count().collect():  # fewer rows than ``size``
        counts[r["length"]] = r["count"]
    bound, groups = least_bins(dual_sums(counts, size), size), max(1, math.ceil(counts.sum() / items))
    whole = every.where(F.col("length") >= size).select(
        *every.columns, F.col("rid").bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.lit(True).alias("certified")
    )
    dealt = short.select(*every.columns, F.pmod(F.xxhash64("rid"), groups).alias("grp"))
    starts = F.count_if(F.col("offset") == 0)
    settled, total, turn, pool = [whole], 0, 0, None
    while True:
        placed = spool(dealt.groupBy("grp").applyInArrow(_packed(size, turn, most_items), _PLACED), "packed")
        total += placed.agg(starts).first()[0] - (pool.agg(starts).first()[0] if turn else 0)
        pool = placed.where("again")
        groups = pool.select("grp").distinct().count() if total > bound else 0
        if groups < 2:
            settled.append(placed)
            break
        settled.append(placed.where("not again"))
        turn += 1
        cluster = F.pmod(F.xxhash64("grp", F.lit(turn)), math.ceil(groups / MERGE))
        dealt = pool.drop("again", "certified").withColumn("grp", cluster)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified"]
    out = settled[0].select(columns)
    for part in settled[1:]:
        out = out.unionByName(part.select(columns))
    return out
