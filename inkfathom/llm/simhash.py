"""SimHash near-duplicates, found with BK-trees.

A fingerprint has 64 bits. Documents with one fingerprint count once. Two
fingerprints that differ in at most ``radius`` of ``blocks`` > radius bit
blocks agree in ``blocks - radius`` of them, so each choice of that many blocks
is a table, and equal block values make a shard: every pair in reach shares a
shard. Each shard's BK-tree keys a child by its Hamming distance to its parent;
a search follows only the edges within the radius. Trees meet their queries by
a shuffle of the shard key: they grow with the data, so they are not sent
through the driver. A shard of more than ``tree_size`` fingerprints is cut once
more in the same way by the bits that its members need not agree on. One that
is still larger is split into trees of about that size, each of which all of
the shard's fingerprints search, so no task holds a whole hot shard.

``near_copies`` is for copies with more edits, five-word shingles of which 0.8 are
shared, whose 64-bit fingerprints differ in some nine bits. There fingerprints
are ``bits`` wide, so that a share of differing bits tells the similarity to
within 0.04, and the shards are sampled shingles instead of bit blocks: shingles
are dealt to ``keys`` bins by their hash, and the ``sample`` least hashes of a bin
make a key. Sets of similarity s agree in a bin with a chance of about s^sample,
in one of eight bins of four with 0.98 at s = 0.8. Each shard has its tree, as above,
and gives a spanning forest of its links.

Defined cases: null and empty texts have the fingerprint of no bits and link
like others; fewer words than a shingle make one shingle of them all; a null id
takes part but never names a component (null if no id of it is known); repeated
rows give repeated rows; of the input only the id and text columns are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import map_batches, spool
from inkfathom.llm.components import components, join_spread

#: Shingles hashed before their bits are added up.
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 4) -> int:
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    first, last = starts[: len(tokens) - words + 1].tolist(), (ends[words - 1 :] - 1).tolist()
    digest, n = xxhash.xxh64_intdigest, len(first)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[i:j], 42) for i, j in zip(first[at : at + _CHUNK], last[at : at + _CHUNK])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


class BKTree:
    """Nodes are parallel lists; ``kids[i]`` maps a distance to a node."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.kids: list[dict[int, int]] = []

    def insert(self, x: int) -> None:
        value, kids, at = self.value, self.kids, 0
        if value:
            while True:
                d = (value[at] ^ x).bit_count()
                if d == 0:
                    return
                nxt = kids[at].get(d)
                if nxt is None:
                    kids[at][d] = len(value)
                    break
                at = nxt
        value.append(x)
        kids.append({})

    def within(self, x: int, radius: int) -> list[int]:
        if not self.value:
            return []
        value, kids, found, todo = self.value, self.kids, [], [0]
        while todo:
            at = todo.pop()
            d = (value[at] ^ x).bit_count()
            if d <= radius:
                found.append(value[at])
            for k, child in kids[at].items():
                if -radius <= k - d <= radius:
                    todo.append(child)
        return found


def block_masks(radius: int, blocks: int, within: int = (1 << 64) - 1) -> list[int]:
    """One mask for each choice of blocks of the bits ``within`` that a pair must agree on."""
    bits = [1 << i for i in range(64) if within >> i & 1]
    cuts = [round(len(bits) * i / blocks) for i in range(blocks + 1)]
    single = [sum(bits[a:b]) for a, b in zip(cuts, cuts[1:])]
    return [sum(single[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (mask >> 63 << 64)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _search(radius: int):
    """Links within each shard, from rows sorted by (shard, tree, role)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tree = None, BKTree()
        for b in batches:
            left: list[int] = []
            right: list[int] = []
            rows = zip(*(b.column(c).to_pylist() for c in ("t", "shard", "tree", "member", "probe", "fp")))
            for t, shard, part, member, probe, fp in rows:
                if (t, shard, part) != here:
                    here, tree = (t, shard, part), BKTree()
                x = fp & 0xFFFFFFFFFFFFFFFF
                if probe:
                    for y in tree.within(x, radius):
                        if y != x:
                            left.append(fp)
                            right.append(y - (y >> 63 << 64))
                if member:
                    tree.insert(x)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=_LINKS)

    return run


def links(prints: DataFrame, radius: int = 4, blocks: int = 6, tree_size: int = 2048) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within ``radius``, perhaps repeated.

    ``prints``: distinct fingerprints fp (bigint).
    """
    masks = block_masks(radius, blocks)
    whole = (1 << 64) - 1
    finer = [[_signed(m | own) for own in block_masks(radius, blocks, whole & ~m)] for m in masks]
    tables = F.array(
        *(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("shard")) for i, m in enumerate(masks))
    )
    rows = prints.select("fp", F.inline(tables))
    sizes = rows.groupBy("t", "shard").agg(F.count("*").alias("n")).where("n > 1")
    rows = spool(rows.join(sizes.hint("merge"), ["t", "shard"]), "shards")
    large = rows.where(F.col("n") > tree_size).select("t", "fp")
    own = F.get(F.from_json(F.lit(json.dumps(finer)), "array<array<bigint>>"), F.col("t"))
    nested = F.transform(
        own, lambda m, i: F.struct((i + (F.col("t") + 1) * len(masks)).alias("t"), F.col("fp").bitwiseAND(m).alias("shard"))
    )
    cut = large.select("fp", F.inline(nested))
    cut = cut.join(cut.groupBy("t", "shard").agg(F.count("*").alias("n")).where("n > 1"), ["t", "shard"])
    rows = rows.where(F.col("n") <= tree_size).unionByName(cut.select(*rows.columns))
    trees = F.ceil(F.col("n") / tree_size).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit("tree")), trees).cast("int")
    rows = rows.select(
        "t", "shard", "fp", F.col("n"), own.alias("own"), F.explode(F.sequence(F.lit(0), trees - 1)).alias("tree")
    )
    # In its own tree a fingerprint looks for those put in before it; other trees are whole before it looks.
    rows = rows.select(
        "t", "shard", "tree", (F.col("own") == F.col("tree")).alias("member"), F.lit(True).alias("probe"), "fp"
    )
    dealt = rows.repartition("t", "shard", "tree").sortWithinPartitions("t", "shard", "tree", F.desc("member"), "fp")
    return map_batches(dealt, _search(radius), "a bigint, b bigint")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed bigint) for every row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return map_batches(rows, run, "doc_id bigint, fp bigint")


def fingerprint_texts(texts: DataFrame, wide: bool = False, words: int = 4) -> DataFrame:
    """__text and its fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = (t.as_py() for t in b.column("__text"))
            if wide:
                fps = pa.array([wide_fingerprint(t, words)[0] for t in said], pa.binary())
            else:
                fps = pa.array(np.array([fingerprint(t, words) for t in said], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("__text"), fps], names=["__text", "fp"])

    return map_batches(texts.select("__text"), run, "__text string, fp " + ("binary" if wide else "bigint"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 4,
    radius: int = 4,
    blocks: int = 6,
    tree_size: int = 2048,
) -> DataFrame:
    """doc_id, fp, component_id (the least id reachable by links) and root (the
    group's own key, known without any id)."""
    prints = spool(fingerprints(docs, id_col, text_col, words), "simhash")
    distinct = spool(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    roots = components(links(distinct.select("fp"), radius, blocks, tree_size))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")
    )
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("many"))
    total = distinct.agg(F.count("*"), F.sum("n")).first()
    named = join_spread(rooted.select("fp", "root", "n"), groups, ["root"], "many", total[0], "fp")
    return join_spread(prints, named, ["fp"], "n", total[1] or 0, "doc_id").select("doc_id", "fp", "component_id", "root")


_MIXED = np.array([k * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for k in range(1, 65)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def wide_fingerprint(text: str | None, words: int = 5, bits: int = 512, keys: int = 8, sample: int = 4) -> tuple[bytes, list[int]]:
    """``bits`` / 8 bytes, a bit being 1 if set for over half the shingles, and the bins' keys."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return bytes(bits // 8), []
    joined, size = b" ".join(tokens), min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    first, last = starts[: len(tokens) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist()
    digest, n = xxhash.xxh64_intdigest, len(first)
    ones, least = np.zeros(bits, np.int64), np.zeros(0, np.uint64)
    step = _CHUNK * 64 // bits
    for at in range(0, n, step):
        h = np.array([digest(joined[i:j], 42) for i, j in zip(first[at : at + step], last[at : at + step])], np.uint64)
        many = _mix(h[:, None] + _MIXED[: bits // 64]).view(np.uint8)
        ones += np.unpackbits(many, axis=1).sum(0, dtype=np.int64)
        distinct = np.unique(np.concatenate((least, h)))
        bins = distinct % np.uint64(keys)
        least = np.concatenate([distinct[bins == k][:sample] for k in range(keys)])
    bins = least % np.uint64(keys)
    own = [least[bins == k].tobytes() for k in range(keys)]
    made = [xxhash.xxh64_intdigest(raw, k) for k, raw in enumerate(own) if raw]
    return np.packbits(2 * ones > n).tobytes(), [k - (k >> 63 << 64) for k in made]


def _wide_search(radius: int):
    """A spanning forest of the links within each shard, from rows sorted by (shard, tree, member)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tree, number, up = None, BKTree(), {}, {}

        def root(i: int) -> int:
            while up.setdefault(i, i) != i:
                up[i] = i = up[up[i]]
            return i

        for b in batches:
            pairs: list[tuple[int, int]] = []
            for shard, part, member, rid, fp in zip(*(b.column(c).to_pylist() for c in ("shard", "tree", "member", "rid", "fp"))):
                if (shard, part) != here:
                    here, tree, number, up = (shard, part), BKTree(), {}, {}
                x = int.from_bytes(fp, "big")
                for y in tree.within(x, radius):
                    other = number[y]
                    if root(rid) != root(other):
                        up[root(rid)] = root(other)
                        pairs.append((rid, other))
                if member:
                    tree.insert(x)
                    number[x] = rid
            left, right = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=_LINKS)

    return run


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    bits: int = 512,
    keys: int = 8,
    sample: int = 4,
    radius: int = 86,
    tree_size: int = 2048,
) -> DataFrame:
    """doc_id, fp (binary), component_id and root, like ``near_duplicates``."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [wide_fingerprint(t.as_py(), words, bits, keys, sample) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([f for f, _ in found], pa.binary()), pa.array([k for _, k in found], pa.list_(pa.int64()))],
                names=["doc_id", "fp", "keys"],
            )

    prints = spool(map_batches(rows, run, "doc_id bigint, fp binary, keys array<bigint>"), "simhash")
    same = ["h1", "h2"]
    prints = prints.select("*", F.xxhash64("fp").alias("h1"), F.xxhash64(F.lit("other"), "fp").alias("h2"))
    grouped = prints.groupBy(*same).agg(
        F.first("fp").alias("fp"), F.min("doc_id").alias("least"), F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set("keys"))).alias("keys")
    )
    distinct = spool(grouped.select(F.monotonically_increasing_id().alias("rid"), "*"), "prints")
    placed = distinct.select("rid", "fp", F.explode("keys").alias("shard"))
    sizes = placed.groupBy("shard").agg(F.count("*").alias("size")).where("size > 1")
    placed = placed.join(sizes.hint("merge"), "shard")
    trees = F.ceil(F.col("size") / tree_size).cast("int")
    own = F.pmod(F.xxhash64("rid", F.lit("tree")), trees).cast("int")
    placed = placed.select("shard", "rid", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), trees - 1)).alias("tree"))
    # In its own tree a fingerprint looks for those put in before it; other trees are whole before it looks.
    placed = placed.select("shard", "tree", (F.col("own") == F.col("tree")).alias("member"), "rid", "fp")
    dealt = placed.repartition("shard", "tree").sortWithinPartitions("shard", "tree", F.desc("member"), "rid")
    roots = components(map_batches(dealt, _wide_search(radius), "a bigint, b bigint"))
    rooted = distinct.join(roots.withColumnRenamed("node", "rid"), "rid", "left").select(
        *same, "rid", "least", "n", F.coalesce("root", "rid").alias("root")
    )
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("many"))
    total = distinct.agg(F.count("*"), F.sum("n")).first()
    named = join_spread(rooted.select(*same, "rid", "root", "n"), groups, ["root"], "many", total[0], "rid").drop("rid")
    return join_spread(prints.drop("keys"), named, same, "n", total[1] or 0, "doc_id").select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edited: bool = False, words: int | None = None) -> DataFrame:
    """One row of each near-duplicate group: of its least id, or any if none has an id.

    ``edited``: groups are those of ``near_copies``, else of ``near_duplicates``.

    Where an id stands for rows of several groups, and where there is none, the
    id alone does not say which row is meant: those rows are told by their texts.
    """
    words = words or (5 if edited else 4)
    found = spool((near_copies if edited else near_duplicates)(docs, id_col, text_col, words), "near")
    by_id = found.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.bool_or(F.expr("doc_id = component_id")).alias("least")
    )
    ids = by_id.where("least and low = high").select(F.col("doc_id").alias(id_col))
    kept = docs.join(ids, id_col, "left_semi").dropDuplicates([id_col])
    shared = by_id.where("low <> high").select(F.col("doc_id").alias("same"))
    of_shared = found.where("doc_id = component_id").join(shared, F.col("doc_id") == F.col("same"), "left_semi")
    wanted = found.where("component_id is null").unionByName(of_shared).select(F.col("doc_id").alias("__id"), "fp", "root").distinct()
    if wanted.isEmpty():
        return kept
    wanted = spool(wanted, "wanted")
    asked = F.col(id_col).eqNullSafe(F.col("__id"))
    told = docs.join(wanted.select("__id").distinct(), asked, "left_semi")
    own = told.select(F.struct("*").alias("__row"), F.col(id_col).alias("__own"), F.coalesce(text_col, F.lit("")).alias("__text"))
    texts = fingerprint_texts(own.select("__text").distinct(), edited, words)
    picked = own.join(texts, "__text").join(wanted, "fp").where(F.col("__own").eqNullSafe(F.col("__id"))).dropDuplicates(["root"])
    return kept.unionByName(picked.select("__row.*"))


def as_hex(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
