"""Exact near-duplicate join of vectors by cosine, as a metric range join.

On unit vectors a cosine of at least ``least`` is a Euclidean distance of at
most e = sqrt(2 - 2 least). Within each label, pivots from a bounded sample
part the vectors into cells by nearest pivot; there are as many as the label
has multiples of ``cell``. By the triangle inequality a vector y of cell h can
only be within e of a member of cell j if it lies within e of the hyperplane
halfway between their pivots,

    (d(y, p_j)^2 - d(y, p_h)^2) / (2 d(p_j, p_h)) <= e

so y visits those cells of lower number as well, which is enough to bring each
pair together once. A cell is cut into shells of width e by the distance from
its pivot: only rows of one shell or of neighbouring ones can be linked. Each
cell is joined by itself, in blocks of at most about ``block`` by ``block`` rows
that are spread over tasks, as matrix products in double precision. Blocks give
link counts and a spanning forest, never pairs. Equal vectors of a label (told
by two 64-bit hashes of different seeds) are joined once, with their number.

Vectors spread evenly over many dimensions lie near most hyperplanes and in one
shell: the join is exact there too, but a label of n vectors then makes about
n^2 / (2 block) rows.

Defined cases: null labels, null, empty or zero vectors, and those with null or
non-finite components link with nothing; so do vectors of different lengths;
labels may have any type that has a text form; a null id is counted as a link
but names no component; components of any finite magnitude count alike;
repeated rows link with each other; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from inkfathom.llm.common import map_batches, spool
from inkfathom.llm.components import components, join_spread

LEAST = 0.93
BLOCK = 4096
#: Vectors to a cell aimed at; pivots of a label, and of all labels together, which bound what is broadcast.
CELL, PIVOTS, ALL_PIVOTS = 4096, 4096, 16384
#: Vectors from which a label's pivots are picked, for each pivot, in expectation; SAMPLE at least.
PER_PIVOT, SAMPLE = 4, 512
#: Rows of a block multiplied at once.
TILE = 1024


def matrix(column: pa.Array, rows: slice) -> np.ndarray:
    """Vectors of equal length as unit rows in double precision.

    Rows are first scaled by a power of two (which rounds nothing that counts) to
    a largest component of 1/2 to 1, so that no square overflows or vanishes.
    """
    part = column.slice(rows.start, rows.stop - rows.start)
    x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    picked = [0]
    near = x @ x[0]
    while len(picked) < min(n, len(x)):
        k = int(near.argmin())
        if near[k] > 1 - 1e-9:
            break
        picked.append(k)
        near = np.maximum(near, x @ x[k])
    return x[picked]


def pick_pivots(vectors: DataFrame, cell: int) -> dict[tuple[str, int], np.ndarray]:
    """Pivots of each (label, dim) of more than ``cell`` vectors; others have one cell."""
    spark = vectors.sparkSession
    sizes = vectors.groupBy("label", "dim").count().where(F.col("count") > cell)
    large = sizes.orderBy(F.desc("count"), "label", "dim").limit(ALL_PIVOTS // 2).collect()
    wanted, left = [], ALL_PIVOTS
    for r in large:
        n = min(PIVOTS, left, math.ceil(r["count"] / cell))
        if n > 1:
            wanted.append((r["label"], r["dim"], n, min(1.0, max(SAMPLE, PER_PIVOT * n) / r["count"])))
            left -= n
    if not wanted:
        return {}
    asked = spark.createDataFrame(wanted, "label string, dim int, pivots int, share double")
    draw = F.pmod(F.xxhash64("rid", F.lit("pivot")), 1 << 30) / float(1 << 30)
    drawn = vectors.join(F.broadcast(asked), ["label", "dim"]).where(draw < F.col("share"))
    drawn = drawn.select("label", "dim", "vector").limit(2 * sum(max(SAMPLE, PER_PIVOT * w[2]) for w in wanted))
    got = drawn.orderBy("label", "dim", F.xxhash64("vector")).toArrow().combine_chunks()
    keys = list(zip(got["label"].to_pylist(), got["dim"].to_pylist()))
    first = {k: i for i, k in reversed(list(enumerate(keys)))}
    last = {k: i + 1 for i, k in enumerate(keys)}
    column = got["vector"].combine_chunks() if len(keys) else None
    return {
        (label, dim): farthest_first(matrix(column, slice(first[label, dim], last[label, dim])), n)
        for label, dim, n, _ in wanted
        if (label, dim) in first
    }


def _runs(*columns: np.ndarray) -> Iterator[slice]:
    """Runs of rows that agree in all columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    edges = [0, *np.flatnonzero(new).tolist(), n]
    yield from (slice(a, b) for a, b in zip(edges, edges[1:]) if a < b)


def _texts(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), object)


def _cells(pivots: dict[tuple[str, int], np.ndarray], reach: float):
    """Rows with each cell that they belong to or visit, and the shell there."""
    between = {k: np.sqrt(np.maximum(2 - 2 * (p @ p.T), 0)) for k, p in pivots.items()}
    width = reach * (1 + 1e-6) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            labels, dims = _texts(b.column("label")), b.column("dim").to_numpy()
            order = np.lexsort((dims, labels.astype(str)))
            b = b.take(pa.array(order))
            labels, dims = labels[order], dims[order]
            row, cell, home, shell = [], [], [], []
            for part in _runs(labels, dims):
                key, own = (labels[part.start], int(dims[part.start])), np.arange(part.start, part.stop)
                p = pivots.get(key)
                if p is None:
                    row.append(own)
                    cell.append(np.zeros(len(own), int))
                    shell.append(np.zeros(len(own), int))
                    home.append(np.ones(len(own), bool))
                    continue
                square = np.maximum(2 - 2 * (matrix(b.column("vector"), part) @ p.T), 0)
                h = square.argmin(1)
                gap = square - square[np.arange(len(own)), h][:, None]
                near = gap <= 2 * between[key][h] * reach * (1 + 1e-9) + 1e-9
                near &= np.arange(len(p))[None, :] <= h[:, None]
                at, to = np.nonzero(near)
                row.append(own[at])
                cell.append(to)
                shell.append(np.floor(np.sqrt(square[at, to]) / width).astype(int))
                home.append(to == h[at])
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(c).take(take) for c in ("label", "dim", "rid", "weight", "vector")),
                    pa.array(np.concatenate(cell).astype(np.int32)),
                    pa.array(np.concatenate(shell).astype(np.int32)),
                    pa.array(np.concatenate(home)),
                ],
                names=["label", "dim", "rid", "weight", "vector", "cell", "shell", "home"],
            )

    return run


def units(placed: DataFrame, block: int) -> DataFrame:
    """Rows with each pair of blocks (a, b) of their cell that they take part in.

    Home rows of a shell are dealt to blocks, visitors likewise. A home block
    meets itself and the home blocks after it, of its own shell and of the next,
    and the visitors' blocks of its own shell and of those beside it. A cell of no
    more than two blocks' rows is one unit.
    """
    keys = ["label", "dim", "cell"]
    sizes = placed.groupBy(*keys, "shell", "home").agg(F.count("*").alias("rows")).withColumn("n", F.ceil(F.col("rows") / block).cast("int"))
    lists = sizes.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("shell", "home", "n"))).alias("parts"), F.collect_list("rows").alias("sizes")
    )
    lists = lists.withColumn("rows", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda x, y: x + y))
    dealt = placed.join(lists.select(*keys, "parts", "rows"), keys)
    own = F.filter("parts", lambda p: (p["shell"] == F.col("shell")) & (p["home"] == F.col("home")))
    dealt = dealt.withColumn("k", F.pmod(F.xxhash64("rid"), F.get(own, F.lit(0))["n"]).cast("int"))
    all_blocks = F.flatten(
        F.transform(
            "parts",
            lambda p: F.transform(
                F.sequence(F.lit(0), p["n"] - 1),
                lambda k: F.struct(p["home"].alias("home"), p["shell"].alias("shell"), k.alias("k")),
            ),
        )
    )
    mine = F.struct("home", "shell", "k")
    shell, k, home = F.col("shell"), F.col("k"), F.col("home")

    def first(o: Column) -> Column:
        """This row's block is the pair's first."""
        after = ((o["shell"] == shell) & (o["k"] >= k)) | (o["shell"] == shell + 1)
        return home & ((o["home"] & after) | (~o["home"] & (F.abs(o["shell"] - shell) <= 1)))

    def second(o: Column) -> Column:
        before = ((o["shell"] == shell) & (o["k"] < k)) | (o["shell"] == shell - 1)
        return o["home"] & ((home & before) | (~home & (F.abs(o["shell"] - shell) <= 1)))

    pairs = F.concat(
        F.transform(F.filter(all_blocks, first), lambda o: F.struct(mine.alias("a"), o.alias("b"), F.when(o == mine, 3).otherwise(1).alias("role"))),
        F.transform(F.filter(all_blocks, second), lambda o: F.struct(o.alias("a"), mine.alias("b"), F.lit(2).alias("role"))),
    )
    none = F.struct(F.lit(True).alias("home"), F.lit(0).alias("shell"), F.lit(0).alias("k"))
    alone = F.array(F.struct(none.alias("a"), none.alias("b"), F.when(home, 3).otherwise(2).alias("role")))
    return dealt.select(*keys, "rid", "weight", "vector", F.inline(F.when(F.col("rows") <= 2 * block, alone).otherwise(pairs)))


_OUT = ("rid", "other", "links")


def _join_block(rid: np.ndarray, weight: np.ndarray, role: np.ndarray, x: np.ndarray, least: float) -> pa.RecordBatch:
    """Links between rows of role 1 and 2 (3 is both) and edges (rid, other) that
    connect what the block links."""
    one, two = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    y = x[two].T
    counted, label = np.zeros(len(rid), np.int64), np.arange(len(rid))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(one), TILE):
        a, b = np.nonzero(x[one[at : at + TILE]] @ y >= least)
        a, b = one[at : at + TILE][a], two[b]
        keep = (role[a] != 3) | (role[b] != 3) | (a < b)
        a, b = a[keep], b[keep]
        np.add.at(counted, a, weight[b])
        np.add.at(counted, b, weight[a])
        # Only a spanning forest of the links so far is kept.
        found.append((a, b))
        if sum(len(f[0]) for f in found) > 4 * len(rid):
            label = _least(label, found)
            found = [(np.arange(len(label)), label)]
    label = _least(label, found)
    tied, full = np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(counted)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((rid[full], rid[tied]))),
            pa.array(np.concatenate((rid[full], rid[label[tied]]))),
            pa.array(np.concatenate((counted[full], np.zeros(len(tied), np.int64)))),
        ],
        names=list(_OUT),
    )


def _least(label: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row that each row is connected to."""
    a, b = (np.concatenate([f[i] for f in links]) if links else np.zeros(0, int) for i in (0, 1))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, new[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _blocks(least: float):
    names = ("dim", "cell", "a_home", "a_shell", "a_k", "b_home", "b_shell", "b_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []

        def done() -> pa.RecordBatch:
            return _join_block(*(np.concatenate([h[i] for h in held]) for i in range(4)), least)

        for b in batches:
            if not b.num_rows:
                continue
            labels = _texts(b.column("label"))
            keys = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
            rid, weight, role = (b.column(c).to_numpy() for c in ("rid", "weight", "role"))
            for part in _runs(labels, *keys):
                key = (labels[part.start], *(int(k[part.start]) for k in keys))
                if key != here:
                    if held:
                        yield done()
                    here, held = key, []
                held.append((rid[part], weight[part], role[part], matrix(b.column("vector"), part)))
        if held:
            yield done()

    return run


def join(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = LEAST,
    cell: int = CELL,
    block: int = BLOCK,
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    kept_as = "array<float>" if single else "array<double>"  # what is shuffled is no wider than what was given
    given = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        F.col(label_col).cast("string").alias("label"),
        F.col(vector_col).cast(kept_as).alias("vector"),
    )
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("vector", lambda v: v != 0)
    valid = F.coalesce(F.col("label").isNotNull() & fine & some, F.lit(False))
    same = ["label", "h1", "h2"]
    good = given.where(valid).withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit("other"), "vector"))
    distinct = good.groupBy(*same).agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    distinct = spool(
        distinct.select(F.monotonically_increasing_id().alias("rid"), *same, F.size("vector").alias("dim"), "vector", "weight", "least"),
        "vectors",
    )
    reach = math.sqrt(2 - 2 * least)
    placed = spool(
        map_batches(
            distinct.select("label", "dim", "rid", "weight", "vector"),
            _cells(pick_pivots(distinct, cell), reach),
            f"label string, dim int, rid bigint, weight bigint, vector {kept_as}, cell int, shell int, home boolean",
        ),
        "cells",
    )
    parts = [F.col(f"{s}.{c}").cast("int").alias(f"{s}_{c}") for s in ("a", "b") for c in ("home", "shell", "k")]
    keys = ["label", "dim", "cell", *(f"{s}_{c}" for s in ("a", "b") for c in ("home", "shell", "k"))]
    rows = units(placed, block).select("label", "dim", "cell", *parts, "rid", "weight", "role", "vector")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    found = spool(map_batches(rows, _blocks(least), "rid bigint, other bigint, links bigint"), "links")
    links = found.where("links > 0").groupBy("rid").agg(F.sum("links").alias("links"))
    roots = components(found.where("rid <> other").select(F.col("rid").alias("a"), F.col("other").alias("b")))
    rooted = distinct.join(roots.withColumnRenamed("node", "rid"), "rid", "left").select(
        "rid", *same, "weight", "least", F.coalesce("root", "rid").alias("root")
    )
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("many"))
    total = distinct.agg(F.count("*"), F.sum("weight")).first()
    named = join_spread(rooted, groups, ["root"], "many", total[0], "rid")
    known = named.join(links, "rid", "left").select(
        *same, "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    linked = join_spread(good.select("vec_id", *same), known, same, "weight", total[1] or 0, "vec_id")
    alone = given.where(~valid).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))
