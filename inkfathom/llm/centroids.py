"""k-means in exact integers, screened in float32 under proven error bounds.

A component x becomes the integer floor(``scale`` x). A round assigns every vector
to the centroid at the least squared distance, the lower number of equal ones,
and puts the floor of the mean in each centroid's place. What counts in

    |v - c|^2 = |v|^2 - 2 v.c + |c|^2

is s(c) = |c|^2 - 2 v.c. The products v.c of a batch and all centroids are one
float32 matrix product. With u = 2^-24, a product of d terms, summed in any
order, with or without fused steps, is off by at most g |v| |c|, where
g = (d + 2) u / (1 - (d + 2) u) covers the rounding of v and c to float32 as
well (Higham, Accuracy and Stability of Numerical Algorithms, section 3.1; |v|.|c|
componentwise is at most the product of the norms). So s(c) lies in an interval
of half-width 2 g |v| |c|, widened by the error of the double precision steps
around it. A centroid can be nearest only if its interval's low end does not
lie above the lowest high end of all. Most vectors keep one centroid; for the
others the distances to those that are left are computed in exact integers.

Integers below 2^24 are float32 numbers themselves, and their squared distances
fit 63 bits for up to 4096 components. Batches with greater ones, or of more
components, are not screened but compared with Python's integers, much slower.

Each round reads the table once and shuffles one row a task and centroid: counts
and componentwise sums (where 63 bits might not hold them, in limbs of 40 bits),
which Spark adds up. The driver gets a row a centroid, and sends back as much.

Defined cases: vectors that are null, have another number of components, or hold
null or non-finite ones are left out; repeated rows and ids count as often as
they come; a null id's hash is null, so it begins a centroid only where there
are too few others; with fewer vectors than ``k`` there are as many centroids;
ties of ids among the first centroids go by the vector; a distance or sum that
no bigint holds is null; an empty table gives no row; only the named columns
are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import map_batches, spool

K, DIM, ROUNDS, SCALE, SALT = 40, 64, 5, 256, 2
LIMB = 40
#: Components below this are screened in float32 and multiplied in 64-bit integers.
NARROW, MOST_DIMS = 1 << 24, 4096
LONG = 1 << 63
#: Values of a block of pairs whose distances are computed at once.
_BLOCK = 1 << 20


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x) as int64, or as Python's integers where that does not hold them."""
    if not len(x) or np.abs(x).max() < NARROW / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    exact = lambda a: int(a) * SCALE if abs(a) > 2.0**53 else math.floor(a * SCALE)
    return np.array([[exact(a) for a in row] for row in x.tolist()], object).reshape(x.shape)


def _exact(v: np.ndarray, centres: np.ndarray, row: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of pairs (row of v, centre), exact."""
    if v.dtype == object or centres.dtype == object:
        d = v[row] - centres[to]
        return (d * d).sum(1) if len(d) else np.zeros(0, object)
    out, step = np.empty(len(row), np.int64), max(1, _BLOCK // max(1, v.shape[1]))
    for at in range(0, len(row), step):
        d = v[row[at : at + step]] - centres[to[at : at + step]]
        out[at : at + step] = np.einsum("ij,ij->i", d, d)
    return out


def shortlist(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each vector, which centroids float32 cannot rule out. Integers below NARROW in magnitude."""
    d, u = v.shape[1], 2.0**-24
    g = (d + 2) * u / (1 - (d + 2) * u)
    product = (v.astype(np.float32) @ centres.astype(np.float32).T).astype(np.float64)
    norm_v, norm_c = (np.sqrt(np.einsum("ij,ij->i", x, x).astype(np.float64)) for x in (v, centres))
    square = np.einsum("ij,ij->i", centres, centres).astype(np.float64)
    s = square - 2 * product
    # Double precision is off by a few 2^-53 of what goes in: the norms, the square and the difference.
    half = (2 * g * (1 + 2.0**-40)) * np.outer(norm_v, norm_c) + 2.0**-48 * (square + np.abs(s))
    return s - half <= (s + half).min(1)[:, None]


def nearest(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance to it, exact."""
    n, k = len(v), len(centres)
    if v.dtype == object or centres.dtype == object or v.shape[1] > MOST_DIMS:
        v, centres = v.astype(object), centres.astype(object)
        found = [min(range(k), key=lambda j: (gap[j], j)) for gap in (((row - centres) ** 2).sum(1) for row in v)]
        at = np.array(found, np.int64)
        return at, _exact(v, centres, np.arange(n), at)
    left = shortlist(v, centres)
    at = left.argmax(1)
    unsure = np.flatnonzero(left.sum(1) > 1)
    row, to = np.nonzero(left[unsure])
    gaps = np.full((len(unsure), k), np.iinfo(np.int64).max)
    gaps[row, to] = _exact(v, centres, unsure[row], to)
    at[unsure] = gaps.argmin(1)  # the first of equal ones
    return at, _exact(v, centres, np.arange(n), at)


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return whole_numbers(batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def _limbs(total: int, limbs: int) -> list[int]:
    """``total`` in base 2^LIMB, the last limb with the sign."""
    low = [total >> LIMB * i & (1 << LIMB) - 1 for i in range(limbs - 1)]
    return [*low, total >> LIMB * (limbs - 1)]


def _sums(shared, dim: int, limbs: int):
    """Of a task: how many vectors each centroid has, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        count, total = np.zeros(len(centres), np.int64), [[0] * dim for _ in centres]
        for b in batches:
            if b.num_rows:
                v = _vectors(b, dim)
                at, _ = nearest(v, centres)
                order = np.argsort(at, kind="stable")
                own, first = np.unique(at[order], return_index=True)
                for c, part in zip(own.tolist(), np.add.reduceat(v[order], first)):
                    total[c] = [a + int(b) for a, b in zip(total[c], part)]
                count += np.bincount(at, minlength=len(centres))
        full = np.flatnonzero(count).tolist()
        columns = [
            pa.array(full, pa.int32()),
            pa.array(count[full], pa.int64()),
            *(pa.array([[_limbs(a, limbs)[i] for a in total[c]] for c in full], pa.list_(pa.int64())) for i in range(limbs)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", *(f"limb{i}" for i in range(limbs))])

    return run


def _assign(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, gap = nearest(_vectors(b, dim), shared.value)
                gap = [g if g < LONG else None for g in gap.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(at.astype(np.int32)), pa.array(gap, pa.int64())], names=["id", "cluster", "distance"]
                )

    return run


def _narrowed(rows: list[list[int]], dim: int) -> np.ndarray:
    wide = any(abs(a) >= NARROW for row in rows for a in row)
    return np.array(rows, object if wide else np.int64).reshape(-1, dim)


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    dim: int = DIM,
    rounds: int = ROUNDS,
    salt: int = SALT,
) -> DataFrame:
    """The id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector kept."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    given = given.where(F.coalesce((F.size("vector") == dim) & fine, F.lit(False)))
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    first = given.select(key.alias("key"), "vector").orderBy(F.asc_nulls_last("key"), "vector").limit(k).collect()
    centres = _narrowed([whole_numbers(np.array([r["vector"]]))[0].tolist() for r in first], dim)
    most = given.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 0.0
    bits = math.frexp(most)[1] + SCALE.bit_length() + 40  # of a sum of 2^40 rows
    limbs = 1 if bits < 64 else -(-bits // LIMB)
    names = [f"limb{i}" for i in range(limbs)]
    for _ in range(rounds if len(first) else 0):
        shared = spark.sparkContext.broadcast(centres)
        parts = map_batches(
            given.select("vector"), _sums(shared, dim, limbs), "cluster int, n bigint, " + ", ".join(f"{c} array<bigint>" for c in names)
        )
        added = [F.sum(F.get(c, F.lit(i))).alias(f"{c}_{i}") for c in names for i in range(dim)]
        rows = [list(c) for c in centres.tolist()]
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect():  # k rows
            sums = [sum(r[f"{c}_{i}"] << LIMB * j for j, c in enumerate(names)) for i in range(dim)]
            rows[r["cluster"]] = [s // r["n"] for s in sums]
        centres = _narrowed(rows, dim)
        shared.unpersist()
    shared = spark.sparkContext.broadcast(centres)
    kind = given.schema["id"].dataType.simpleString()
    assigned = spool(map_batches(given, _assign(shared, dim), f"id {kind}, cluster int, distance bigint"), "assigned")
    whole = F.when(F.count_if(F.col("distance").isNull()) == 0, F.sum(F.col("distance").cast("decimal(38,0)")))
    totals = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(whole.alias("total")).collect()}  # k rows
    every = None if None in totals.values() else int(sum(totals.values()))
    fits = lambda t: int(t) if t is not None and t < LONG else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    said = spark.createDataFrame(
        [(c, fits(t), fits(every), digests[c]) for c, t in totals.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(said), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
