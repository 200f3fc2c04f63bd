import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

from inkfathom.llm import binpacking, centroids, resampling
from inkfathom.llm.bpe import default_path

# -- best-fit packing --------------------------------------------------------------


def fewest(lengths, size):
    """The least number of bins, by trying all ways."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def put(i, room):
        if len(room) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(room)
            return
        for j in {r: k for k, r in enumerate(room) if r >= lengths[i]}.values():
            put(i + 1, room[:j] + [room[j] - lengths[i]] + room[j + 1 :])
        put(i + 1, room + [size - lengths[i]])

    put(0, [])
    return best[0]


def plain_best_fit(lengths, size):
    room = []
    for s in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= s]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - s)
        else:
            room.append(size - s)
    return sorted(size - r for r in room)


def test_bounds_hold_and_certify():
    rng, met = random.Random(1), 0
    for _ in range(150):
        size = rng.choice([10, 24, 60])
        lengths = np.array([rng.randint(1, size - 1) for _ in range(rng.randint(1, 9))])
        sums = binpacking.dual_sums(np.bincount(lengths, minlength=size + 1), size)
        bound, best = binpacking.least_bins(sums, size), fewest(lengths.tolist(), size)
        assert bound <= best
        met += bound == best
    assert met > 135


def test_functions_are_dual_feasible():
    size = 12
    values, below = binpacking.dual_feasible(size)

    def fillings(left, most):
        yield []
        for s in range(1, min(left, most) + 1):
            for rest in fillings(left - s, s):
                yield [s, *rest]

    for some in fillings(size, size):
        assert (values[:, some].sum(1) <= below).all(), some


def test_best_fit_is_best_fit():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.choice([16, 100, 2048])
        lengths = np.array([rng.choice([rng.randint(1, size - 1), rng.randint(1, max(1, size // 9))]) for _ in range(rng.randint(1, 200))])
        bins, offsets, full = binpacking.best_fit(lengths, size)
        assert sorted(full.tolist()) == plain_best_fit(lengths.tolist(), size)
        for b in range(len(full)):
            at = 0
            for o, s in sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist())):
                assert o == at
                at += s
            assert at == full[b] <= size


def packed_rows(spark, rows, **settings):
    d = spark.createDataFrame(rows, "doc_id bigint, text string, length string, grp string")
    return binpacking.pack_best_fit(d, **settings).collect()


def check_pieces(got, rows, size):
    want = Counter()
    lib = Tokenizer.from_file(default_path())
    for doc_id, text, *_ in rows:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        n, at = len(ids), 0
        cuts = [n] if n <= size else [n % size or size] + [size] * ((n - 1) // size)
        for piece, s in enumerate(cuts):
            want[doc_id, piece, at, s, zlib.crc32(np.array(ids[at : at + s], "<u4").tobytes())] += 1
            at += s
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for o, s in sorted(pieces):
            assert o == at
            at += s
        assert at <= size
    return len(sequences)


def test_packing_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["one", "two", "three,", "four."], k=rng.randint(0, 40))), "x", "y") for i in range(120)]
    rows += [(None, "no id", None, None), (5, rows[5][1], None, None), (900, None, None, None), (901, "", None, None), (902, "word " * 400, "", ""), (903, "a " * 63, "", "")]
    got = packed_rows(spark, rows, size=64)
    n = check_pieces(got, rows, 64)
    assert all(r["certified"] for r in got)
    lengths = [r["length"] for r in got]
    counts = np.bincount([s for s in lengths if s < 64], minlength=65)
    assert n == lengths.count(64) + binpacking.least_bins(binpacking.dual_sums(counts, 64), 64)


def test_exchanges_close_gaps(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([14, 19, 25, 33, 40]), "", "") for i in range(300)]
    alone = check_pieces(packed_rows(spark, rows, size=64, items=1000), rows, 64)
    dealt = packed_rows(spark, rows, size=64, items=12)
    apart = 0
    for part in ([r for r in dealt if r["doc_id"] % 25 == k] for k in range(25)):
        apart += len(plain_best_fit([r["length"] for r in part], 64))
    assert alone <= check_pieces(dealt, rows, 64) < apart


def test_packing_nothing(spark):
    assert packed_rows(spark, []) == []


# -- centroid clustering ---------------------------------------------------------------


def clusters_by_definition(rows, k, dim, rounds, salt):
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(Fraction(x) * 256) for x in v], v))
    key = lambda r: (r[0] is None, hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2])
    centres = [r[1] for r in sorted(kept, key=key)[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((gap(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = defaultdict(list)
        for r in kept:
            own[nearest(r[1])[1]].append(r[1])
        for j, vs in own.items():
            centres[j] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(r[0], *nearest(r[1])[::-1]) for r in kept]
    totals, long = Counter(), lambda x: x if x < 1 << 63 else None
    for _, j, d in found:
        totals[j] += d
    small = all(long(d) is not None for _, _, d in found)
    held = {j: long(t) if all(long(d) is not None for _, c, d in found if c == j) else None for j, t in totals.items()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, long(d), held[j], long(sum(totals.values())) if small else None, digest[j]) for i, j, d in found), key=repr)


def cluster_rows(spark, rows, kind="float", **settings):
    d = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, cluster string, distance string")
    return sorted((tuple(r) for r in centroids.cluster(d, **settings).collect()), key=repr)


def vectors_of(rng, n, dim):
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim) * rng.choice([0.01, 1, 30])], "x", None) for i in range(n)]
    rows += [(n, None, "", ""), (n + 1, [0.5] * (dim - 1), "", ""), (n + 2, [None] + [0.5] * (dim - 1), "", ""), (n + 3, [float("nan")] * dim, "", "")]
    rows += [(n + 4, [float("inf")] * dim, "", ""), (n + 5, [0.0] * dim, "", ""), (3, rows[3][1], "", ""), (n + 6, rows[3][1], "", ""), (None, [0.25] * dim, "", "")]
    return rows


@pytest.mark.parametrize("n, k", [(90, 7), (4, 9)])
def test_clusters(spark, n, k):
    rows = vectors_of(np.random.default_rng(5), n, 6)
    assert cluster_rows(spark, rows, k=k, dim=6, rounds=3) == clusters_by_definition(rows, k, 6, 3, centroids.SALT)


def test_clusters_of_extreme_magnitude(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(-300, 300)], "", "") for i in range(25)]
    rows += [(30, [1.7e308, -1.7e308, 0.0], "", ""), (31, [5e-324, -5e-324, 0.0], "", "")]
    assert cluster_rows(spark, rows, "double", k=4, dim=3, rounds=2) == clusters_by_definition(rows, 4, 3, 2, centroids.SALT)


def test_no_vectors(spark):
    assert cluster_rows(spark, []) == [] == cluster_rows(spark, [(1, None, "", "")])


def test_screening_never_loses_the_nearest():
    rng = np.random.default_rng(7)
    for spread, far in ((3, 0), (1000, 0), (2, (1 << 23) - 10)):  # far from the origin float32 tells few apart
        v = rng.integers(-spread, spread + 1, (400, 64)) + far
        c = np.concatenate((rng.integers(-spread, spread + 1, (38, 64)) + far, v[:1], v[:1]))
        gap = ((v[:, None] - c[None]) ** 2).sum(2)
        left = centroids.shortlist(v, c)
        assert left[gap == gap.min(1)[:, None]].all()
        at, d = centroids.nearest(v, c)
        assert (at == gap.argmin(1)).all() and (d == gap.min(1)).all()
    assert left.sum(1).mean() > 2  # the last case had to be recomputed


# -- importance resampling -----------------------------------------------------------------


def words_of(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        ch = ch.lower() if "A" <= ch <= "Z" else ch
        if ch in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(ch) >= 128:
            word += ch
        elif word:
            out, word = [*out, word], ""
    return out


def resampled_by_definition(docs, target, orders, buckets, least, percent, salt):
    def found(text):
        w = words_of(text)
        return [" ".join(w[i : i + n]) for n in range(orders[0], orders[1] + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in found(x)) for texts in ([d[1] for d in docs], target))
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    rows = []
    for i, text, *_ in docs:
        weight = sum(gain(bucket(f)) for f in found(text))
        h = int(hashlib.sha256(f"{salt}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found(text)), weight, score, None, len(words_of(text))])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


TEXTS = [None, "", "  ", "...", "Ünïcode straße 日本 x", "A_b-C'd 12 12 12", "NUL\x00byte\x7fdel", "w" * 3000, "the " * 50, "THE the"]


def resampling_rows():
    rng = random.Random(8)
    common = ["the", "of", "and", "hot"]
    docs = [(i, t, "c", "d") for i, t in enumerate(TEXTS)]
    docs += [(100 + i, " ".join(rng.choice([rng.choice(common), f"rare{rng.randint(0, 400)}"]) for _ in range(rng.randint(0, 30))), "c", None) for i in range(200)]
    docs += [(100, docs[-1][1], "", ""), (150, docs[60][1], "", ""), (None, docs[70][1], "", "")]
    return docs, ["the rare1 rare2 target target", None, "Straße of rare3 rare1"]


@pytest.mark.parametrize("orders, hot_bytes", [((1, 1), 4 << 20), ((1, 1), 400), ((1, 2), 2000), ((2, 3), 0)])
def test_resampling(spark, orders, hot_bytes):
    docs, target = resampling_rows()
    d = spark.createDataFrame(docs, "doc_id bigint, text string, weight string, rank string")
    t = spark.createDataFrame([(x, "y") for x in target], "text string, s string")
    got = resampling.resample(d, t, orders=orders, buckets=50, least_words=5, percent=30, hot_bytes=hot_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == resampled_by_definition(docs, target, orders, 50, 5, 30, resampling.SALT)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 7} Zoë{i}" for i in range(300))
    want = [resampling.features(text, o) for o in ((1, 1), (1, 3), (2, 2))]
    monkeypatch.setattr(resampling, "_PIECE", 5)
    assert [resampling.features(text, o) for o in ((1, 1), (1, 3), (2, 2))] == want


def test_resampling_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert resampling.resample(none, some).collect() == [] == resampling.resample(none, none).collect()
    assert [(r["n_features"], r["rank"]) for r in resampling.resample(some, none).collect()] == [(3, None)]
