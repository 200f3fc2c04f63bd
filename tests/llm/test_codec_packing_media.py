import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from inkfathom.llm import bpe, media, packing

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    None, "", " ", "  a  b \n\n c\t", "It's we'll DON'T 'tis", "x<|endoftext|> y <|endoftext|>", "日本語 🙂🙂 ẞ é", "a" * 5000,
    "ab" * 4000, "=" * 3000, "tail  ", "\x1c\x85   x", "1234567 3.14", "Line one. Line two!\nThree? \"Four.\" five " * 300,
]


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(bpe.default_path())


@pytest.mark.parametrize("kind", [bpe.Codec, packing.FastCodec])
def test_ids_are_those_of_the_library(reference, kind):
    c, rng = kind(bpe.default_path()), random.Random(4)
    bits = [" ", " ", "\n", "\t", "a", "the", "ing", "'s", "12", "!", "é", "日", "🙂", "<|endoftext|>", ".", "\x85", "Q"]
    for t in [*TEXTS, *("".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(3000))]:
        want = reference.encode(t or "", add_special_tokens=False).ids
        got = np.frombuffer(c.encode(t), "<u4").tolist()
        assert got == want, t
        assert c.decode(got).decode() == reference.decode(want, skip_special_tokens=False)


def test_broken_sequences_decode_like_the_library(reference):
    c, rng = bpe.Codec(bpe.default_path()), random.Random(5)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(1, 12))]
        assert c.decode(ids).decode() == reference.decode(ids, skip_special_tokens=False)


def test_caches_are_bounded(monkeypatch, reference):
    monkeypatch.setattr(bpe, "_CACHED_PIECES", 5)
    monkeypatch.setattr(bpe, "_CACHED_WORDS", 5)
    monkeypatch.setattr(bpe, "_CACHED_PAIRS", 5)
    c = bpe.Codec(bpe.default_path())
    text = " ".join(f"word{i} other{i}" for i in range(200))
    assert np.frombuffer(c.encode(text), "<u4").tolist() == reference.encode(text, add_special_tokens=False).ids
    assert len(c._pieces) <= 5 and len(c._words) <= 5 and len(c._fit) <= 5


def test_encode_query(spark, reference):
    d = spark.createDataFrame([(i, t, "c") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "c"), (None, "x", "c")], "doc_id bigint, text string, ids string")
    got = bpe.encode_documents(d).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        t = "x" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = reference.encode(t, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(d.where("false")).count() == 0


def is_power(n):
    return n & (n - 1) == 0


def check_packing(rows, docs, size):
    docs = [(i, ids) for i, ids in docs]
    for name, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= size
        assert (g["offset"].to_numpy() == np.concatenate(([0], np.cumsum(g["length"])[:-1]))).all()
    seen = {}
    for r in rows.sort_values(["sequence_id", "offset"]).itertuples():
        seen.setdefault(None if pd.isna(r.doc_id) else int(r.doc_id), []).append(r)
    for i, ids in docs:
        at = 0
        for r in sorted(seen[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    lengths = rows.groupby("sequence_id")["length"].sum()
    return sum(0 if is_power(n) else size - n for n in lengths)


def test_packing(spark, reference):
    texts = [t for t in TEXTS if t != " "] + [" ".join(["word. more"] * n) for n in (1, 2, 50, 400, 3000)]
    d = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(None, "no id", 9)], "doc_id bigint, text string, offset int").coalesce(1)
    ids = [(i, [*reference.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in enumerate(texts)] + [(None, [*reference.encode("no id", add_special_tokens=False).ids, 0])]
    rows = packing.pack(d).toPandas()
    total = sum(len(x) for _, x in ids)
    assert check_packing(rows, ids, 1024) <= 0.1 * total + 1024
    assert packing.pack(d.where("false")).count() == 0


def test_blocks_and_windows(monkeypatch):
    rng = np.random.default_rng(0)
    ends = np.zeros(100, bool)
    ends[:5] = True
    docs = [(i, rng.integers(0, 100, rng.integers(1, 400)).astype("<u4")) for i in range(80)]
    for block in (100, 1000, 10**9):
        p, out = packing.Packer(ends, 64, 0), []
        for i, x in docs:
            p.add(i, x)
            if p.count >= block:
                out.append(p.flush(False).to_pandas())
        if p.count:
            out.append(p.flush(True).to_pandas())
        check_packing(pd.concat(out), docs, 64)


def test_plan_is_the_cheapest():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(5, 30))
        place = np.union1d([0, n], rng.integers(0, n, 12))
        while (np.diff(place) > 8).any():
            place = np.union1d(place, place[:-1] + 1)
        penalty = rng.integers(0, 5, len(place)).astype(float)
        f, _ = packing.plan(place, penalty, 8)
        best = [0.0]
        for j in range(1, len(place)):
            costs = [best[i] + (0 if is_power(int(place[j] - place[i])) else 8 - (place[j] - place[i])) for i in range(j) if place[j] - place[i] <= 8]
            best.append(min(costs) + penalty[j])
        assert np.allclose(f, best)


def test_media(spark):
    texts = [None, "", "a", "é" * 40, "x" * 64, "y" * 200_000, "same", "same"]
    d = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(texts)] + [(None, "q", b"z")], "doc_id bigint, text string, media binary")
    got = media.media_columns(d).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        raw = ("q" if r["doc_id"] is None else texts[r["doc_id"]] or "").encode()
        payload = media.padded(raw)
        assert len(payload) % 64 == 0 and payload[: len(raw)] == raw and 0 < len(payload) < len(raw) + 65
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        png = media.to_png(payload)
        assert media.from_png(png) == payload and r["media_sha256"] == hashlib.sha256(png).hexdigest() and r["media_bytes"] == len(png)
        assert r["feature"] == media.feature(payload)
    assert media.media_columns(d.where("false")).count() == 0


def decoded(png):
    """The samples of a picture, by the format alone (none of the module's code)."""
    assert png.startswith(bytes([137, 80, 78, 71, 13, 10, 26, 10]))
    parts, at = {}, 8
    while at < len(png):
        n = int.from_bytes(png[at : at + 4], "big")
        kind, body = png[at + 4 : at + 8].decode(), png[at + 8 : at + 8 + n]
        assert int.from_bytes(png[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind.encode() + body)
        parts[kind] = parts.get(kind, b"") + body
        at += 12 + n
    width, height = (int.from_bytes(parts["IHDR"][i : i + 4], "big") for i in (0, 4))
    assert tuple(parts["IHDR"][8:]) == (8, 0, 0, 0, 0) and parts["IEND"] == b""
    raw, out, above = zlib.decompress(parts["IDAT"]), bytearray(), bytes(width)
    for y in range(height):
        kind, line = raw[y * (width + 1)], bytearray(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        assert kind in (0, 1, 2)
        for x in range(width):
            line[x] = (line[x] + (0, line[x - 1] if x else 0, above[x])[kind]) & 255
        out += line
        above = bytes(line)
    return bytes(out)


def test_stored_media_against_an_independent_decoder(spark):
    texts = [None, "", "one", "é" * 99, "many words " * 500]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stored = {r["media"]: r["member"] for r in media.read_archives(spark, media.write_archives(d)).collect()}
    found = {}
    for png, member in stored.items():
        i, n = (int(x) for x in member.removesuffix(".png").split("/")[1:])
        found[i] = decoded(bytes(png))
        assert found[i][:n] == (texts[i] or "").encode() and not any(found[i][n:])
    for r in media.media_columns(d).collect():
        payload = found.get(r["doc_id"], bytes(64))
        mean = sum(payload) / len(payload)
        spread = (sum((x - mean) ** 2 for x in payload) / len(payload)) ** 0.5
        bins = [sum(x // 32 == k for x in payload) for k in range(8)]
        assert r["feature"] == f"rows={len(payload) // 64};mean={mean:.4f};std={spread:.4f};bins=" + ",".join(map(str, bins))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()


def test_plans_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(media, "RANGES", 4)
    d = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(60)], "doc_id bigint, text string").coalesce(1)
    manifest = media.write_archives(d)
    assert len(media.ArchiveReader(manifest, 100, 3).partitions()) <= 5


def test_ranges_give_every_member_once(spark, monkeypatch):
    monkeypatch.setattr(media, "ARCHIVE", 3000)
    d = spark.createDataFrame([(i, f"text {i} " * (i + 1)) for i in range(60)], "doc_id bigint, text string").coalesce(2)
    manifest = media.write_archives(d)
    for step in (500, 100_000):
        assert media.read_archives(spark, manifest, range_bytes=step).select("member", "offset").distinct().count() == 60


def test_a_failing_member_is_tried_again(spark, monkeypatch):
    d = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id bigint, text string").coalesce(1)
    reader = media.ArchiveReader(media.write_archives(d), media.RANGE, 3)
    failed, real = [], media.member_at

    def flaky(file, offset, size, crc):
        if offset not in failed:
            failed.append(offset)
            raise OSError("lost")
        return real(file, offset, size, crc)

    monkeypatch.setattr(media, "member_at", flaky)
    names = [n for p in reader.partitions() for b in reader.read(p) for n in b.column("member").to_pylist()]
    assert len(names) == 2 and len(failed) == 2
    monkeypatch.setattr(media, "member_at", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        list(reader.read(reader.partitions()[0]))
