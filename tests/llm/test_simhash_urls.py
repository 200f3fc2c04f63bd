import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from inkfathom.llm import components, simhash, urlfilter

DOCS = "doc_id bigint, text string, component_id string, fp string"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_wide(text, bits=512, keys=8, sample=4):
    """The wide fingerprint and the keys of a text, as numbers."""
    full, words = (1 << 64) - 1, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0, set()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode(), 42) for i in range(max(1, len(words) - 4))]

    def bits_of(x):
        out = b""
        for k in range(1, bits // 64 + 1):
            y = x + k * 0x9E3779B97F4A7C15 & full
            y = (y ^ y >> 30) * 0xBF58476D1CE4E5B9 & full
            y = (y ^ y >> 27) * 0x94D049BB133111EB & full
            out += (y ^ y >> 31).to_bytes(8, "little")
        return int.from_bytes(out, "big")

    many = [bits_of(x) for x in h]
    own = [sorted({x for x in h if x % keys == k})[:sample] for k in range(keys)]
    made = {xxhash.xxh64_intdigest(b"".join(x.to_bytes(8, "little") for x in xs), k) for k, xs in enumerate(own) if xs}
    return sum(1 << b for b in range(bits) if 2 * sum(x >> b & 1 for x in many) > len(h)), made


def grouped(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def brute_near(texts, radius=86):
    prints = [brute_wide(t) for t in texts]
    return grouped(len(texts), lambda i, j: prints[i][0] == prints[j][0] or (bool(prints[i][1] & prints[j][1]) and (prints[i][0] ^ prints[j][0]).bit_count() <= radius))


def brute_groups(prints, radius=4):
    return grouped(len(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= radius)


def test_fingerprint_matches_spark_hash(spark):
    assert spark.sql("select xxhash64('a b c d')").first()[0] == simhash.fingerprint("A b\tC  d") - 2**64
    for t in (None, "", " \n", "one", "Ünï ÉA b c", "a b c d e f g", "x " * 5000, "a\x0bb\x1cc \x85 d e"):
        assert simhash.fingerprint(t) == brute_print(t)


def test_groups_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * 2 + str(rng.randint(0, 99)) for _ in range(80)) for _ in range(12)]
    texts = [None, "", "  ", "one", "ONE"]
    for b in base:
        texts.append(b)
        for _ in range(4):
            w = b.split()
            w[rng.randrange(80)] = "changed"
            texts.append(" ".join(w))
    texts += [base[0]] * 40
    docs = spark.createDataFrame([(i * 3, t, "x", "y") for i, t in enumerate(texts)], DOCS)
    groups = brute_groups([brute_print(t) for t in texts])
    least = {g: min(i for i, x in enumerate(groups) if x == g) * 3 for g in set(groups)}
    for tree in (2, 2048):  # small trees: hot shards are split
        got = simhash.near_duplicates(docs, tree_size=tree).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == {i * 3: least[g] for i, g in enumerate(groups)}
        assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == {i * 3: brute_print(t) for i, t in enumerate(texts)}
    kept = simhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b c d e", "", ""), (None, "a b c d e", "", ""), (7, "q r s t u", "", ""), (7, "q r s t u", "", ""), (9, "q r s t u", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(7, 7), (7, 7), (9, 7), (None, None), (None, None)]
    assert sorted((r["doc_id"] for r in simhash.keep_one(docs).collect()), key=str) == [7, None]
    none = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_one_row_of_each_group_where_ids_are_shared(spark):
    a, b, c = "a b c d e f g h", "q r s t u v w x", "1 2 3 4 5 6 7 8"
    # 5 is the least id of two groups; 6 that of one and a copy in another
    rows = [(5, a, "", ""), (5, b, "", ""), (5, b, "", ""), (6, a, "", ""), (6, c, "", ""), (7, c, "", ""), (None, b, "", "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(tuple(r)[:2] for r in kept) == sorted([(5, a), (5, b), (6, c)])


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("size, edits", [(120, (1, 2)), (700, (3, 16))])
def test_near_copies_are_found(spark, size, edits):
    """Copies that share 0.8 of their shingles or more are found, others are left alone."""
    rng = random.Random(size)
    base = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(size)) for _ in range(60)]
    copies = [(b, edited(rng, base[b], rng.randint(*edits))) for b in range(60) for _ in range(4)]
    apart = [base[b].split() for b in range(0, 60, 2)]
    apart = [" ".join(w[: size // 2] + [f"x{rng.randint(0, 10**6)}" for _ in range(size // 2)]) for w in apart]  # half a text
    texts = [*base, *(t for _, t in copies), *apart]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    due = [(60 + k, b) for k, (b, t) in enumerate(copies) if alike(base[b], t) >= 0.8]
    assert len(due) > 150
    assert sum(got[i] == b for i, b in due) >= 0.95 * len(due)
    assert all(got[b] == b for b in range(60)) and all(got[i] == i for i in range(len(texts) - len(apart), len(texts)))


def test_near_copies_against_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghij") * 2 + str(rng.randint(0, 99)) for _ in range(60)) for _ in range(8)]
    texts = [None, "", "  ", "one", "ONE", "one two", *base, *(edited(rng, b, k) for b in base for k in (1, 2, 3, 5)), *[base[0]] * 40, "same line\n" * 500]
    docs = spark.createDataFrame([(i * 3, t, "x", "y") for i, t in enumerate(texts)] + [(None, base[1], "", ""), (None, "no id here", "", "")], DOCS)
    groups = brute_near([*texts, base[1], "no id here"])
    least = {g: min((i for i, x in enumerate(groups[: len(texts)]) if x == g), default=None) for g in set(groups)}
    want = sorted(((i * 3 if i < len(texts) else None, None if least[g] is None else 3 * least[g]) for i, g in enumerate(groups)), key=str)
    for tree in (2, 2048):
        got = simhash.near_copies(docs, tree_size=tree).collect()
        assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == want
    kept = sorted((str(r["doc_id"]) for r in simhash.keep_one(docs, edited=True).collect()))
    assert kept == sorted(str(None if i is None else 3 * i) for i in least.values())


def test_bk_tree():
    rng = random.Random(1)
    values = [rng.getrandbits(10) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.insert(v)
    for q in values[:50]:
        assert set(tree.within(q, 2)) == {v for v in values if (v ^ q).bit_count() <= 2}


def test_blocks_cover_every_pair():
    masks = simhash.block_masks(4, 6)
    rng = random.Random(2)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 8), (None, 4), (3, 10), (10, 11), (2, 1), (20, 21)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 8: 8, 9: 8, 20: 20, 21: 20} | {100 + i: 100 for i in range(41)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


URLS = [
    (1, "HTTP://Www.Example.ORG/es/1?x#y", ("www.example.org", "/es/1", "example.org/es/", "block")),
    (2, "http://example.org/en/12", ("example.org", "/en/12", "example.org/en/1", "block")),
    (3, "http://a.org/x", ("a.org", "/x", "org/", "allow")),
    (4, "http://a.org", ("a.org", "", None, "allow")),
    (5, "http://x.com/de/", ("x.com", "/de/", "com/de/", "block")),
    (6, "http://xcom/de/", ("xcom", "/de/", None, "allow")),
    (7, None, ("", "", None, "allow")),
    (8, "no scheme/casino", ("", "", None, "block")),
    (9, "http://x.net/a-CASINO/1", ("x.net", "/a-CASINO/1", None, "block")),
    (10, "http://x.net/casinos", ("x.net", "/casinos", None, "allow")),
    (11, "http://x.net/free/download-crack", ("x.net", "/free/download-crack", None, "block")),
    (12, "http://x.net?q=http://porn", ("x.net", "", None, "block")),
    (12, "http://x.net?q=http://porn", ("x.net", "", None, "block")),
    (13, "http://org/fr/" + "x" * 200_000, ("org", "/fr/" + "x" * 200_000, "org/", "allow")),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "v") for i, u, _ in URLS], "page_id bigint, url string, verdict string")
    got = sorted(((r["page_id"], (r["host"], r["path"], r["rule"], r["verdict"])) for r in urlfilter.filter_urls(pages).collect()))
    assert got == sorted((i, w) for i, _, w in URLS)
    brute = {i: any(re.search(p.pattern, (u or "").lower()) for p in urlfilter.PATTERN_RULES) for i, u, _ in URLS}
    assert all(r["by_pattern"] == (brute[r["page_id"]] and r["rule"] is None) for r in urlfilter.filter_urls(pages).collect())
    assert urlfilter.filter_urls(pages.where("false")).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    rules = [urlfilter.PatternRule("a.*b", ("a", "b"))]
    assert set(urlfilter.RuleIndex(rules, {"a": 5, "b": 1}).filed) == {"b"}
    assert set(urlfilter.RuleIndex(rules, {"a": 1, "b": 5}).filed) == {"a"}
    for r in urlfilter.PATTERN_RULES:
        assert r.tokens
    # a host rule's tokens: those of the host and those that its path ends
    assert urlfilter.HostRule("a-b.org/en/1", "block").tokens == ("a", "b", "org", "en")
    assert set(urlfilter.RuleIndex(urlfilter.HOST_RULES, {"org": 9, "com": 9, "example": 9}).filed) == {"org", "de", "en", "es", "fr"}
    assert urlfilter.RuleIndex([urlfilter.HostRule("ελ/", "block")], {}).filed == {"": [0]}


def brute_verdict(url, hosts, patterns, default):
    """Every rule on every url."""
    host, path = urlfilter.split_url(url)
    fit = [r for r in hosts if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fit:
        best = min(fit, key=lambda r: (-len(r.rule), r.rule))
        return best.rule, best.verdict
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    return None, next((r.verdict for r in patterns if re.search(r.pattern, low)), default)


def test_thousands_of_rules_from_a_table_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["a-b", "ελ", "Xy", "org", "com"]
    made = [(f"{rng.choice(words)}.{rng.choice(words)}/{rng.choice(['', 'En/', 'en/1', 'x/y/'])}".lower().replace("en/", "En/", 1), rng.choice(["allow", "block"]), None, None) for _ in range(2500)]
    made = list({m[0]: m for m in made}.values())
    made += [(None, "block", rf"(?:^|[^a-z0-9])w{i}[^a-z0-9]+w{i + 1}(?:[^a-z0-9]|$)", [f"w{i}", f"w{i + 1}"]) for i in range(39)]
    made += [(None, "block", "zz9", None)]
    hosts, patterns = urlfilter.rules_from(spark.createDataFrame(made, "rule string, verdict string, pattern string, tokens array<string>"))
    assert len(hosts) + len(patterns) == len(made) > 1500
    pick = lambda: rng.choice(words)
    urls = [f"https://{pick()}.{pick()}.{pick()}/{rng.choice(['', 'En/', 'en/12', 'x/y/z'])}{pick()}?{pick()}={pick()}" for _ in range(600)] + ["http://q.zz9x/", None, "none"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages, host_rules=hosts, pattern_rules=patterns).collect()}
    assert got == {i: brute_verdict(u, hosts, patterns, "allow") for i, u in enumerate(urls)}
    assert len({v for v in got.values()}) > 20


def test_a_table_of_rules_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "RULE_BYTES", 10)
    with pytest.raises(ValueError):
        urlfilter.rules_from(spark.createDataFrame([("org/", "allow", None, None)], "rule string, verdict string, pattern string, tokens array<string>"))
