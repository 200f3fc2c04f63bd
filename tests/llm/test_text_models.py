import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfathom.llm import langid, lm, ngrams, toxicity
from inkfathom.llm.common import fold

WORDS = {"aa": "the of and to in that".split(), "bb": "der die und das ist von".split(), "cc": "ελα και στο να".split()}
ODD = [None, "", " \n\t", "12 !?", "x" * 300_000, "É" * 10]


def corpus(n=120, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 60))), lang, "s", 0))
    rows += [(1000 + i, t, None, None, None) for i, t in enumerate(ODD)] + [rows[0], rows[0], (None, None, None, None, None)]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, score string, n_tokens int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def test_language_id(docs):
    got = langid.identify(docs, ~langid.held_out()).join(docs.select("doc_id", "lang"), "doc_id").collect()
    known = [r for r in got if r["lang"]]
    assert all(r["lang_pred"] == r["lang"] and not r["rejected"] for r in known)
    odd = {r["doc_id"]: r for r in got if r["doc_id"] >= 1000}
    for i, t in enumerate(ODD):
        letterless = not any(c.isalpha() for c in t or "")
        assert (odd[1000 + i]["lang_pred"] == "und") == letterless
        assert 0 <= odd[1000 + i]["score"] <= 1


def test_language_id_against_brute_force(docs):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.where("length(text) < 1000 or text is null").collect()]
    learn = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 != 2
    want = brute.languages(rows, learn)
    some = docs.where("length(text) < 1000 or text is null")
    got = {(r["doc_id"], r["text"]): r for r in langid.identify(some, ~langid.held_out()).collect()}
    for (i, t, _), (lang, score, rejected) in zip(rows, want):
        r = got[i, t]
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4 and r["rejected"] == rejected


def test_of_equal_cosines_the_first_language_wins():
    model = langid.Model(["aa", "bb"], np.array([0, 1]), np.ones((1 << langid.BITS, 2)), np.ones(1 << langid.BITS), np.zeros(17))
    assert model.predict("x")[:2] == ("aa", 0.5)


def test_pieces_do_not_change_the_features(monkeypatch):
    text = "one Two ΑΣ 3 four " * 40 + "x" * 300
    whole = (langid.counts(text), toxicity.features(text))
    for piece in (1, 7, 64):
        monkeypatch.setattr(ngrams, "PIECE", piece)
        for a, b in zip(whole, (langid.counts(text), toxicity.features(text))):
            assert all(np.array_equal(x, y) for x, y in zip(a, b))


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    d = spark.createDataFrame([(i, "abc", f"l{i}", None, None) for i in range(5)], SCHEMA)
    with pytest.raises(ValueError):
        langid.identify(d, F.lit(True))


def test_foreign_text_is_rejected(spark, docs):
    model = langid.train(docs.where("lang is not null"), "doc_id")
    assert model.predict("съешь ещё этих мягких французских булок да выпей чаю")[3]
    assert not model.predict("the of and the that to in")[3]
    assert model.centroids.shape[1] > len(model.langs)  # several centroids a language


def test_language_id_without_training(spark):
    none = spark.createDataFrame([(1, "abc", None, None, None)], SCHEMA)
    assert langid.identify(none, F.lit(True)).first()["lang_pred"] == "und"
    assert langid.identify(none.where("false"), F.lit(True)).count() == 0


def test_kmeans_and_counts():
    x = np.array([[1, 0], [0.9, 0.1], [0, 1], [0.1, 0.9]], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = langid.kmeans(x, 2)
    assert len({int((row @ c.T).argmax()) for row in x}) == 2
    whole, size = langid.counts("ab cd " * 100_000)
    assert size == 400_000 and whole.sum() > size


def toxic_rows(seed=0):
    rng = random.Random(seed)
    usual = [f"w{rng.randrange(10**6)}x" for _ in range(400)]
    docs, labels = [], []
    for i in range(600):
        bad = i % 8 == 0
        words = [rng.choice(usual) for _ in range(rng.randint(8, 80))]
        if bad:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(["dimwitted", "scoundrel", "nitwit"])
        docs.append((i, " ".join(words), bad))
        if i % 2 == 0:
            labels.append((i, int(bad), "x"))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_rows()
    d = spark.createDataFrame([*((i, t, "a") for i, t, _ in docs), (9000, None, "a"), (9001, "", "a"), (None, "x", "a"), (9002, "y" * 300_000, "a")], "doc_id bigint, text string, predicted string")
    t = spark.createDataFrame([*labels, (None, 1, "x"), (2, None, "x")], "doc_id bigint, toxic int, score string")
    got = {r["doc_id"]: r for r in toxicity.classify(d, t, fold("doc_id", 3) != 1).collect()}
    held = [(got[i]["predicted"], bad) for i, _, bad in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == b for p, b in held) >= 0.97 * len(held)
    assert not any(p for p, b in held if not b)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    assert got[9000]["score"] == got[9001]["score"] and not got[9000]["predicted"]
    none = toxicity.classify(d, t.where("toxic = 0"), F.lit(True))
    assert none.agg(F.max("predicted")).first()[0] == 0
    assert toxicity.classify(d.where("false"), t, F.lit(True)).count() == 0


def test_toxicity_against_brute_force(spark):
    docs, labels = toxic_rows()
    rows = [*((i, t) for i, t, _ in docs), (9000, None), (9001, ""), docs[0][:2], docs[0][:2]]  # a row three times
    said = [*((i, t) for i, t, _ in labels), (docs[8][0], 0), (None, 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    t = spark.createDataFrame(said, "doc_id bigint, toxic int")
    got = {}
    for r in toxicity.classify(d, t, fold("doc_id", 3) != 1).collect():
        got.setdefault((r["doc_id"], r["text"]), set()).add(r["score"])
    learn = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    for row, score in zip(rows, brute.toxic(rows, said, learn)):
        assert len(got[row]) == 1 and abs(next(iter(got[row])) - score) < 2e-2
        assert (next(iter(got[row])) >= 0.7) == (score >= 0.7)


def test_nnpu_keeps_its_risk_from_falling_below_zero():
    p = np.array([[1, 0]] * 20, np.float32)
    u = np.array([[1, 0]] * 10 + [[0, 1]] * 90, np.float32)
    w, b = toxicity.nnpu(p, u, 0.1)
    assert w[0] + b > 0 > w[1] + b


def brute_base(rows):
    learn = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1]
    c = Counter(w for r in learn for w in [*(r[1] or "").encode().lower().split(), b""])
    n, v = sum(c.values()), len(c)
    return c, n, lambda t: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*(t or "").encode().lower().split(), b""])


def test_language_model(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 12)  # most words take the join
    rows = corpus()
    c, n, base = brute_base(rows)
    got = lm.score_texts(docs, fold("doc_id", 5) != 1, keep=["lang"]).collect()
    assert len(got) == len(rows) and all(r["train_tokens"] == n for r in got)
    by_id = {r["doc_id"]: r for r in got}
    for i, t, *_ in rows:
        words = [*(t or "").encode().lower().split(), b""]
        assert by_id[i]["n_tokens"] == len(words) and by_id[i]["n_known"] == sum(c[w] > 0 for w in words)
        assert abs(by_id[i]["base_score"] - base(t)) < 1e-6
    held = [r for r in got if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def lexicon_of(texts, hot=10**6):
    """As the operator's lexicon, counted in plain Python."""
    counts = Counter(w for t in texts for w in lm.tokens(t))
    words = [b"", *sorted((w for w in counts if w), key=lambda w: (-counts[w], w))[:hot]]
    mass = np.full(lm.CLASSES, lm.UNSEEN)
    for w, c in counts.items():
        if w not in words[: lm.WORDS]:
            mass[lm.word_class(w)] += c + 0.5
    return lm.Lexicon(words, np.array([counts[w] for w in words]), sum(counts.values()), len(counts), mass), counts


def trained(lex, texts):
    t = lex.read(texts)
    model = lm.LogBilinear(lex.unigram())
    model.train(t.one, t.two, t.out, 0.1, np.random.default_rng(0), {})
    within, place = lm.within_start(lex), lex.places(t)
    for k in range(lm.CLASSES):
        a, z = lex.first[k], lex.first[k + 1]
        counts = np.zeros((lex.outputs + 1, z - a))
        own = (place >= a) & (place < z)
        np.add.at(counts, (t.one[own], place[own] - a), 1)
        if own.any():
            U, Q, b, Z = lm.fit_class(counts, lex.place_mass[a:z] / lex.place_mass[a:z].sum())
            within.U[k], within.Q[a:z], within.b[a:z], within.Z[k] = U, Q, b, Z
    return model, within


def brute_score(lex, counts, model, within, text):
    """The text's score by the definition, one token after the other."""
    p, total = model.p, 0.0
    before = [lex.outputs, lex.outputs]
    for w in lm.tokens(text):
        top = lex.words.index(w) if w in lex.words[: lm.WORDS] else None
        k = lm.word_class(w)
        out = top if top is not None else lex.inside + k
        s = (p["R"][before[-1]] @ p["C1"] + p["R"][before[-2]] @ p["C2"]) @ p["Q"].T + p["b"]
        total += s[out] - np.log(np.exp(s).sum())
        if top is None:
            a, z = lex.first[k], lex.first[k + 1]
            s = within.Q[a:z] @ within.U[k, before[-1]] + within.b[a:z]
            hot = w in lex.words and counts[w] >= lm.LEAST
            at = lex.place[lex.words.index(w)] - a if hot else z - a - 1
            total += s[at] - np.log(np.exp(s).sum())
            if not hot:
                total += np.log((counts[w] + 0.5 if counts[w] else lm.UNSEEN) / lex.place_mass[z - 1])
        before.append(out)
    return total / np.log(10)


FEW = ["a b c", "d a a", None]
#: More words than the first level has, some of them often enough for a vector.
MANY = [" ".join(f"w{(7 * i * j + j * j) % (40 + 13 * i)}" for j in range(300)) for i in range(1, 30)]


@pytest.mark.parametrize("texts", [FEW, MANY])
def test_probabilities_of_all_words_sum_to_one(texts, monkeypatch):
    monkeypatch.setattr(lm, "LEAST", 5)
    lex, counts = lexicon_of(texts)
    model, within = trained(lex, texts)
    table = model.table()
    assert table.shape == ((lex.outputs + 1) ** 2, lex.outputs) and lex.inside == min(lm.WORDS, len(counts))
    for lead in ("", "a b ", "w3 w9 ", "never w1 "):
        n = len(lm.tokens(lead)) - 1
        total = 0.0
        for w in [*counts, *range(lm.CLASSES)]:  # every word seen, and the unseen ones of each class
            if isinstance(w, int):
                place = lex.first[w + 1] - 1
                t = lex.read([lead + "x"])
                s = table[t.one[n] * (lex.outputs + 1) + t.two[n], lex.inside + w]
                total += 10 ** (s + float(within.score(np.array([w]), np.array([place]), t.one[n : n + 1])[0])) * lm.UNSEEN / lex.place_mass[place]
            else:
                t = lex.read([lead + w.decode()])
                total += 10 ** lm.token_scores(lex, table, within, t)[n]
        assert abs(total - 1) < 1e-3


def test_scores_against_brute_force(monkeypatch):
    monkeypatch.setattr(lm, "LEAST", 5)
    lex, counts = lexicon_of(MANY, hot=300)
    model, within = trained(lex, MANY)
    table = model.table()
    assert len(lex.place_mass) > lm.CLASSES + 50
    for text in [MANY[3], "w1 w2 never seen w3", None, "w5 " * 40]:
        t = lex.read([text])
        got = lm.token_scores(lex, table, within, t).sum()
        got += sum(np.log10(counts[w] + 0.5 if counts[w] else lm.UNSEEN) for w, c in zip(t.words, t.codes) if c < 0)
        assert abs(got - brute_score(lex, counts, model, within, text)) < 1e-3


def test_operator_score_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 320)
    monkeypatch.setattr(lm, "LEAST", 5)
    made = []
    real = lm.go_on
    monkeypatch.setattr(lm, "go_on", lambda *a: made.append((a[0], *real(*a))) or made[-1][1:])
    long = "q" * 300
    texts = [*MANY, f"{long} w1 {long}", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(d, F.col("doc_id") % 3 > 0).collect()}
    (lex, model, within), counts = made[0], Counter(w for i, t in enumerate(texts) if i % 3 for w in lm.tokens(t))
    for i, t in enumerate(texts):
        assert abs(got[i] - brute_score(lex, counts, model, within, t)) < 1e-2


def test_language_model_learns_order():
    rng = random.Random(0)
    texts = []
    for _ in range(400):  # each word is followed by the next one
        at = rng.randrange(8)
        texts.append(" ".join(f"w{(at + k) % 8}" for k in range(12)))
    lex, _ = lexicon_of(texts)
    t = lex.read(texts)
    model = lm.LogBilinear(lex.unigram())
    before = model.table()[t.one * (lex.outputs + 1) + t.two, t.out].mean()
    state, r = {}, np.random.default_rng(0)
    for _ in range(60):
        model.train(t.one, t.two, t.out, 0.1, r, state)
    assert model.table()[t.one * (lex.outputs + 1) + t.two, t.out].mean() > before + 0.4


def test_a_class_learns_what_follows():
    # after output 0 comes place 0, after output 1 place 1
    counts = np.array([[90, 5, 5], [5, 90, 5], [30, 30, 40]])
    U, Q, b, Z = lm.fit_class(counts, counts.sum(0) / counts.sum(), steps=300)
    p = np.exp(U @ Q.T + b - Z[:, None])
    assert np.allclose(p.sum(1), 1, atol=1e-5) and p[0, 0] > 0.7 and p[1, 1] > 0.7


def test_long_words_stand_as_digests():
    a, b = lm.tokens("x" * 65)[0], lm.tokens("y" + "x" * 64)[0]
    assert a != b and len(a) == len(b) == lm.LONG + 1 and a[-3:] == b"xxx" and lm.tokens("x" * 64)[0] == b"x" * 64


def test_language_model_without_training_rows(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in lm.score_texts(d, F.lit(False)).collect()}
    assert abs(got[1]["base_score"]) < 1e-12 and got[1]["train_tokens"] == 0 and got[2]["n_known"] == 0
    assert lm.score_texts(d.where("false"), F.lit(True)).count() == 0


def test_hundreds_of_languages(spark):
    """Each has letters of its own; all are clustered in tasks and told apart."""
    rows = [(k * 10 + i, f"{chr(0x4E00 + 3 * k)}{chr(0x4E01 + 3 * k)} {chr(0x4E02 + 3 * k)}{chr(0x4E00 + 3 * k)}" * (i + 1), f"l{k:03d}") for k in range(300) for i in range(4)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = langid.identify(d, F.lit(True), keep=["lang"]).collect()
    assert len(found) == 1200 and all(r["lang_pred"] == r["lang"] and not r["rejected"] for r in found)


def test_ties_at_the_cut_of_features(monkeypatch):
    """Of features that deviate alike the earlier buckets are kept, as by definition."""
    monkeypatch.setattr(toxicity, "KEPT", 5)
    rng = np.random.default_rng(4)
    p = rng.choice([20, 40, 60], 60)
    u = rng.choice([0, 1], 60)
    got = toxicity.choose(p, p, u, u, 100, 1000, 0.1).tolist()
    assert got == brute.telling(p, p, u, u, 100, 1000, 0.1) and len(got) == 5
