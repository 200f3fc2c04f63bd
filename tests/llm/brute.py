"""Language ID and toxicity by their definitions, in plain Python over all rows."""

from collections import Counter

import numpy as np

from inkfathom.llm import langid, toxicity
from inkfathom.llm.ngrams import _MULTIPLIERS

FULL = 0xFFFFFFFF


def codes(text):
    """Lower-cased letters, each run of others as one 0, between zeros."""
    out = [0]
    for c in (text or "").lower():
        x = ord(c) if c.isalpha() else 0
        if x or out[-1]:
            out.append(x)
    return out if out[-1] == 0 else [*out, 0]


def bucket(gram, bits):
    h = len(gram) * 0x2545F491 & FULL
    for c, m in zip(gram, _MULTIPLIERS.tolist()):
        h = (h ^ c) * m & FULL
        h ^= h >> 15
    return (h * 0x9E3779B1 & FULL) >> (32 - bits)


def grams(text, orders, bits, inner):
    x = codes(text) if text else []
    found = Counter()
    for n in orders:
        for i in range(len(x) - n + 1):
            gram = x[i : i + n]
            if not inner or all(gram[1:-1]):
                found[bucket(gram, bits)] += 1
    return found, x


def spherical_clusters(x, k, steps=12):
    """Centres of unit vectors: the one nearest to all, then each time the farthest from those taken; then means of what is nearest."""
    x = np.asarray(x, float)
    first = max(range(len(x)), key=lambda i: (float(x[i] @ x.sum(0)), -i))
    seeds = [first]
    while len(seeds) < min(k, len(x)):
        seeds.append(min(range(len(x)), key=lambda i: (max(float(x[i] @ x[j]) for j in seeds), i)))
    centres = [x[i] for i in seeds]
    for _ in range(steps):
        own = [[] for _ in centres]
        for v in x:
            cos = [float(v @ c) for c in centres]
            own[cos.index(max(cos))].append(v)
        centres = [np.sum(vs, 0) if vs else c for vs, c in zip(own, centres)]
        centres = [c / max(np.linalg.norm(c), 1e-12) for c in centres]
    return np.array(centres)


def telling(in_p, times_p, in_u, times_u, n_p, n_u, prior):
    """Places of the features that positives have far more often than unlabelled texts, the farthest first; of equal ones the earlier."""
    found = []
    for i in range(len(in_p)):
        likely = (in_u[i] + 1) * n_p / n_u
        excess = (in_p[i] - likely) / np.sqrt(likely + 1)
        if excess >= toxicity.DEVIATIONS and times_p[i] * prior >= toxicity.LIFT * (times_u[i] + 1) * n_p / n_u:
            found.append((-excess, i))
    return sorted(i for _, i in sorted(found)[: toxicity.KEPT])


def non_negative_risk(p, u, prior, steps=400, rate=0.05, decay=0.3):
    """Logistic regression by the non-negative positive-unlabelled risk, by Adam, in double precision.

    risk = prior E_p[loss(+)] + max(0, E_u[loss(-)] - prior E_p[loss(-)]); where the second part is
    negative, its own gradient is climbed instead.
    """
    p, u = (np.hstack([np.asarray(x, float), np.ones((len(x), 1))]) for x in (p, u))
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    shrink = np.full(len(w), decay / len(p))
    shrink[-1] = 0
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigmoid = lambda g: 1 / (1 + np.exp(-g))
    for t in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        clean = np.log1p(np.exp(-np.abs(gu))).mean() + np.maximum(gu, 0).mean() - prior * (np.log1p(np.exp(-np.abs(gp))) + np.maximum(gp, 0)).mean()
        of_clean = u.T @ sigmoid(gu) / len(u) - prior * (p.T @ sigmoid(gp)) / len(p)
        gradient = prior * (p.T @ (sigmoid(gp) - 1)) / len(p) + of_clean if clean >= 0 else -of_clean
        gradient = gradient + shrink * w
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], w[-1]


def languages(rows, learn):
    """rows: (id, text, lang). (lang_pred, score, rejected) of each."""
    def counted(text):
        found, x = grams(text, langid.ORDERS, langid.BITS, False)
        return found, sum(c > 0 for c in x)

    taught = [r for r in rows if learn(r[0]) and r[1] is not None and r[2] is not None]
    df = Counter(b for r in taught for b in counted(r[1])[0])
    idf = np.array([np.log((1 + len(taught)) / (1 + df[b])) + 1 for b in range(1 << langid.BITS)])

    def vector(found):
        v = np.zeros(1 << langid.BITS)
        for b, n in found.items():
            v[b] = np.log1p(n) * idf[b]
        return v / max(np.linalg.norm(v), 1e-300)

    langs = sorted({r[2] for r in taught})
    by_lang = {g: [counted(r[1]) for r in taught if r[2] == g] for g in langs}
    x = {g: np.array([vector(f) for f, size in found if size], np.float32) for g, found in by_lang.items()}
    centres = {g: spherical_clusters(v, langid.CENTROIDS) for g, v in x.items() if len(v)}
    size_of = lambda n: min(n.bit_length(), 16)
    lowest = {}
    for g in langs:
        for v, (_, n) in zip(x[g], (f for f in by_lang[g] if f[1])):
            best = max(float((c @ v).max()) for c in centres.values())
            lowest[size_of(n)] = min(lowest.get(size_of(n), np.inf), best)

    def floor(n):
        above = [v for k, v in lowest.items() if k >= size_of(n)]
        every = {k: min(v for j, v in lowest.items() if j >= k) for k in lowest}
        return langid.REACH * (min(above) if above else max(every.values()))

    out = []
    for _, text, _ in rows:
        found, n = counted(text)
        if not n or not centres:
            out.append(("und", 0.0, True))
            continue
        cos = {g: float((c.astype(float) @ vector(found)).max()) for g, c in centres.items()}
        best = max(cos, key=lambda g: (cos[g], [-ord(ch) for ch in g]))
        soft = sum(np.exp(langid._SCALE * (c - cos[best])) for c in cos.values())
        out.append((best, 1 / soft, cos[best] < floor(n)))
    return out


def toxic(rows, labels, learn):
    """rows: (id, text); labels: (id, toxic). The score of each row."""
    def counted(text):
        found, x = grams(text, toxicity.ORDERS, toxicity.BITS, True)
        return found, sum(a > 0 and b == 0 for a, b in zip(x, x[1:]))

    known = {}
    for i, t in labels:
        if i is not None and t is not None and learn(i):
            known[i] = max(known.get(i, 0), t)
    prior = sum(known.values()) / len(known)
    positive = [counted(t) for i, t in rows if known.get(i) == 1]
    unlabelled = [counted(t) for i, t in rows if learn(i)]
    total = lambda part, clip: Counter(
        {b: n for b, n in sum((Counter({b: min(n, clip) for b, n in f.items()}) for f, _ in part), Counter()).items()}
    )
    in_p, in_u = total(positive, 1), total(unlabelled, 1)
    times_p, times_u = total(positive, toxicity.CLIP), total(unlabelled, toxicity.CLIP)
    buckets = sorted(b for b, n in in_p.items() if n >= toxicity.SUPPORT)
    pick = lambda c: np.array([c[b] for b in buckets])
    kept = np.array(buckets)[telling(pick(in_p), pick(times_p), pick(in_u), pick(times_u), len(positive), len(unlabelled), prior)]
    extent = lambda words: [words / 100, np.log1p(words)]
    matrix = lambda part: np.array([[*(f[b] for b in kept.tolist()), *extent(w)] for f, w in part], np.float32)
    w, b = non_negative_risk(matrix(positive), matrix(unlabelled), prior)
    return [float(1 / (1 + np.exp(-(matrix([counted(t)])[0].astype(float) @ w + b)))) for _, t in rows]
