"""Scalar functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What a query's type is told by, in order of precedence.
CLI = (r"--[a-z][\w-]+", r"\s-[a-z]\b", r"\bcli\b", r"\bcommand\b", r"\brun\b.*\bcommand")
CONFIG = (
    r"\w+\s*=\s*\w+", r"\.ya?ml\b", r"\.json\b", r"\.conf\b", r"\bconfig(ure|uration)?\b", r"\bsetting\b", r"\bparameter\b",
    r"\benvironment\s+variable",
)
PHRASES = (
    ("procedural", ("how to", "steps to", "configure")),
    ("troubleshooting", ("error", "failed", "not working")),
    ("reference", ("what is", "definition", "meaning")),
)

#: Intents and their patterns.
INTENTS = {
    "search": (r"\b(search|find|show|list|get|retrieve)\b", r"\b(documentation|docs|sections?|about)\b"),
    "traverse": (r"\b(traverse|explore|follow|navigate|relationships?)\b", r"\b(from|starting|connected to|related to)\b"),
    "troubleshoot": (r"\b(troubleshoot|fix|resolve|solve|error|issue|problem)\b", r"\b(failed|failing|broken|not working)\b"),
    "compare": (r"\b(compare|difference|versus|vs|between)\b", r"\b(similar|different|contrast)\b"),
    "explain": (r"\b(explain|what is|what does|how does|describe|architecture)\b", r"\b(concept|component|system|work|node|backend|frontend)\b"),
}

#: Entities named in a query.
LINKS = (
    ("error_code", r"\b[EW]\d{3,5}\b", False),
    ("command", r"\b(?:fs|snap|nfs|smb)\s+[a-z_-]+\b", True),
    ("component", r"\b(?:cluster|node|client|backend|frontend)\b", True),
)

#: How well labels are ranked; others have 0.5.
LABEL_PRIORITY = {
    "Procedure": 1.0, "Command": 0.9, "Configuration": 0.85, "Error": 0.9, "Concept": 0.7, "Example": 0.6, "Step": 0.8,
    "Parameter": 0.75, "Component": 0.85, "Section": 1.0, "Chunk": 1.0, "Document": 0.5,
}

#: Words that show a question, a sentence, a verb.
QUESTION = "how what why when where which who can does is are do will should could explain describe tell show list compare".split()
FUNCTION = "the a an to of in for on with and or is are be that this it by from as at but if not my your".split()
VERBS = (
    "is are was were be been being have has had do does did work works use uses configure create enable disable set get run start stop"
).split()


def matches(text: Column, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns are found."""
    return reduce(lambda a, b: a + b, (text.rlike(p).cast("int") for p in patterns))


def query_type(text: Column, tool: str | None = None) -> Column:
    """``tool``: the documented product's own command, whose calls are told as such as well."""
    low = F.lower(F.coalesce(text, F.lit("")))
    calls = CLI if tool is None else (rf"\b{tool}\s+\w+", *CLI)
    typed = F.when(matches(low, calls) >= 2, "cli").when(matches(low, CONFIG) > 0, "config")
    for name, words in PHRASES:
        typed = typed.when(reduce(lambda a, b: a | b, (low.contains(w) for w in words)), name)
    return typed.otherwise("conceptual")


def intent(text: Column) -> Column:
    """The intent of most patterns; the first of those, search if none matches."""
    low = F.lower(text)
    scores = {name: matches(low, ps) for name, ps in INTENTS.items()}
    best = F.greatest(*scores.values())
    return reduce(lambda rest, n: F.when(scores[n] == best, n).otherwise(rest), reversed(INTENTS), F.lit(None))


def linked(text: Column, tool: str | None = None) -> dict[str, Column]:
    """First error code, command (of ``tool`` too) and component that a query names, else null."""
    named = lambda name, pattern: pattern.replace("(?:", f"(?:{tool}|", 1) if tool and name == "command" else pattern
    return {
        name: F.nullif(F.regexp_extract(F.lower(text) if low else text, f"({named(name, pattern)})", 1), F.lit(""))
        for name, pattern, low in LINKS
    }


def rewrite_keywords(text: Column) -> Column:
    """A query that is a mere row of keywords, as a question; others as they are."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    among = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    well = (
        F.get(words, F.lit(0)).isin(*QUESTION) | text.contains("?")
        | ((among(FUNCTION) / F.size(words) > 0.15) & (among(VERBS) > 0)) | (F.size(words) <= 4)
    )
    short = (F.length(F.trim(text)) < 10) | (F.size(words) < 3)
    question = F.concat(F.lit("Explain "), text, F.lit(". How does this work and what is the technical architecture?"))
    return F.when(short | well, text).otherwise(question)


def normalise_score(score: Column, kind: str, top: Column | None = None) -> Column:
    """To 0..1 by kind of score; null gives 0."""
    zero, one = F.lit(0.0), F.lit(1.0)
    clamp = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    if kind in ("distance", "l2", "euclidean"):
        out = 1 - clamp(score, 0.0, 2.0) / 2
    elif kind in ("dot", "inner_product", "ip"):
        out = 1 / (1 + F.exp(-score))
    elif kind in ("late-interaction", "colbert"):
        safe = F.greatest(zero, score)
        out = F.tanh(safe / 10) if top is None else F.when(top > 0, F.least(one, safe / top)).otherwise(F.tanh(safe / 10))
    elif kind == "rrf":
        out = clamp(score * 50, 0.0, 1.0)
    else:
        out = (clamp(score, -1.0, 1.0) + 1) / 2
    return F.when(score.isNull(), zero).otherwise(out)


def distance_score(distance: Column) -> Column:
    return F.exp(-0.5 * distance)


def recency_score(stamps: list[Column], now: Column) -> Column:
    """e^(-days / 365) of the first stamp that is not null, by whole days; 0.5 if none is."""
    t = F.coalesce(*stamps)
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(t)) / 86400)
    return F.when(t.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-days / 365.0))))


def label_priority(label: Column) -> Column:
    table = F.create_map(*(x for k, v in LABEL_PRIORITY.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(table[label], F.lit(0.5))


def coverage_score(mentions: Column, connections: Column) -> Column:
    part = lambda n, most: F.when(n > 0, F.least(F.lit(most), F.ln(n + 1) / 10)).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + part(mentions, 0.3) + part(connections, 0.2))


#: Weights of the five signals.
SEMANTIC = {"recall": 0.4, "rerank": 0.4, "graph": 0.2}
EXTRAS = {"recency": 0.15, "priority": 0.15, "coverage": 0.1}


def final_score(recall, rerank, distance, recency, priority, coverage, veto: float = 0.2, fused=None) -> Column:
    """Five signals together; a rerank probability below ``veto`` gives 0. With
    ``fused``, that score leads and the rest only breaks ties."""
    p = F.when(rerank.isNull(), 0.0).otherwise(1 / (1 + F.exp(-rerank)))
    vetoed = rerank.isNotNull() & (p < veto)
    semantic = SEMANTIC["recall"] * recall + SEMANTIC["rerank"] * p + SEMANTIC["graph"] * distance_score(distance)
    extras = EXTRAS["recency"] * recency + EXTRAS["priority"] * priority + EXTRAS["coverage"] * coverage
    total = semantic + extras if fused is None else fused + 1e-6 * (semantic + extras)
    return F.when(vetoed, 0.0).otherwise(total)


def rank_results(scored: DataFrame, group: str, score: str, label: str, id_col: str) -> DataFrame:
    """rank by the score to six places, then label priority, then id."""
    w = Window.partitionBy(group).orderBy(F.desc(F.bround(F.col(score), 6)), F.desc(label_priority(F.col(label))), id_col)
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint"))


def normal_text(text: Column) -> Column:
    """Trimmed, each run of white space one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def document_id(uri: Column) -> Column:
    return F.sha2(F.lower(F.trim(uri)), 256)


def section_id(uri: Column, anchor: Column, checksum: Column) -> Column:
    return F.sha2(F.concat(uri, F.lit("#"), anchor, F.lit("|"), checksum), 256)


def chunk_id(document: Column, sections: Column) -> Column:
    """One section's own id, or a hash over the document's and all sections' ids in order."""
    many = F.sha2(F.concat_ws("|", F.array(document), sections), 256)
    return F.when(F.size(sections) == 1, F.get(sections, F.lit(0))).otherwise(many)


def shingle_hash(text: Column, n: int = 8, most: int = 64) -> Column:
    """Hash of the first word shingles, a text of fewer words being one shingle."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    shingle = lambda w, i: F.array_join(F.slice(w, i, n), " ")
    upto = lambda w: F.least(F.lit(most), F.greatest(F.lit(1), F.size(w) - n + 1))
    joined = lambda w: F.array_join(F.transform(F.sequence(F.lit(1), upto(w)), lambda i: shingle(w, i)), "||")
    # The words are a lambda's argument: named within a lambda, they were cut anew for each shingle.
    return F.sha2(F.get(F.transform(F.array(words), joined), F.lit(0)), 256)


def path_prefix(path: Column, depth: int) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")


def normal_path(path: Column) -> Column:
    """A heading path without HTML tags, parts trimmed and joined by `` > ``."""
    parts = F.split(F.regexp_replace(path, "<[^>]+>", ""), ">")
    return F.array_join(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), " > ")


def filename_title(name: Column) -> Column:
    """A file name's words: fragment, folders and .md off, small words capitalised."""
    base = F.regexp_replace(F.regexp_extract(F.regexp_extract(name, "^([^#]*)", 1), "([^/]*)$", 1), r"(?i)\.md$", "")
    words = F.filter(F.split(F.url_decode(base), "[-_]+"), lambda w: w != "")
    one = lambda w: F.when(w == F.lower(w), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))).otherwise(w)
    return F.array_join(F.transform(words, one), " ")


@F.pandas_udf(StringType())
def slug(text: pd.Series) -> pd.Series:
    """Compatibility-decomposed ASCII letters and digits joined by hyphens; ``section`` if none is left."""
    ascii_ = text.fillna("").map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower())
    return ascii_.str.replace(r"[^a-z0-9]+", "-", regex=True).str.strip("-").replace("", "section")


def truncate_bytes(limit: int):
    """A UDF: the longest prefix of whole characters of at most ``limit`` UTF-8 bytes."""

    @F.pandas_udf(StringType())
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else t.encode()[:limit].decode("utf-8", "ignore"))

    return cut


def code_ratio(text: Column) -> Column:
    """Share of a text that lies in fenced blocks, fences included."""
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)(```.*?```)"), F.lit(1))
    n = F.aggregate(fenced, F.lit(0), lambda s, x: s + F.length(x))
    return F.when(F.length(text) > 0, n / F.length(text)).otherwise(0.0)


def confidence(top: Column, evidence: Column, coverage: Column, coherence: Column) -> Column:
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return 0.3 * unit(top) + 0.2 * unit(evidence) + 0.2 * unit(coverage) + 0.3 * unit(coherence)


def in_rollout(flag: str, user: Column, percent: int) -> Column:
    return F.pmod(F.xxhash64(user, F.lit(flag)), 100) < percent


def cache_key(values: Column, version: str | Column) -> Column:
    """Of the values as JSON in their order and a version, in which an epoch may stand."""
    v = version if isinstance(version, Column) else F.lit(version)
    return F.substring(F.sha2(F.concat(F.to_json(values), F.lit("|"), v), 256), 1, 16)


def boost_terms(found: Column) -> Column:
    """Names as terms to boost by: trimmed lower case, each once, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(F.trim(x))), lambda x: x != "")))


def max_sim(query: Column, doc: Column, normalised: bool = True) -> Column:
    """Late interaction of two lists of vectors: for each query vector its best
    product. ``normalised``: mean of cosines; else the sum over 32."""
    from inkfathom.operators.search import dot

    norm = lambda v: F.sqrt(dot(v, v)) + 1e-9

    def best(q: Column) -> Column:
        return F.array_max(F.transform(doc, lambda d: dot(q, d) / (norm(q) * norm(d)) if normalised else dot(q, d)))

    total = F.aggregate(F.transform(query, best), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(query) if normalised else total / 32


def property_filter(props: Column, blocked: tuple[str, ...], most: int = 500) -> Column:
    """A map without blocked keys, its values cut to ``most`` characters."""
    kept = F.map_filter(props, lambda k, v: ~k.isin(*blocked))
    return F.transform_values(kept, lambda k, v: F.substring(v, 1, most))
