"""URL filtering with pattern rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that any match must
contain. Host rules (``org/``, ``example.org/es/``) are made into such rules over
host and path; the longest that fits wins, of equally long ones the first by
name. Urls that no host rule fits go to the rules over the whole url. Each rule
is filed under the one of its tokens that is rarest among the tokens of the urls
at hand. A url's own tokens fetch its candidate rules, and only those rules'
expressions run; a rule without any literal token is a candidate of every url.

Rules are given as a sequence, or as a table of bounded size (``rules_from``).

Defined cases: a null url, or one without ``://``, has host and path ``''``, no
host rule and the default verdict unless a rule over the whole url fits.
Repeated rows give repeated results. Only the id and url columns are read, so
other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfathom.llm.common import map_batches

_TOKEN = re.compile(r"[a-z0-9]+")
_FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` runs on the lower-cased url; each of ``tokens`` is a whole
    token ([a-z0-9]+) of every url that it matches."""

    pattern: str
    tokens: tuple[str, ...]
    verdict: str = "block"


@dataclass(frozen=True)
class HostRule:
    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]

    @property
    def pattern(self) -> str:
        """Runs on host + path: the host or a subdomain of it, and the path's beginning."""
        return rf"\A(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    @property
    def tokens(self) -> tuple[str, ...]:
        """Those of the host, and those of the path that the rule itself ends."""
        low = self.path.translate(_FOLD)
        ended = (m[0] for m in _TOKEN.finditer(low) if m.end() < len(low))
        return (*_TOKEN.findall(self.host), *ended)


HOST_RULES = (
    HostRule("org/", "allow"),
    HostRule("example.org/es/", "block"),
    HostRule("example.org/en/1", "block"),
    HostRule("com/fr/", "allow"),
    HostRule("com/de/", "block"),
)

_EDGE = r"(?:^|[^a-z0-9])"
_END = r"(?:[^a-z0-9]|$)"


def _words(*tokens: str, between: str = r"[^a-z0-9]+") -> PatternRule:
    return PatternRule(_EDGE + between.join(tokens) + _END, tokens)


#: Words that tell by themselves: gambling, adult, drugs, piracy, advertisement.
ALONE = (
    "casino", "poker", "roulette", "betting", "sportsbook", "jackpot", "blackjack", "baccarat",
    "porn", "porno", "xxx", "escort", "escorts", "hentai", "milf", "camgirl", "camgirls", "erotic",
    "viagra", "cialis", "levitra", "xanax", "tramadol", "phentermine", "kamagra",
    "warez", "keygen", "nulled", "crackz", "serialz", "camrip",
    "doubleclick", "adserver", "adservice", "popunder", "clickbank", "adclick", "adsense",
)
#: Words that tell together: one of OFFERS, then one of GOODS.
OFFERS = (
    "buy", "cheap", "cheapest", "discount", "order", "online", "free", "best", "win", "instant", "replica", "fake",
    "get", "earn", "guaranteed", "hot",
)
GOODS = (
    "pills", "pill", "meds", "drugs", "pharmacy", "steroids", "watches", "handbags", "essays", "essay", "diploma",
    "degree", "followers", "likes", "backlinks", "loans", "loan", "payday", "bets", "bet", "slots", "spins", "chips",
    "bonus", "iphone", "giftcard", "giftcards", "robux", "bitcoin", "crypto", "dating", "hookup", "hookups", "cams",
    "nudes", "serials", "cracks", "passport", "license", "lottery",
)

PATTERN_RULES = (
    *(_words(w) for w in ALONE),
    *(_words(a, b) for a in OFFERS for b in GOODS),
    _words("wp", "login", "php"),
    _words("free", "download", "crack"),
    _words("utm", "source", "spam"),
    PatternRule(_EDGE + r"track" + r"[/?][^#]*" + _EDGE + r"affiliate" + _END, ("track", "affiliate")),
    PatternRule(_EDGE + r"session" + r"[^a-z0-9]+" + r"id=[0-9a-f]{24,}" + _END, ("session", "id")),
)

#: What a table of rules may hold, as it goes to every worker.
RULE_BYTES = 64 << 20


def rules_from(table: DataFrame) -> tuple[list[HostRule], list[PatternRule]]:
    """Rules of a table: rule, verdict, pattern and tokens (both null for a host rule).

    Raises if the table is larger than ``RULE_BYTES``; that is measured first.
    """
    rows = table.select("rule", "verdict", "pattern", "tokens")
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size > RULE_BYTES:
        raise ValueError(f"rules of {size} bytes; {RULE_BYTES} are the most that workers are given")
    hosts, patterns = [], []
    for r in rows.collect():
        if r["pattern"] is None:
            hosts.append(HostRule(r["rule"], r["verdict"]))
        else:
            patterns.append(PatternRule(r["pattern"], tuple(r["tokens"] or ()), r["verdict"]))
    return hosts, patterns


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_FOLD), slash + path


class RuleIndex:
    """All rules, host rules first, filed under their rarest token ('': without one)."""

    def __init__(self, rules: Sequence[HostRule | PatternRule], seen: dict[str, int]):
        hosts = sorted((r for r in rules if isinstance(r, HostRule)), key=lambda r: (-len(r.rule), r.rule))
        self.rules = [*hosts, *(r for r in rules if isinstance(r, PatternRule))]
        self.filed: dict[str, list[int]] = {}
        self.compiled: dict[int, re.Pattern[str]] = {}
        for i, r in enumerate(self.rules):
            rarest = min(r.tokens, key=lambda t: (seen.get(t, 0), t), default="")
            self.filed.setdefault(rarest, []).append(i)

    def find(self, url: str, host: str, path: str) -> HostRule | PatternRule | None:
        """The first of the rules that fits."""
        low = url.translate(_FOLD)
        tokens = {*_TOKEN.findall(low), ""} & self.filed.keys()
        for i in sorted(i for t in tokens for i in self.filed[t]):
            if i not in self.compiled:
                self.compiled[i] = re.compile(self.rules[i].pattern)
            rule = self.rules[i]
            if self.compiled[i].search(host + path if isinstance(rule, HostRule) else low):
                return rule
        return None


def token_frequency(urls: DataFrame, url_col: str, rules: Sequence[HostRule | PatternRule]) -> dict[str, int]:
    """How many urls hold each token of the rules, over all rows.

    The tokens of the rules are broadcast, and the answer has a row for each at most.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    low = F.translate(F.col(url_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = F.array_distinct(F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1)))
    known = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    found = urls.select(F.explode(tokens).alias("token")).join(F.broadcast(known), "token")
    return {r["token"]: r["count"] for r in found.groupBy("token").count().collect()}


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    host_rules: Sequence[HostRule] = HOST_RULES,
    pattern_rules: Sequence[PatternRule] = PATTERN_RULES,
    default: str = "allow",
) -> DataFrame:
    """id, host, path, rule, verdict and by_pattern for every row."""
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rules = [*host_rules, *pattern_rules]
    seen = token_frequency(urls, "url", rules)
    id_type = urls.schema["page_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, seen)
        for b in batches:
            out: list[tuple] = []
            for url in b.column("url").to_pylist():
                host, path = split_url(url)
                rule = index.find(url or "", host, path)
                named = rule.rule if isinstance(rule, HostRule) else None
                out.append((host, path, named, rule.verdict if rule else default, isinstance(rule, PatternRule)))
            cols = zip(*out) if out else [()] * 5
            types = [pa.string()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), *(pa.array(list(c), t) for c, t in zip(cols, types))],
                names=["page_id", "host", "path", "rule", "verdict", "by_pattern"],
            )

    return map_batches(
        urls, judge, f"page_id {id_type}, host string, path string, rule string, verdict string, by_pattern boolean"
    )
