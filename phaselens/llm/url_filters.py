"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is compiled to a regular expression over host + path.  Of the tokens that any URL it fits must hold as a
whole, the one that the fewest URLs (and then the fewest rules) hold is its key.  A URL's tokens fetch the rules
under them, and only those run; rules without such a token are tried on every URL.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"[a-z0-9]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def folded(text: str) -> str:
    """A-Z as a-z, all else as it is: the index and the expressions must agree on what is a letter."""
    return text.lower() if text.isascii() else text.translate(LOWER)


@dataclass(frozen=True)
class Rule:
    """kind "site": ``text`` is host + path prefix, and fits the host and all its subdomains.

    kind "pattern": ``text`` is looked for in host + path; ``*`` stands for anything, ``|`` at an end for the start or
    the end, ``^`` for one character other than a-z, A-Z, digits, ``_ - . %`` (or the end).  A-Z and a-z of a pattern are
    compared without case; other letters as they are.
    """

    text: str
    verdict: str
    kind: str = "site"

    def regex(self) -> str:
        if self.kind == "site":
            host, slash, path = self.text.partition("/")
            return rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
        body = self.text
        start, end = body.startswith("|"), body.endswith("|")
        body = re.escape(body.removeprefix("|").removesuffix("|")).replace(r"\*", ".*").replace(r"\^", r"(?:[^A-Za-z0-9_.%-]|$)")
        return "(?ai)" + "^" * start + body + "$" * end

    def tokens(self) -> set[str]:
        """Tokens that must stand between other characters in any URL that fits."""
        if self.kind == "site":
            host, slash, path = self.text.partition("/")
            found = TOKEN.findall(folded(host))
            inner = folded(slash + path)
            return set(found) | {m[0] for m in TOKEN.finditer(inner) if m.end() < len(inner)}
        body, start, end = folded(self.text), self.text.startswith("|"), self.text.endswith("|")
        body = body.removeprefix("|").removesuffix("|")
        edge = lambda at, whole: whole if at in (-1, len(body)) else body[at] != "*"
        return {m[0] for m in TOKEN.finditer(body) if edge(m.start() - 1, start) and edge(m.end(), end)}


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return m[1].translate(LOWER), m[2]


class Filter:
    """Rules under their rarest tokens; ``seen`` counts URLs by token."""

    def __init__(self, rules: Iterable[Rule], seen: dict[str, int]):
        rules = list(dict.fromkeys(rules))
        held = Counter(t for r in rules for t in r.tokens())
        self.under: dict[str, list[tuple[Rule, re.Pattern]]] = defaultdict(list)
        self.loose = []
        for r in rules:
            key = min(r.tokens(), key=lambda t: (seen.get(t, 0), held[t], t), default=None)
            (self.loose if key is None else self.under[key]).append((r, re.compile(r.regex(), re.DOTALL)))

    def candidates(self, target: str) -> list[tuple[Rule, re.Pattern]]:
        return [x for t in set(TOKEN.findall(folded(target))) if t in self.under for x in self.under[t]] + self.loose

    def judge(self, host: str, path: str, default: str) -> tuple[str | None, str, str | None]:
        """Rule, verdict and pattern: the longest site rule wins; without one, patterns decide, allowing ones first."""
        fit = [r for r, p in self.candidates(host + path) if p.search(host + path)]
        sites = [r for r in fit if r.kind == "site"]
        if sites:
            best = max(sites, key=lambda r: (len(r.text), r.verdict == "allow", r.text))
            return best.text, best.verdict, None
        patterns = [r for r in fit if r.kind == "pattern"]
        if patterns:
            best = min(patterns, key=lambda r: (r.verdict != "allow", r.text))
            return None, best.verdict, best.text
        return None, default, None


def filter_urls(df: DataFrame, rules: Iterable[Rule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of ``df``: key, host, path, rule (site rule or null), verdict, pattern (pattern rule or null).

    Null URLs and those without ``://`` have an empty host and path; only pattern rules can fit them, and none of the
    usual ones does.  Repeated rows are each judged; further columns are ignored.  Of equally long site rules the
    allowing one wins.  The token counts are over all URLs; what reaches the driver is a count per token of the rules.
    """
    rules = list(rules)
    tokens = sorted({t for r in rules for t in r.tokens()})
    words = F.array_distinct(F.regexp_extract_all(F.translate(F.col(url), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("([a-z0-9]+)"), 1))
    held = df.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, tokens)))).alias("t")) if tokens else None
    seen = {r["t"]: r["count"] for r in held.groupBy("t").count().collect()} if tokens else {}
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict", "pattern"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(rules, seen)
        for b in batches:
            rows = []
            for u in b.column("_url").to_pylist():
                host, path = split(u)
                rows.append((host, path, *own.judge(host, path, default)))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("_key"), *(pa.array(c, pa.string()) for c in columns)], names=schema.names)

    return df.select(F.col(key).alias("_key"), F.col(url).alias("_url")).mapInArrow(run, schema)


#: The rules of the query: by site.
SITE_RULES = [
    Rule("com/", "allow"),
    Rule("example.com/en/", "block"),
    Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"),
    Rule("net/fr/", "block"),
]
#: The method's own: for URLs that no site rule fits.
PATTERN_RULES = [
    Rule("cheap-pills.", "block", "pattern"),
    Rule(".casino.", "block", "pattern"),
    Rule("/casino/", "block", "pattern"),
    Rule("free-download*.exe|", "block", "pattern"),
    Rule("/ads/", "block", "pattern"),
    Rule("/banner^", "block", "pattern"),
    Rule("/login^", "block", "pattern"),
    Rule(".xxx/", "block", "pattern"),
    Rule(".gov/", "allow", "pattern"),
    Rule(".edu/", "allow", "pattern"),
]

SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM p
), u AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), f AS (
  SELECT *, translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
    CASE
    WHEN regexp_matches(folded, '\\.edu/') THEN '.edu/'
    WHEN regexp_matches(folded, '\\.gov/') THEN '.gov/'
    WHEN regexp_matches(folded, '\\.casino\\.') THEN '.casino.'
    WHEN regexp_matches(folded, '\\.xxx/') THEN '.xxx/'
    WHEN regexp_matches(folded, '/ads/') THEN '/ads/'
    WHEN regexp_matches(folded, '/banner([^a-z0-9_.%-]|$)') THEN '/banner^'
    WHEN regexp_matches(folded, '/casino/') THEN '/casino/'
    WHEN regexp_matches(folded, '/login([^a-z0-9_.%-]|$)') THEN '/login^'
    WHEN regexp_matches(folded, 'cheap-pills\\.') THEN 'cheap-pills.'
    WHEN regexp_matches(folded, '(?s)free-download.*\\.exe$') THEN 'free-download*.exe|' END AS pattern0
  FROM f
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN pattern0 IN ('.edu/', '.gov/') OR pattern0 IS NULL THEN 'allow' ELSE 'block' END AS verdict,
  CASE WHEN rule IS NULL THEN pattern0 END AS pattern
FROM r
"""
