"""URL filters: host rules, and pattern rules indexed by their rarest literal token.

A host rule names a host (itself and all subdomains) and a path prefix; the longest fitting rule
decides. Where none fits, pattern rules decide: a pattern is compiled once, the literal tokens that its
matches must hold are read off it, and it is filed under the one that is rarest among all rules. A URL's own tokens fetch the
candidate patterns, and only those run as regular expressions.
"""

import re
from re import _parser as parser
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")
#: Rules that one pass over the URLs holds; longer lists are judged in several passes, whose verdicts are merged.
RULES_AT_ONCE = 100_000


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _edge(op, arg) -> bool:
    """Whether a parsed item can only match a place, or a character, that ends a token."""
    if op is parser.LITERAL:
        return not _TOKEN.fullmatch(chr(arg).lower())
    if op is parser.IN:
        return all(o is parser.LITERAL and _edge(o, a) for o, a in arg)
    if op is parser.AT:
        return arg in (parser.AT_BEGINNING, parser.AT_BEGINNING_STRING, parser.AT_END, parser.AT_END_STRING)
    if op is parser.BRANCH:
        return all(len(b) == 1 and _edge(*b[0]) for b in arg[1])
    return op is parser.SUBPATTERN and len(arg[3]) == 1 and _edge(*arg[3][0])


def required_tokens(pattern: str) -> tuple[str, ...]:
    """Whole tokens that every match of ``pattern`` lies over: literal letters and digits between places where a token must end.

    Only the outermost sequence is read; what it cannot be sure of gives no token.
    """
    parsed, found, run, sure = parser.parse(pattern), [], "", False
    for op, arg in [*parsed, (None, None)]:
        if op is parser.LITERAL and _TOKEN.fullmatch(chr(arg).lower()):
            run += chr(arg).lower()
            continue
        edge = op is not None and _edge(op, arg)
        if run and sure and edge:
            found.append(run)
        run, sure = "", edge
    return tuple(dict.fromkeys(found))


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` is searched in ``host + path``, lower-cased (A-Z)."""

    pattern: str
    verdict: str


#: The rules of the registered query.
HOST_RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)
PATTERN_RULES = (
    PatternRule(r"(^|[.-])spam-farm\.", "block"),
    PatternRule(r"(^|[.-])cheap-pills\.", "block"),
    PatternRule(r"(^|[./-])casino([./-]|$)", "block"),
    PatternRule(r"(^|[./-])(free|online)-casino([./-]|$)", "block"),
    PatternRule(r"(^|[./-])adult([./-]|$)", "block"),
    PatternRule(r"(^|[./-])click-bait([./-]|$)", "block"),
)
#: The verdict where neither a host rule nor a pattern fits.
DEFAULT = "allow"


class PatternIndex:
    """Pattern rules by their rarest token; ties go to the longer, then the smaller token. A pattern without a sure token runs on every URL."""

    def __init__(self, rules):
        tokens = [required_tokens(r.pattern) for r in rules]
        count = Counter(t for own in tokens for t in own)
        self.by_token = defaultdict(list)
        self.always = []
        for order, (rule, own) in enumerate(zip(rules, tokens)):
            entry = (order, re.compile(rule.pattern), rule.verdict)
            if own:
                self.by_token[min(own, key=lambda t: (count[t], -len(t), t))].append(entry)
            else:
                self.always.append(entry)

    def first(self, target: str) -> tuple[int, str] | None:
        """Number and verdict of the first rule in rule order that matches, else None."""
        found = list(self.always)
        for token in set(_TOKEN.findall(target)):
            found += self.by_token.get(token, ())
        for order, pattern, verdict in sorted(found, key=lambda e: e[0]):
            if pattern.search(target):
                return order, verdict
        return None

    def verdict(self, target: str) -> str | None:
        hit = self.first(target)
        return hit[1] if hit else None


class HostIndex:
    """Host rules in a dictionary by host; a lookup walks the host's suffixes."""

    def __init__(self, rules):
        self.by_host = defaultdict(list)
        for rule in rules:
            self.by_host[rule.host].append(rule)

    def match(self, host: str, path: str) -> HostRule | None:
        """The longest rule that fits ``host`` or a parent of it and whose path starts ``path``."""
        best, rest = None, host
        while True:
            for rule in self.by_host.get(rest, ()):
                if path.startswith(rule.path) and (best is None or (len(rule.text), rule.text) > (len(best.text), best.text)):
                    best = rule
            at = rest.find(".")
            if at < 0:
                return best
            rest = rest[at + 1 :]


def filter_urls(df: DataFrame, url: str = "url", keep: list[str] | None = None, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, default: str = DEFAULT) -> DataFrame:
    """``keep`` columns (default: all but clashing ones) with ``host``, ``path``, ``rule`` and ``verdict``.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there
    up to ``?``, ``#`` or the end. A null URL, or one without ``://``, has both empty and gets the
    default verdict. Input columns named like an output column are dropped unless renamed by the caller.
    Repeated rows are judged alike; an empty table gives an empty result.
    """
    new = ("host", "path", "rule", "verdict")
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    cut = F.regexp_extract(df[url], r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    tail = F.regexp_extract(df[url], r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    lowered = F.translate(F.coalesce(cut, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    out = df.select(*[df[c] for c in keep], lowered.alias("host"), F.coalesce(tail, F.lit("")).alias("path"))
    passes = [_judge(part, (), 0)("host", "path") for part in _parts(host_rules)] + [_judge((), part, at)("host", "path") for at, part in zip(range(0, len(pattern_rules), RULES_AT_ONCE), _parts(pattern_rules))]
    if len(host_rules) + len(pattern_rules) <= RULES_AT_ONCE:
        passes = [_judge(tuple(host_rules), tuple(pattern_rules), 0)("host", "path")]
    out = out.withColumn("__judged", F.array(*passes))
    host = F.array_max(F.filter(F.transform("__judged", lambda j: j["host"]), lambda h: h.isNotNull()))
    pattern = F.array_min(F.filter(F.transform("__judged", lambda j: j["pattern"]), lambda p: p.isNotNull()))
    out = out.select(*keep, "host", "path", host.alias("__host"), pattern.alias("__pattern"))
    return out.select(*keep, "host", "path", F.col("__host.rule").alias("rule"), F.coalesce("__host.verdict", "__pattern.verdict", F.lit(default)).alias("verdict"))


def _parts(rules) -> list[tuple]:
    return [tuple(rules[at : at + RULES_AT_ONCE]) for at in range(0, len(rules), RULES_AT_ONCE)]


def _judge(host_rules, pattern_rules, first: int):
    """A function of host and path: the longest of the host rules that fits, and the first of the pattern rules, numbered from ``first``.

    The indexes are built once in a task.
    """

    @F.pandas_udf("host struct<length:int,rule:string,verdict:string>, pattern struct<order:int,verdict:string>")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        by_host, by_token = HostIndex(host_rules), PatternIndex(pattern_rules)
        for hosts, paths in batches:
            found = {"host": [], "pattern": []}
            for host, path in zip(hosts, paths):
                hit = by_host.match(host, path)
                found["host"].append((len(hit.text), hit.text, hit.verdict) if hit else None)
                seen = None if hit else by_token.first(host + re.sub("[A-Z]+", lambda m: m[0].lower(), path))
                found["pattern"].append((first + seen[0], seen[1]) if seen else None)
            yield pd.DataFrame(
                {
                    "host": pd.Series([None if h is None else dict(zip(("length", "rule", "verdict"), h)) for h in found["host"]], dtype=object),
                    "pattern": pd.Series([None if p is None else dict(zip(("order", "verdict"), p)) for p in found["pattern"]], dtype=object),
                }
            )

    return judge


#: The registered query in DuckDB SQL.
SQL = """
WITH cut AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
judged AS (
  SELECT page_id, host, path,
    (SELECT arg_max(rhost || rpath, length(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
    (SELECT arg_max(rverdict, length(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS by_rule,
    host || translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target
  FROM cut)
SELECT page_id, host, path, rule,
  CASE WHEN by_rule IS NOT NULL THEN by_rule
       WHEN regexp_matches(target, '(^|[.-])spam-farm\\.') OR regexp_matches(target, '(^|[.-])cheap-pills\\.')
         OR regexp_matches(target, '(^|[./-])casino([./-]|$)') OR regexp_matches(target, '(^|[./-])(free|online)-casino([./-]|$)')
         OR regexp_matches(target, '(^|[./-])adult([./-]|$)') OR regexp_matches(target, '(^|[./-])click-bait([./-]|$)') THEN 'block'
       ELSE 'allow' END AS verdict
FROM judged
"""
