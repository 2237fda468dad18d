"""URL filters: host rules first, else pattern rules, indexed by their rarest literal token.

A host rule is ``host/path``: it fits the host and its subdomains where the url's path starts with the rule's, and
the longest that fits decides (of equal length: the longer host's). Where none fits, pattern rules do: a url that one
matches is blocked. A pattern's literal tokens are runs of a-z and 0-9 that every match must hold as a whole
token; it is indexed under the one that is rarest over all urls, and only the patterns that a url's own tokens fetch
run their regular expression. Alternatives are patterns of their own here, each under its own rarest token. A pattern
without such a token is always run.

Rules are configuration. They go to the workers by broadcast in parts of at most ``PART_BYTES``; more rules make more
parts, applied one after the other.

Cases: a null url, or one without ``://``, has an empty host and path and no tokens, and is allowed by default;
empty, very long and repeated urls need nothing special; an empty table gives an empty result; other columns stay unread.
"""

from __future__ import annotations

import re
import string
from collections import defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_BYTES = 32 << 20

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_tokens = re.compile("[a-z0-9]+").findall
_WORD = frozenset(string.ascii_lowercase + string.digits)


def split_url(url: str | None) -> tuple[str, str]:
    """Host in lower case and path; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match("[^/?#]*", rest)[0]
    return host.translate(_LOWER), re.match("[^?#]*", rest[len(host) :])[0]


_ITEM = re.compile(r"\\(?P<escaped>.)|(?P<set>\[\^?(?:\\.|[^\\])(?:\\.|[^\]\\])*\])|(?P<times>[*+?]|\{[0-9,]+\})|(?P<group>[()|])|(?P<plain>.)", re.DOTALL)
MAX_BRANCHES = 256
"""A pattern of more alternatives is left whole, and so run on every url if it has no token outside them."""


def _items(pattern: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, from, to) of the parts that a pattern is written with."""
    return [(m.lastgroup, m.group(m.lastgroup), m.start(), m.end()) for m in _ITEM.finditer(pattern)]


def _closing(items: list, at: int) -> int:
    """Where the group that opens at ``at`` ends."""
    depth = 0
    for k in range(at, len(items)):
        depth += {"(": 1, ")": -1}.get(items[k][1], 0) if items[k][0] == "group" else 0
        if not depth:
            return k
    raise ValueError("a group is not closed")


def branches(pattern: str) -> list[str]:
    """Patterns without alternatives, of which one matches wherever the pattern does; the pattern alone if it has a construct that is not written out here."""
    if re.search(r"\(\?(?!:)|\\[1-9]", pattern):
        return [pattern]
    done, open_ = [], [pattern]
    while open_:
        if len(done) + len(open_) > MAX_BRANCHES:
            return [pattern]
        own = open_.pop()
        items, depth, bars = _items(own), 0, []
        for k, (kind, x, _, _) in enumerate(items):
            if kind == "group":
                depth += {"(": 1, ")": -1, "|": 0}[x]
                bars += [k] if x == "|" and not depth else []
        if bars:
            ends = [0, *(items[k][3] for k in bars)], [*(items[k][2] for k in bars), len(own)]
            open_ += [own[a:b] for a, b in zip(*ends, strict=True)]
            continue
        for k, (kind, x, start, end) in enumerate(items):
            if kind == "group" and x == "(":
                to = _closing(items, k)
                if to + 1 == len(items) or items[to + 1][0] != "times":
                    inner = own[end : items[to][2]].removeprefix("?:")
                    parts = branches(inner)
                    if len(parts) > 1 or "(" not in inner:
                        open_ += [own[:start] + x + own[items[to][3] :] for x in parts]
                        break
        else:
            done.append(own)
    return sorted(done)


def literal_tokens(pattern: str) -> list[str]:
    """Whole tokens that any match of a pattern without alternatives holds: literal runs with a character of no token on either side."""
    items, runs, run, closed, at = _items(pattern), [], "", False, 0
    while at < len(items):
        kind, x, _, _ = items[at]
        if kind == "group" and x == "|":
            return []
        if kind == "times":  # taken with what it follows
            at += 1
            continue
        if kind == "group" and x == "(":
            at = _closing(items, at)  # what it holds may be left out
            kind, x = "any", ""
        more = at + 1 < len(items) and items[at + 1][0] == "times"
        literal = x if kind == "plain" and x not in ".^$" or kind == "escaped" and not x.isalnum() else ""
        outside = [c for c in (x[1:-1].replace("\\", "") if kind == "set" else literal)]
        gap = bool(outside) and not (kind == "set" and (x[1] == "^" or "-" in x[2:-2] or re.search(r"\\[a-zA-Z]", x))) and all(c.lower() not in _WORD for c in outside)
        sure = not more or items[at + 1][1] == "+"
        if literal in _WORD and literal and not more:
            run += literal
        else:
            if run and closed and gap and sure:
                runs.append(run)
            run, closed = "", gap and sure
        at += 1
    return list(dict.fromkeys(runs))


@dataclass
class RuleIndex:
    """Host rules by host and patterns by token, as one part of the rules has them."""

    hosts: dict[str, list[tuple[str, str, str]]] = field(default_factory=lambda: defaultdict(list))
    by_token: dict[str, list[tuple[str, re.Pattern]]] = field(default_factory=lambda: defaultdict(list))
    always: list[tuple[str, re.Pattern]] = field(default_factory=list)

    def host_rule(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest that fits."""
        best, at = None, 0
        while host:
            for own, rule, verdict in self.hosts.get(host[at:], ()):
                if path.startswith(own) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
            if (dot := host.find(".", at)) < 0:
                break
            at = dot + 1
        return best

    def pattern(self, url: str) -> str | None:
        """The name of the first pattern, in order of names, among those fetched that matches."""
        fetched = list(self.always)
        for token in set(_tokens(url)):
            fetched += self.by_token.get(token, ())
        return min((name for name, rx in fetched if rx.search(url)), default=None)


def token_frequencies(pages: DataFrame, tokens: list[str], url: str = "url") -> dict[str, int]:
    """In how many urls each of these tokens is, over all of them."""
    if not tokens:
        return {}
    lower = F.translate(F.col(url), string.ascii_uppercase, string.ascii_lowercase)
    own = F.array_intersect(F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), F.lit(0)), F.array(*map(F.lit, tokens)))
    counted = pages.where(F.col(url).isNotNull()).select(F.explode(own).alias("t")).groupBy("t").count()
    return dict.fromkeys(tokens, 0) | {r["t"]: r["count"] for r in counted.collect()}  # a row for each token of the rules


def indexes(host_rules: list[tuple[str, str]], patterns: dict[str, str], frequency: dict[str, int], part_bytes: int = PART_BYTES) -> list[RuleIndex]:
    """The rules as parts of bounded size."""
    parts, size = [RuleIndex()], 0

    def room(n: int) -> RuleIndex:
        nonlocal size
        size += n + 64
        if size > part_bytes:
            parts.append(RuleIndex())
            size = n + 64
        return parts[-1]

    for rule, verdict in host_rules:
        host, slash, path = rule.partition("/")
        room(2 * len(rule)).hosts[host.translate(_LOWER)].append((slash + path, rule, verdict))
    for name, pattern in sorted((name, own) for name, whole in patterns.items() for own in branches(whole)):
        part, tokens = room(8 * len(pattern)), literal_tokens(pattern)
        kept = part.by_token[min(tokens, key=lambda t: (frequency.get(t, 0), t))] if tokens else part.always
        kept.append((name, re.compile(pattern)))
    return parts


def judge(pages: DataFrame, host_rules: list[tuple[str, str]], patterns: dict[str, str], id_col: str = "page_id", url: str = "url", part_bytes: int = PART_BYTES) -> DataFrame:
    """(page_id, host, path, rule, pattern, verdict) of every row.

    ``host_rules``: (``host/path``, allow or block); ``patterns``: name -> regular expression over the url with A-Z in lower case.
    """
    spark = pages.sparkSession
    frequency = token_frequencies(pages, sorted({t for p in patterns.values() for own in branches(p) for t in literal_tokens(own)}), url)
    found = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("__url"))
    parts = [spark.sparkContext.broadcast(x) for x in indexes(host_rules, patterns, frequency, part_bytes)]

    def judged(part):
        def apply(urls: pd.Series) -> pd.DataFrame:
            index, rows = part.value, []
            for u in urls:
                host, path = split_url(u)
                rule = index.host_rule(host, path)
                rows.append((host, path, *(rule or (None, None)), index.pattern(u.translate(_LOWER)) if u is not None else None))
            return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict", "pattern"], dtype=object)

        return F.pandas_udf(apply, "host string, path string, rule string, verdict string, pattern string")("__url")

    for k, part in enumerate(parts):
        found = found.withColumn(f"__{k}", judged(part))
    own = [F.col(f"__{k}") for k in range(len(parts))]
    host_length = lambda c: F.length(F.substring_index(c["rule"], "/", 1))
    ranked = [F.struct(F.coalesce(F.length(c["rule"]), F.lit(-1)).alias("n"), host_length(c).alias("h"), c["rule"].alias("rule"), c["verdict"].alias("verdict")) for c in own]
    best = F.greatest(*ranked) if len(ranked) > 1 else ranked[0]
    pattern = F.least(*[c["pattern"] for c in own]) if len(own) > 1 else own[0]["pattern"]
    found = found.select("page_id", own[0]["host"].alias("host"), own[0]["path"].alias("path"), best.alias("__best"), pattern.alias("pattern"))
    verdict = F.coalesce(F.col("__best.verdict"), F.when(F.col("pattern").isNotNull(), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("__best.rule").alias("rule"), "pattern", verdict.alias("verdict"))
