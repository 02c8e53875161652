"""URL filters: pattern rules indexed by their rarest literal token.

A pattern is literal text with two wildcards: a leading `||` anchors the rest at a host or at any of its subdomains, and `*`
stands for any characters. A literal token is a run of a-z and 0-9 in the pattern that the pattern itself delimits on both
sides, so every address that fits holds it as a whole token. Each rule is filed under the token that is rarest among the
addresses to judge; the tokens of an address fetch candidate rules, and only those run their regular expressions. Rules
without such a token are candidates for every address. Of the rules that fit, the one with the longest pattern wins, then
the one listed first.

The index goes to the workers in slices of at most INDEX_BYTES of patterns; a rule list of any length takes more slices, each
one pass over the address column, and the best rule of all slices wins.

Defined results: an address that is null or has no `://` has an empty host and path, and no rule fits it; repeated rows are
judged each; an empty table gives an empty result; a null pattern list means that every address gets the default verdict.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

INDEX_BYTES = 32 << 20
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str
    label: str | None = None


#: The rule list that decides first.
LISTED = [Rule("block", "||net/", "net/"), Rule("allow", "||example.net/en/", "example.net/en/"), Rule("block", "||example.com/de/", "example.com/de/"), Rule("allow", "||org/fr/", "org/fr/")]
#: The method's own rules, for addresses that no listed rule fits: farms, gambling, adult and piracy sites by name.
GENERAL = [Rule("block", p) for p in ("*spam-farm.", "*.casino.", "*-casino.", "*/casino/", "*.poker.", "*/xxx/", "*.xxx/", "*.porn.", "*/porn/", "*/warez/", "*/torrent/", "*.torrent/")]
DEFAULT = "allow"


def parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path) of an address; both empty where it is null or has no `://`."""
    found = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(found(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), found(2)


def compiled(rule: Rule) -> re.Pattern:
    body = rule.pattern.removeprefix("||")
    text = "".join(".*" if c == "*" else re.escape(c) for c in body)
    return re.compile((r"(?:[^/]*\.)?" if rule.pattern.startswith("||") else "") + text, re.DOTALL)


def tokens_of(rule: Rule) -> list[str]:
    """Literal tokens that any fitting address must hold whole; compared in lower case."""
    anchored, body = rule.pattern.startswith("||"), rule.pattern.removeprefix("||")
    out = []
    for m in _TOKEN.finditer(low := body.lower()):
        left = m.start() == 0 and anchored or m.start() > 0 and body[m.start() - 1] != "*"
        right = m.end() < len(low) and body[m.end()] != "*"
        if left and right and (m.start() > 0 or anchored):
            out.append(m[0])
    return out


class RuleIndex:
    """Rules filed under their rarest token."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        self.rules = [(compiled(r), len(r.pattern.removeprefix("||")), r) for r in rules]
        for k, r in enumerate(rules):
            if found := tokens_of(r):
                self.by_token.setdefault(min(found, key=lambda t: (frequency.get(t, 0), t)), []).append(k)
            else:
                self.always.append(k)

    def best(self, host: str, path: str) -> int:
        """Position of the longest fitting rule, -1 for none."""
        if not host:
            return -1
        at, top = host + path, (-1, 0, -1)
        found = {k for t in set(_TOKEN.findall(at.lower())) for k in self.by_token.get(t, ())}
        for k in (*found, *self.always):
            pattern, length, _ = self.rules[k]
            if (length, -k) > (top[0], top[1]) and pattern.match(at):
                top = (length, -k, k)
        return top[2]


def frequencies(urls: DataFrame, column: str, rules: list[Rule] | None) -> dict[str, int]:
    """How many addresses hold each token of the rules, counted over all of them; one row per token of a rule comes back."""
    wanted = sorted({t for r in rules or () for t in tokens_of(r)})
    if not wanted:
        return {}
    spark = urls.sparkSession
    asked = spark.createDataFrame([(t,) for t in wanted], "token string")
    held = urls.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), "[^a-z0-9]+"))).alias("token"))
    # Counted first, so that a token that most addresses hold is one row a task; what comes back has the rule list's size.
    counts = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return {r["token"]: r["n"] for r in counts.join(asked, "token", "left_semi").collect()}


def _slices(rules: list[Rule] | None) -> Iterator[list[Rule]]:
    part, size = [], 0
    for r in rules or ():
        if part and size + len(r.pattern) > INDEX_BYTES:
            yield part
            part, size = [], 0
        part.append(r)
        size += len(r.pattern)
    yield part


def _lookup(index: RuleIndex):
    @F.arrow_udf("struct<verdict:string,label:string,pattern:string,len:int>")
    def fits(host: pa.Array, path: pa.Array) -> pa.Array:
        rows = []
        for a, b in zip(host.to_pylist(), path.to_pylist(), strict=True):
            if (k := index.best(a, b)) >= 0:
                _, n, r = index.rules[k]
                rows.append((r.verdict, r.label, r.pattern, n))
            else:
                rows.append((None, None, None, -1))
        kinds = [pa.string()] * 3 + [pa.int32()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["verdict", "label", "pattern", "len"])

    return fits


def match(urls: DataFrame, column: str, rules: list[Rule] | None, into: str) -> DataFrame:
    """urls plus a struct column (verdict, label, pattern) of the winning rule, null where none fits."""
    counts, out, names = frequencies(urls, column, rules), urls, []
    for part in _slices(rules):
        (name,) = fresh(out, "_fit")
        out, names = out.withColumn(name, _lookup(RuleIndex(part, counts))(*parts(F.col(column)))), [*names, name]
    best = F.col(names[0])
    for n in names[1:]:
        best = F.when(F.col(n)["len"] > best["len"], F.col(n)).otherwise(best)
    return out.withColumn(into, best).drop(*names)


def judge(pages: DataFrame, listed: list[Rule] | None = LISTED, general: list[Rule] | None = GENERAL, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule (a listed rule's label), verdict; then the pattern that decided, if any."""
    (first, second) = fresh(pages, "_listed", "_general")
    df = pages.select("page_id", "url")
    df = match(match(df, "url", listed, first), "url", general, second)

    (host, path), a, b = parts(F.col("url")), F.col(first), F.col(second)
    return df.select("page_id", host.alias("host"), path.alias("path"), a["label"].alias("rule"), F.coalesce(a["verdict"], b["verdict"], F.lit(default)).alias("verdict"), F.coalesce(a["pattern"], b["pattern"]).alias("pattern"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    regex = lambda r: quote("(?s)^" + (r"(?:[^/]*\.)?" if r.pattern.startswith("||") else "") + "".join(".*" if c == "*" else re.escape(c) for c in r.pattern.removeprefix("||")))

    def best(rules: list[Rule], what) -> str:
        ordered = sorted(rules, key=lambda r: -len(r.pattern.removeprefix("||")))
        return "CASE WHEN host = '' THEN NULL " + " ".join(f"WHEN regexp_matches(host || path, {regex(r)}) THEN {quote(what(r))}" for r in ordered) + " END"

    return f"""
WITH r AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r)
SELECT page_id, host, path, {best(LISTED, lambda r: r.label)} AS rule,
  coalesce({best(LISTED, lambda r: r.verdict)}, {best(GENERAL, lambda r: r.verdict)}, '{DEFAULT}') AS verdict,
  coalesce({best(LISTED, lambda r: r.pattern)}, {best(GENERAL, lambda r: r.pattern)}) AS pattern
FROM h"""


ORACLE_SQL = _sql()
