"""Secret scans over a trigram inverted index.

For each rule a Boolean trigram query is derived from its regular expression: an AND over the parts that must occur in a row,
an OR over alternatives, and trigrams of literal runs at the leaves (in lower case, A-Z only). Each Arrow batch of texts is
indexed by the trigrams that any query names: one vectorised look at every three bytes of the batch gives the postings, the
queries intersect and unite them, and only the candidate texts are verified by the regular expression. Rules without
mandatory trigrams scan all texts. Texts are indexed and verified whole.

Defined results: null text counts as empty and holds nothing; empty tables give empty results; repeated rows are scanned
each; overlapping spans of different kinds are all kept; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import trimmed

try:  # the parser behind `re`, public under another name in each version
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # pragma: no cover
    import sre_constants as sre
    import sre_parse

#: Bytes of text that are indexed at once; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    #: group whose length must reach least, else the match is dropped
    group: int = 0
    least: int = 0
    base: bool = False
    query: object = field(default=None, compare=False)


#: The base rules, in the order of their listing.
BASE = [
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 8, True),
    SecretRule("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 16, True),
    SecretRule("hex", r"[0-9a-f]+", re.ASCII, 0, 32, True),
]
#: The method's own rules: public formats of credentials.
MORE = [
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    SecretRule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    SecretRule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    SecretRule("url_login", r"[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@"),
]

# A query is ("and"|"or", parts), a set of trigrams that must all occur, or None: anything may fit.


def _and(parts: list) -> object:
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _or(parts: list) -> object:
    return None if not parts or any(p is None for p in parts) else ("or", parts)


def _runs(tree) -> list[list]:
    """The regex as a sequence of literal characters, alternatives and gaps: [kind, value] entries."""
    out: list[list] = []
    for op, arg in tree:
        if op is sre.LITERAL:
            out.append(["lit", chr(arg)])
        elif op is sre.SUBPATTERN:
            out.extend(_runs(arg[3]))
        elif op is sre.BRANCH:
            out.append(["alt", [_query(_runs(b)) for b in arg[1]]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            inner = _runs(arg[2])
            out.extend(inner * min(arg[0], 3))
            if arg[1] != arg[0] or arg[0] > 3:
                out.append(["gap", None])
        elif op is sre.AT:
            continue
        else:
            out.append(["gap", None])
    return out


def _query(runs: list[list]) -> object:
    parts, text = [], ""
    for kind, value in [*runs, ["gap", None]]:
        if kind == "lit":
            text += value
            continue
        raw = text.encode().lower()
        if grams := frozenset(raw[i : i + 3] for i in range(len(raw) - 2)):
            parts.append(grams)
        text = ""
        if kind == "alt":
            parts.append(_or(value))
    return _and(parts)


def trigram_query(pattern: str, flags: int = re.ASCII) -> object:
    return _query(_runs(sre_parse.parse(pattern, flags & ~re.IGNORECASE)))


def _grams(q) -> set[bytes]:
    return set() if q is None else set(q) if isinstance(q, frozenset) else set().union(*map(_grams, q[1]))


class Scanner:
    """Rules with their queries, and the table that tells query trigrams from all others."""

    def __init__(self, rules: list[SecretRule]):
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for r in rules]
        self.grams = sorted(set().union(*(_grams(q) for *_, q in self.rules)))
        self.where = {g: k + 1 for k, g in enumerate(self.grams)}
        self.table: np.ndarray | None = None

    def postings(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each query trigram, the sorted positions of the texts that hold it."""
        if self.table is None:
            self.table = np.zeros(1 << 24, np.uint16)
            for g, k in self.where.items():
                self.table[g[0] << 16 | g[1] << 8 | g[2]] = k
        ends = np.cumsum([len(t) + 3 for t in texts])
        raw = np.frombuffer(b"\0\0\0".join([*texts, b""]).lower(), np.uint8)
        if len(raw) < 3:
            return [np.empty(0, np.int64) for _ in self.grams]
        code = raw[:-2].astype(np.uint32)
        code <<= 8
        code |= raw[1:-1]
        code <<= 8
        code |= raw[2:]
        hit = self.table[code]
        at = np.flatnonzero(hit)
        doc = np.searchsorted(ends, at, "right")
        pairs = np.unique(hit[at].astype(np.int64) * len(texts) + doc)
        cuts = np.searchsorted(pairs, np.arange(1, len(self.grams) + 2) * len(texts))
        return [pairs[a:b] - (k + 1) * len(texts) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

    def candidates(self, q, lists: list[np.ndarray], n: int) -> np.ndarray:
        if q is None:
            return np.arange(n)
        if isinstance(q, frozenset):
            out = None
            for p in sorted((lists[self.where[g] - 1] for g in q), key=len):
                out = p if out is None else np.intersect1d(out, p, assume_unique=True)
            return out
        found = [self.candidates(p, lists, n) for p in q[1]]
        if q[0] == "or":
            return np.unique(np.concatenate(found))
        out = found[0]
        for p in found[1:]:
            out = np.intersect1d(out, p, assume_unique=True)
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans as (start, end, position of the rule), in code points; indexed BATCH_BYTES at a time."""
        out: list[list] = []
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= BATCH_BYTES):
                size += len(texts[b])
                b += 1
            out += self._scan(texts[a:b])
            a = b
        return out

    def _scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        lists = self.postings([t.encode("utf-8", "surrogatepass") for t in texts])
        out: list[list] = [[] for _ in texts]
        for k, (rule, pattern, query) in enumerate(self.rules):
            least, group = rule.least, rule.group
            for d in self.candidates(query, lists, len(texts)).tolist():
                for m in pattern.finditer(texts[d]):
                    a, b = m.span(group)
                    if b - a >= least:
                        out[d].append((m.start(), m.end(), k))
        return out


def _faster(rule: SecretRule) -> SecretRule:
    """A rule that is one repeated class matches maximal runs, so its least length can be asked of the engine itself."""
    if rule.least and not rule.group and re.fullmatch(r"\[[^\]^][^\]]*\]\+", rule.pattern):
        return SecretRule(rule.kind, rule.pattern[:-1] + f"{{{rule.least},}}", rule.flags, 0, rule.least, rule.base)
    return rule


def find(docs: DataFrame, rules: list[SecretRule] | None = None) -> DataFrame:
    """doc_id and found: an array of (kind, start, end, base) per document, by start, then rule order."""
    rules = [*BASE, *MORE] if rules is None else rules
    swift = [_faster(r) for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(swift)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            spans = [[{"kind": rules[k].kind, "start": s, "end": e, "base": rules[k].base} for s, e, k in sorted(r, key=lambda x: (x[0], x[2]))] for r in scanner.scan(texts)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(spans, _SPANS)], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {dict(docs.dtypes)['doc_id']}, found array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def redact(docs: DataFrame, rules: list[SecretRule] | None = None) -> DataFrame:
    """The documents with every span replaced by [KIND] in upper case; overlapping spans become one mark, named by the first."""
    rules = [*BASE, *MORE] if rules is None else rules
    swift, names = [_faster(r) for r in rules], docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(swift)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            done = []
            for t, spans in zip(texts, scanner.scan([t or "" for t in texts]), strict=True):
                if t is not None and spans:
                    out, end = [], 0
                    for s, e, k in sorted(spans, key=lambda x: (x[0], x[2])):
                        if s >= end:
                            out += [t[end:s], f"[{rules[k].kind.upper()}]"]
                        end = max(end, e)
                    t = "".join([*out, t[end:]])
                done.append(t)
            columns = list(batch.columns)
            columns[at] = pa.array(done, batch.schema.field(at).type)
            if size >= 0:
                columns[size] = pa.array([None if t is None else len(t) for t in done], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(trimmed(run), docs.schema)


def report(docs: DataFrame) -> DataFrame:
    """The counts and digests per document, derived from find()'s spans."""
    from pyspark.sql import functions as F

    df, found = find(docs), F.col("found")
    show = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
    return df.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(show(F.filter(found, lambda x: x["base"])).cast("binary"), 256).alias("base_sha256"), show(found).alias("spans"))


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The counts and digest of the base rules by plain scans, for tests."""
    text, spans, counts = text or "", [], []
    for k, r in enumerate(BASE):
        got = [m.span() for m in re.finditer(r.pattern, text, r.flags) if m.end(r.group) - m.start(r.group) >= r.least]
        counts.append(len(got))
        spans += [(a, k, f"{r.kind}:{a}:{b}") for a, b in got]
    return (*counts, hashlib.sha256(",".join(x[2] for x in sorted(spans)).encode()).hexdigest())
