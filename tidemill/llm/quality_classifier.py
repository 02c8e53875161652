"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

Evidence. A logistic regression per label (quality, toxic) is fitted on the driver, on a bounded sample of labelled documents,
from the presence of telling words (chosen by how far their document counts lie from chance) and from style bins. It gives
every document a probability per label.

Sites. One grouped aggregation sums those probabilities per (host, path); hosts and the whole corpus are sums of its rows. The
documents have no addresses, so their source stands for the host and their language for the path; both are parameters. A host's
rate is shrunk towards the corpus's, a path's towards its host's, by Beta priors whose strengths are estimated from the spread
between hosts and between paths (method of moments) among priors with a single peak: a sparse site hardly moves from the prior
above it, and without any spread beyond chance no site does. A document's own evidence is left out of its site's rate.

Documents. A document is of its site's kind with probability 1 - MIXED, and any document of the corpus otherwise; that mixture
takes the place of the corpus's rate in the odds of its own evidence. So a site informs, but the best or the worst of sites moves
the odds by a bounded factor.

A document is kept if its quality is likelier than not and its toxicity is not.

Defined results: null or empty text is judged by its style bins and its site like any other; texts are read whole, however long;
null host or path is a site of its own; without labels every document has the prior's probability 1/2 and is kept, and exactly
even odds keep; labels with null ids or values are left out; of repeated labels the largest counts; empty tables give empty
results; repeated rows are judged each; extra columns are carried through untouched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, maybe_broadcast, stash, trimmed

#: Labelled documents that the classifier is fitted on, the first in the order of a hash of their ids.
SAMPLE = 6_000
#: Telling words kept per label, and how many standard deviations from chance a word must lie.
WORDS, DEVIATIONS = 200, 5.0
#: The share of a site's documents that may be anything.
MIXED = 0.5
BROADCAST_ROWS = 100_000
#: Rounding of sums must not reject what is exactly even.
_SLACK = 1e-9
LABELS = ("quality", "toxic")
_STYLE = 7
_BINS = 8


def _bin(x: float) -> int:
    """Bins of a share: 0, then doubling from 1/128."""
    return 0 if x <= 0 else max(1, min(_BINS - 1, 8 + math.floor(math.log2(x))))


def style(text: str) -> list[int]:
    """One bin index per style measure: symbols, capitals, digits, bars, repeated words, repeated lines, length."""
    raw, words = text.encode("utf-8", "surrogatepass"), text.split()
    of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(raw))
    shares = [of[_SYMBOLS].sum() / n, of[65:91].sum() / n, of[48:58].sum() / n, of[124] / max(1, len(words)), 1 - len(set(words)) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines))]
    return [k * _BINS + _bin(x) for k, x in enumerate(shares)] + [(_STYLE - 1) * _BINS + min(_BINS - 1, int(math.log2(len(words) + 1) / 2))]


_SYMBOLS = list(b"#*$%&|<>!@^~={}[]\\")
_ENDS = ".,;:!?\"'()[]{}<>*#$%&|-_/\\0123456789"
#: Beginnings of words, by length, that count as features too, and the numbers of distinct words that share one.
STEMS, SHARED = (4, 5, 7), (1, 2, 4)


def word_set(text: str) -> set[str]:
    return {w.strip(_ENDS) for w in set(text.lower().split())}


def stem_features(counts: Counter) -> Iterator[str]:
    for stem, c in counts.items():
        for k in SHARED:
            if c >= k:
                yield f"{stem}+{k}"


def features(words) -> set[str]:
    """The words, and word beginnings with the number of words that share them."""
    return set(words).union(stem_features(Counter(w[:k] for w in words for k in STEMS if len(w) > k)))


class Model:
    """Weights of telling words and style bins per label."""

    def __init__(self, base: list[float], words: dict[str, tuple], bins: np.ndarray):
        self.base, self.words, self.bins, self.known = base, words, bins, frozenset(words)
        self.stems = frozenset(f.rpartition("+")[0] for f in words if "+" in f)

    def log_odds(self, text: str | None) -> tuple[float, float]:
        text = text or ""
        a, b = self.base
        for k in style(text):
            a += self.bins[0, k]
            b += self.bins[1, k]
        own, stems = word_set(text), self.stems
        shared = Counter(s for k in STEMS for w in own if (s := w[:k]) in stems and len(w) > k)
        for w in (self.known & own).union(self.known.intersection(stem_features(shared))):
            x, y = self.words[w]
            a += x
            b += y
        return a, b


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Bins, features and labels of at most size labelled documents; the ids are chosen before any text is read."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([style(t) for t in texts], pa.list_(pa.int32())), pa.array([list(features(word_set(t))) for t in texts], pa.list_(pa.string())), batch.column(1), batch.column(2)], ["bins", "features", "quality", "toxic"])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("quality").cast("int"), F.col("toxic").cast("int"))
    return joined.mapInArrow(trimmed(run), "bins array<int>, features array<string>, quality int, toxic int")


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the constant and isn't shrunk."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def telling(sample: DataFrame) -> list[str]:
    """The features whose document counts lie farthest from chance, WORDS per label at most; counted by Spark."""
    total = sample.agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in LABELS]).first()
    if not total["n"]:
        return []
    counts, _ = stash(sample.select(F.explode("features").alias("feature"), *LABELS).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(x) for x in LABELS]).where("n >= 3"), "features")
    chosen: set[str] = set()
    for x in LABELS:
        far = F.abs(F.col(x) - F.col("n") * total[x]) / F.sqrt(F.col("n") * (total[x] * (1 - total[x])) + 0.5)
        chosen.update(r["feature"] for r in counts.select("feature", far.alias("far")).where(F.col("far") >= DEVIATIONS).orderBy(F.desc("far"), "feature").limit(WORDS).collect())
    return sorted(chosen)


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Model:
    """Fit both labels; what reaches the driver is one short row of feature numbers per sampled document."""
    sample, path = stash(labelled_sample(docs, labels, size), "labelled")
    names = telling(sample)
    place = {w: _STYLE * _BINS + k for k, w in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted([*bins, *(place[w] for w in words if w in place)]) for bins, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), batch.column(2), batch.column(3)], ["on", *LABELS])

    # Rows of one id may repeat, so the bound is asked for once more.
    rows = sample.limit(size).mapInArrow(run, "on array<int>, quality int, toxic int").toArrow().to_pydict()
    discard(docs.sparkSession, path)
    rows = sorted(zip(rows["on"], rows["quality"], rows["toxic"], strict=True))
    if not rows:
        return Model([0.0, 0.0], {}, np.zeros((2, _STYLE * _BINS)))
    y = np.array([r[1:] for r in rows], float)
    x = np.zeros((len(rows), _STYLE * _BINS + len(place) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, r[0]] = 1
    constant = np.eye(1, x.shape[1], x.shape[1] - 1)[0]
    w = np.stack([_fit(x, y[:, k]) if 0 < y[:, k].mean() < 1 else constant * (4 * y[:, k].mean() - 2) for k in range(2)])
    return Model(w[:, -1].tolist(), {t: tuple(w[:, k].tolist()) for t, k in place.items()}, w[:, : _STYLE * _BINS])


def with_evidence(docs: DataFrame, model: Model, into: str) -> DataFrame:
    """docs plus a struct (quality, toxic) of log odds."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def odds(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for text in texts:
            both = [m.log_odds(t) for t in text.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([b[k] for b in both], pa.float64()) for k in range(2)], list(LABELS))

    @F.arrow_udf("struct<quality:double,toxic:double>")
    def evidence(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return trimmed(odds)(texts)

    return docs.withColumn(into, evidence("text"))


def _p(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def _weight(prior: str, label: str) -> Column:
    """Method of moments: what one document of a site counts against the prior (the inverse of the prior's strength), from the
    spread of rates around it beyond chance."""
    rate, chance = F.col(f"s_{label}") / F.col("n"), F.col(prior) * (1 - F.col(prior))
    spread = F.greatest(F.avg((rate - F.col(prior)) ** 2) - F.avg(chance / F.col("n")), F.lit(0.0))
    left = F.avg(chance) - spread
    return F.coalesce(F.when(left > 0, spread / left).otherwise(F.lit(1.0)), F.lit(0.0)).alias(f"k_{label}")


def _shrunk(total: Column, n: Column, prior: Column, weight: Column) -> Column:
    """The rate under a Beta prior with a single peak, which no site of one document outweighs."""
    one = F.least(weight, prior, 1 - prior)
    return (one * total + prior) / (one * n + 1)


def site_rates(scored: DataFrame, evidence: str, host: str, path: str) -> DataFrame:
    """(host, path, n, per label: s_ sum of probabilities, m_ host's shrunk rate, k_ a document's weight, w_ corpus rate)."""
    e = F.col(evidence)
    paths = scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(_p(e[x])).alias(f"s_{x}") for x in LABELS])
    paths, _ = stash(paths, "paths")
    hosts, hosts_path = stash(paths.groupBy("host").agg(F.sum("n").alias("n"), *[F.sum(f"s_{x}").alias(f"s_{x}") for x in LABELS]), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"s_{x}").alias(f"s_{x}") for x in LABELS]).first()
    world = {x: total[f"s_{x}"] / total["n"] if total["n"] else 0.5 for x in LABELS}
    hosts = hosts.withColumns({f"w_{x}": F.lit(world[x]) for x in LABELS})
    k = hosts.agg(*[_weight(f"w_{x}", x) for x in LABELS]).first()
    rates = hosts.select(F.col("host").alias("h"), *[_shrunk(F.col(f"s_{x}"), F.col("n"), F.col(f"w_{x}"), F.lit(k[f"k_{x}"])).alias(f"m_{x}") for x in LABELS])
    joined = paths.join(maybe_broadcast(rates, BROADCAST_ROWS), paths["host"].eqNullSafe(rates["h"])).drop("h")
    joined, _ = stash(joined, "site-rates")
    weight = joined.agg(*[_weight(f"m_{x}", x) for x in LABELS]).first()
    discard(scored.sparkSession, hosts_path)
    return joined.withColumns({f"k_{x}": F.lit(weight[f"k_{x}"]) for x in LABELS} | {f"w_{x}": F.lit(world[x]) for x in LABELS})


def posteriors(scored: DataFrame, evidence: str, host: str, path: str) -> DataFrame:
    """scored plus p_quality, p_toxic (struct column _post would clash, so names are made unused) and kept, as one struct."""
    sites = site_rates(scored, evidence, host, path)
    h, p, s, post = fresh(scored, "_site_host", "_site_path", "_site", "_post")
    named = sites.select(F.col("host").alias(h), F.col("path").alias(p), F.struct(*[c for c in sites.columns if c not in ("host", "path")]).alias(s))
    named, _ = stash(named, "sites")
    named = maybe_broadcast(named, BROADCAST_ROWS)
    df = scored.join(named, scored[host].eqNullSafe(named[h]) & scored[path].eqNullSafe(named[p]), "left")
    e, site, out = F.col(evidence), F.col(s), []
    odds = lambda r: F.log(F.greatest(r, F.lit(1e-6)) / F.greatest(1 - r, F.lit(1e-6)))
    for x in LABELS:
        rate = _shrunk(F.greatest(site[f"s_{x}"] - _p(e[x]), F.lit(0.0)), F.greatest(site["n"] - 1, F.lit(0)), site[f"m_{x}"], site[f"k_{x}"])
        shift = odds((1 - MIXED) * rate + MIXED * site[f"w_{x}"]) - odds(site[f"w_{x}"])
        out.append(_p(e[x] + shift).alias(x))
    df = df.withColumn(post, F.struct(*out)).drop(h, p, s)
    return df.withColumn(post, F.struct(F.col(post)["quality"].alias("p_quality"), F.col(post)["toxic"].alias("p_toxic"), ((F.col(post)["quality"] >= 0.5 - _SLACK) & (F.col(post)["toxic"] <= 0.5 + _SLACK)).alias("kept"))), post


def report(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, kept, p_quality, p_toxic per document, with the classifier's own probabilities beside them."""
    model = fit(docs, labels)
    scored, _ = stash(with_evidence(docs.select("doc_id", host, path, "text"), model, "evidence").drop("text"), "evidence")
    out, post = posteriors(scored, "evidence", host, path)
    return out.select("doc_id", F.col(post)["kept"].alias("kept"), F.col(post)["p_quality"].alias("p_quality"), F.col(post)["p_toxic"].alias("p_toxic"), _p(F.col("evidence")["quality"]).alias("doc_quality"), _p(F.col("evidence")["toxic"]).alias("doc_toxic"))


def keep(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The documents kept, with their own columns. Evidence is computed twice rather than the texts written once more."""
    (evidence,) = fresh(docs, "_evidence")
    out, post = posteriors(with_evidence(docs, fit(docs, labels), evidence), evidence, host, path)
    return out.where(F.col(post)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
