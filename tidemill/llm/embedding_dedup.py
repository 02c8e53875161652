"""Embedding near-duplicates by cross-polytope hashing.

Vectors of equal numbers become one class. A class's direction is rotated by three rounds of random signs and a fast Hadamard
transform; the nearest signed axis is its hash, and as many hashes are joined to a bucket as make buckets outnumber vectors
(at least two). Every vector is filed under its own bucket in each table and looks up its PROBES best buckets there, the own one
first and then those whose axes lose least. Pairs that meet are made distinct while they are narrow, and are verified with their
vectors by cosine in double precision: no reported link is below the threshold.

Links are found with high probability, not with certainty. More hashes to a bucket make a pair meet in fewer tables, so the
number of tables follows: random pairs exactly at the threshold are hashed beforehand, and as many tables are taken as bring
RECALL of them together, whatever the number and the width of the vectors. Every verified pair of different vectors counts, as
the number of links is part of the result; copies are counted, never expanded.

Defined results: vectors that are null, empty, zero, or with null or non-finite components link with nothing and stand for
themselves; vectors of different lengths don't link; an empty table gives an empty result; repeated rows, and rows that share an
id, are vectors of their own with the least id of their class; null ids take no part in links; extra columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stash, trimmed
from .components import components

PROBES = 10
#: The share of pairs at the threshold that the tables must bring together, and the random pairs that this is measured with.
RECALL, TRIALS = 0.9995, 4000
#: Axes of each hash that are tried when probing.
NEAR = 4
SEED = 20_240_229


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of x after one round of signs and Hadamard transform per row of signs; the width is a power of two."""
    for s in signs:
        x = x * s
        h = 1
        while h < x.shape[1]:
            x = x.reshape(len(x), -1, 2, h)
            x = np.concatenate((x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]), 2).reshape(len(x), -1)
            h *= 2
        x = x / math.sqrt(x.shape[1])
    return x


def hashes_per_bucket(n: int, width: int) -> int:
    return max(2, math.ceil(math.log(max(n, 2)) / math.log(2 * width)))


def _met(x: np.ndarray, y: np.ndarray, k: int, tables: int, first: int = 0) -> np.ndarray:
    """Whether one of each pair of rows looks up the other's bucket, rows x tables."""
    a, b = buckets(x, k, tables, seed=SEED + first), buckets(y, k, tables, seed=SEED + first)
    return (a == b[:, :, :1]).any(2) | (b == a[:, :, :1]).any(2)


def tables_needed(k: int, width: int, least: float) -> int:
    """How many tables bring RECALL of random pairs with a cosine of least together. The tables of the trial are other ones than
    those that are used, and a pair's own chance of meeting varies, so the share is counted over pairs and not multiplied out."""
    rng = np.random.default_rng(SEED + 1)
    x, y = rng.normal(size=(2, TRIALS, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = least * x + math.sqrt(max(0.0, 1 - least * least)) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    apart, tables = np.ones(TRIALS, bool), 0
    while tables < 4 or apart.sum() > (1 - RECALL) * TRIALS:
        x, y = x[apart], y[apart]
        apart = ~_met(x, y, k, 1, 1000 + tables)[:, 0] if len(x) else np.zeros(0, bool)
        tables += 1
    return tables


def buckets(x: np.ndarray, k: int, tables: int, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Bucket numbers, rows x tables x probes, the own bucket first."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    near, rng, out = min(NEAR, width), np.random.default_rng(seed), []
    # The ways to choose one of the near axes of every hash, by how many steps they are from the best.
    steps = np.stack(np.meshgrid(*[np.arange(near)] * k, indexing="ij"), -1).reshape(-1, k)
    steps = steps[np.argsort(steps.sum(1), kind="stable")][: max(probes * 6, 1)]
    for _ in range(tables):
        axes, loss = [], []
        for _ in range(k):
            y = rotated(x, rng.choice([-1.0, 1.0], (3, width)))
            best = np.argsort(-np.abs(y), 1)[:, :near]
            size = np.take_along_axis(y, best, 1)
            axes.append(best * 2 + (size < 0))
            loss.append(np.abs(size[:, :1]) - np.abs(size))
        cost = sum(loss[j][:, steps[:, j]] ** 2 for j in range(k))
        order = np.argsort(cost, 1, kind="stable")[:, :probes]
        code = np.zeros(order.shape, np.int64)
        for j in range(k):
            code = code * (2 * width) + np.take_along_axis(axes[j], steps[:, j][order], 1)
        out.append(code)
    return np.stack(out, 1)


def _numbered(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two, which changes no cosine but keeps squares finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _filed(classes: DataFrame, plan: dict[int, tuple[int, int]]) -> DataFrame:
    """(id, width, spot, own): a row per table and probe; spot joins table and bucket. plan: width -> (hashes, tables)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.array(batch.column(2))
            for width in np.unique(widths):
                k, tables = plan[int(width)]
                rows = np.flatnonzero(widths == width)
                for a in range(0, len(rows), step := max(1, 250_000 // (tables * PROBES))):
                    part = batch.take(pa.array(rows[a : a + step]))
                    x = _numbered(_rows(part.column(1), np.arange(part.num_rows)))
                    spots = buckets(x / np.linalg.norm(x, axis=1, keepdims=True), k, tables)
                    n, _, probes = spots.shape
                    spots = spots * tables + np.arange(tables)[None, :, None]
                    ids = part.column(0).take(pa.array(np.repeat(np.arange(n), tables * probes)))
                    own = np.tile(np.arange(probes) == 0, n * tables)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(spots.size, width, np.int32)), pa.array(spots.reshape(-1)), pa.array(own)], ["id", "width", "spot", "own"])

    kind = dict(classes.dtypes)["id"]
    return classes.select("id", "embedding", F.size("embedding").alias("width")).mapInArrow(trimmed(run), f"id {kind}, width int, spot bigint, own boolean")


def _rows(lists: pa.ListArray, at: np.ndarray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    values, starts = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
    width = starts[at[0] + 1] - starts[at[0]]
    return values[starts[at][:, None] + np.arange(width)]


@F.arrow_udf(T.DoubleType())
def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of vectors in pairs of equal length; lengths may differ between pairs."""
    sizes, out = np.diff(a.offsets.to_numpy()), np.zeros(len(a))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        x, y = _numbered(_rows(a, at)), _numbered(_rows(b, at))
        out[at] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
    return pa.array(out)


def links(classes: DataFrame, least: float) -> DataFrame:
    """Verified pairs (u, v), u < v, of different classes."""
    # One row per length that occurs.
    sizes = {r["w"]: r["n"] for r in classes.groupBy(F.size("embedding").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    hashes = {w: hashes_per_bucket(n, 1 << max(1, (w - 1).bit_length())) for w, n in sizes.items()}
    plan = {w: (k, tables_needed(k, w, least)) for w, k in hashes.items()}
    filed, path = stash(_filed(classes, plan), "buckets")
    own = filed.where("own").select("width", "spot", F.col("id").alias("v"))
    met = filed.select("width", "spot", F.col("id").alias("u")).join(own, ["width", "spot"]).where("u <> v")
    pairs, pairs_path = stash(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "candidates")
    discard(classes.sparkSession, path)
    one, other = classes.select(F.col("id").alias("u"), F.col("embedding").alias("a")), classes.select(F.col("id").alias("v"), F.col("embedding").alias("b"))
    found, _ = stash(pairs.join(one, "u").join(other, "v").where(cosine("a", "b") >= least).select("u", "v"), "embedding-links")
    discard(classes.sparkSession, pairs_path)
    return found


def join(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept, n_copies (vectors of the same numbers) per row."""
    e = F.col("embedding")
    sound = e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    # -0.0 and 0.0 are one component; the array itself is the key, so classes are exact.
    key = F.when(F.col("sound"), F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")))
    classes, _ = stash(rows.where("sound").groupBy(key.alias("embedding")).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    # Classes are numbered by their least vec_id; rows that share an id make that ambiguous, and then a hash of the vector does.
    clash = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count()
    classes = classes.withColumn("id", F.xxhash64("embedding") if clash else F.col("rep"))
    found = links(classes, least)
    both = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sizes = classes.select(F.col("id").alias("v"), F.col("copies").alias("c"))
    near = both.join(sizes, "v").groupBy(F.col("u").alias("id")).agg(F.sum("c").alias("near"))
    joined = components(found).join(classes.select("id", "rep"), "id")
    least_id = joined.groupBy("component").agg(F.min("rep").alias("least_id"))
    joined = joined.join(least_id, "component").select("id", "least_id")
    told = classes.select("id", "rep", "copies").join(near, "id", "left").join(joined, "id", "left")
    told, _ = stash(told.select(F.col("id").alias("class_id"), "copies", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("least_id", "rep").alias("component")), "told")
    named = classes.select(F.col("embedding").alias("k"), F.col("id").alias("class_id")).join(told, "class_id")
    out = rows.withColumn("k", key).join(named, "k", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.u, r.reach FROM r JOIN l ON l.v = r.vec_id),
m AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept, count(*) OVER (PARTITION BY e) AS n_copies
FROM v JOIN m USING (vec_id) LEFT JOIN n ON n.u = v.vec_id"""
