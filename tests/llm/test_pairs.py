import random

import brute
import numpy as np
import pytest

from tidemill.llm import embedding_dedup, jaccard
from tidemill.llm.components import components


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = brute.components(300, links)
    assert got == {v: want[v] for a, b in links if a != b for v in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def corpus(seed, n_docs=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, base = make(60), make(120)
    out = [None, "", " \t\n", "one", "ONE", "one two", "a b c", "A  b\nc", "a b c d", " ".join(make(3000))]
    for _ in range(n_docs):
        kind = rng.randrange(6)
        words = make(rng.randrange(1, 120))
        if kind == 1:
            words = words + passage + make(20)
        elif kind == 2:
            words = list(base)
            for _ in range(rng.randrange(1, 9)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind == 3 and len(out) > 12:
            words = (out[rng.randrange(10, len(out))] or "x").split()
            words[rng.randrange(len(words))] = "changed"
        elif kind == 4 and len(out) > 12:
            words = (out[rng.randrange(10, len(out))] or "x").split() + make(2)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("n,percent,often", [(3, 90, 24), (5, 80, 24), (3, 90, 2), (2, 60, 3)])
def test_jaccard_equals_brute_force(spark, monkeypatch, n, percent, often):
    monkeypatch.setattr(jaccard, "OFTEN", often)
    texts = corpus(n + percent)
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, id long, component long").repartition(5)
    sets, want = brute.near_copies(texts, n, percent)
    got = {r["doc_id"]: r for r in jaccard.join(docs, n, percent).collect()}
    assert {k: got[k]["n_shingles"] for k in got} == {k: len(s) for k, s in enumerate(sets)}
    assert {k: got[k]["component_id"] for k in got} == dict(enumerate(want))


def test_jaccard_without_groups_is_exact_too(spark, monkeypatch):
    """The matrix alone finds every pair that groups would have shown."""
    monkeypatch.setattr(jaccard, "families", lambda narrow: spark.createDataFrame([], "id long, family long, m long"))
    texts = corpus(3, 80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(docs, 3, 80).collect()} == dict(enumerate(brute.near_copies(texts, 3, 80)[1]))


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_jaccard_families_of_altered_copies(spark, n, percent):
    """Copies of a few bases, most of them just off the threshold with the base, and copies of copies."""
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = []
    for _ in range(3):
        base = [rng.choice(vocabulary) for _ in range(100)]
        family = [base]
        for _ in range(70):
            words = list(rng.choice(family))
            for _ in range(rng.choice([1, 2, 2, 3, 3, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                del words[rng.randrange(len(words)) :][:3]
            family.append(words if len(words) > 60 else base)
        texts += [" ".join(w) for w in family]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute.near_copies(texts, n, percent)[1]
    assert 3 < len(set(want)) < len(texts)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(docs, n, percent).collect()} == dict(enumerate(want))


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(100))
    other = " ".join(f"v{i}" for i in range(50))
    rows = [(4, long), (2, long.upper()), (3, long + " more"), (9, None), (8, None), (2, long.upper()), (None, "null id"), (8, ""), (2, other), (7, other), (8, "x y z"), (1, "x y z q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.keep_one(docs).collect()
    assert sorted(((r["doc_id"] or -1), (r["text"] or "").lower()) for r in got) == sorted([(-1, "null id"), (1, "x y z q"), (2, long), (2, other), (8, ""), (8, "x y z"), (9, "")])
    assert jaccard.keep_one(docs.limit(0)).count() == 0 and jaccard.join(docs.limit(0)).count() == 0


def test_jaccard_rows_that_share_an_id(spark):
    """Each row's own text counts; class numbers that clash are told apart."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long), (5, "a b c d e f"), (6, long + " z"), (7, "a b c d e f"), (None, long), (5, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or -1), r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, 3, 90).collect())
    assert got == [(-1, 58, None), (5, 4, 5), (5, 58, 5), (5, 58, 5), (6, 59, 5), (7, 4, 5)]


def vectors(seed, n=600, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, d))
    noise = rng.choice([0.0, 0.05, 0.2, 0.3], n)
    return (centres[rng.integers(0, 30, n)] + rng.normal(size=(n, d)) * noise[:, None]).astype(np.float32)


def cosines(x):
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_embedding_links_and_recall(spark):
    x = vectors(1)
    got = {r["vec_id"]: r for r in embedding_dedup.join(spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).collect()}
    near = cosines(x) >= 0.9
    np.fill_diagonal(near, False)
    found = np.array([got[k]["n_links"] for k in range(len(x))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.99 * near.sum()
    assert [got[k]["kept"] for k in range(len(x))] == [got[k]["component_id"] == k for k in range(len(x))]


@pytest.mark.parametrize("k,width", [(3, 32), (3, 128), (4, 64), (4, 128), (5, 64), (5, 128)])
def test_recall_holds_for_any_number_of_hashes(k, width):
    """Pairs exactly at the threshold, other ones than the tables were counted with."""
    rng = np.random.default_rng(width + k)
    x, y = rng.normal(size=(2, 400, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    assert embedding_dedup._met(x, y, k, embedding_dedup.tables_needed(k, width, 0.9)).any(1).mean() >= 0.98


@pytest.mark.parametrize("k", [3, 5])
def test_links_as_among_very_many_vectors(spark, monkeypatch, k):
    monkeypatch.setattr(embedding_dedup, "hashes_per_bucket", lambda n, width: k)
    x = vectors(k, 300, 40)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.join(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    near = cosines(x) >= 0.9
    np.fill_diagonal(near, False)
    assert all(got[i] <= near[i].sum() for i in got) and sum(got.values()) >= 0.98 * near.sum()


def test_embeddings_of_several_lengths_and_repeated_ids(spark):
    rows = [(1, [1.0, 1.0], "x"), (2, [1.0, 1.01], "x"), (3, [1.0, 0.0, 0.0], "x"), (4, [1.0, 0.01, 0.0], "x"), (5, [2.0], "x"), (6, [3.0], "x"), (7, [1e300, 1e300], "x"), (1, [0.0, 0.0, 1.0], "x"), (8, [0.0, 0.0, 2.0], "x"), (None, [1.0, 1.0], "x"), (9, [-4.0], "x")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string").withColumnRenamed("id", "component")
    got = sorted(((r["vec_id"] or -1), r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.join(d).collect())
    assert got == [(-1, 0, None, True), (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (6, 1, 5, False), (7, 2, 1, False), (8, 1, 1, False), (9, 0, 9, True)]


def test_embedding_unsound_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [[1.0, 0.0], [1.0, 0.0], [1.0, 0.01], None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0], [-1.0, 0.0], [2.0, 0.0], [-0.0, 1.0], [0.0, 1.0]]
    d = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.join(d).collect()}
    assert len(got) == len(rows) and got[0] == (3, 0, True) and got[1] == (3, 0, False) and got[2] == (3, 0, False) and got[11] == (3, 0, False)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10)) and got[12] == (1, 12, True) and got[13] == (1, 12, False)
    assert embedding_dedup.join(d.limit(0)).count() == 0


def test_rotation_keeps_lengths():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 16))
    y = embedding_dedup.rotated(x, rng.choice([-1.0, 1.0], (3, 16)))
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(x @ x.T, y @ y.T)
    b = embedding_dedup.buckets(x, 2, 3, 5)
    assert b.shape == (5, 3, 5) and all(len(set(row)) == 5 for t in b for row in t)
