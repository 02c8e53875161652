"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers of HIDDEN units read windows of WINDOW bytes from either side; every position gets a distribution over
the languages from both states, and a document's is the mean over its letters' positions in all its windows. Every byte of
every text lies in exactly one window. The network is trained in numpy by backpropagation through time, on the driver, from a
bounded sample: PER_LANGUAGE documents of each language, the first in the order of a hash of their ids, with a few windows
spread over each. Documents whose crc32(doc_id) is divisible by 5 are never learned from.

Defined results: null text, or text without a letter (Unicode category L), is `und` with score 0; without labelled documents
all are `und`; null doc_id is not held out; documents without lang are predicted, not learned from; repeated rows are predicted
each, and of rows that share an id and a language the least text is learned from; of languages with equal probabilities the
first in order is taken; texts of any length are read whole; empty tables give empty results; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import trimmed

WINDOW, HIDDEN = 64, 8
PER_LANGUAGE, WINDOWS_EACH = 300, 4
EPOCHS, BATCH, RATE = 14, 128, 0.02
#: Bytes of text that a task holds as windows at once.
CHUNK_BYTES = 1 << 20
FOLDS = 5
_LETTER = regex.compile(r"\p{L}")
#: Bytes that are letters in themselves or belong to characters beyond ASCII.
_LETTER_BYTE = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    def __init__(self, languages: list[str], seed: int = 7):
        rng, h, c = np.random.default_rng(seed), HIDDEN, max(1, len(languages))
        self.languages = languages
        p = {"out": rng.normal(0, 0.3, (2 * h, c)), "bias": np.zeros(c)}
        for d in "fb":
            p[f"{d}x"] = rng.normal(0, 0.3, (256, 3 * h))
            p[f"{d}u"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h))
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def _read(self, d: str, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of one direction, steps x windows x units. codes: steps x windows."""
        h, table, u = HIDDEN, self.p[f"{d}x"], self.p[f"{d}u"]
        state = np.zeros((codes.shape[1], h), np.float32)
        out = np.empty((*codes.shape, h), np.float32)
        for t in range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1):
            a, back = table[codes[t]], state @ u
            gates = _sigmoid(a[:, : 2 * h] + back[:, : 2 * h])
            new = np.tanh(a[:, 2 * h :] + gates[:, h:] * back[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, gates, new, back[:, 2 * h :]))
            state = new + gates[:, :h] * (state - new)
            out[t] = state
        return out

    def positions(self, codes: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distributions of every position (steps x windows x languages) and the states they come from."""
        both = np.concatenate([self._read(d, codes, None if keep is None else keep.setdefault(d, [])) for d in "fb"], 2)
        z = both @ self.p["out"] + self.p["bias"]
        z -= z.max(2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(2, keepdims=True)
        return z, both

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over letters' positions, through time."""
        keep: dict = {}
        prob, both = self.positions(codes, keep)
        weight = _LETTER_BYTE[codes].astype(np.float32)
        weight /= max(1.0, weight.sum())
        dz = prob
        dz[:, np.arange(len(target)), target] -= 1
        dz *= weight[:, :, None]
        g = {"out": np.einsum("tbi,tbj->ij", both, dz, optimize=True), "bias": dz.sum((0, 1))}
        dboth, h = dz @ self.p["out"].T, HIDDEN
        for k, d in enumerate("fb"):
            u, back = self.p[f"{d}u"], np.zeros((codes.shape[1], h), np.float32)
            du, inputs = np.zeros_like(u), np.empty((*codes.shape, 3 * h), np.float32)
            for t, state, gates, new, pre in reversed(keep[d]):
                dh = dboth[t, :, k * h : (k + 1) * h] + back
                z, r = gates[:, :h], gates[:, h:]
                dn = dh * (1 - z) * (1 - new * new)
                da = np.concatenate((dh * (state - new) * z * (1 - z), dn * pre * r * (1 - r), dn), 1)
                dback = np.concatenate((da[:, : 2 * h], dn * r), 1)
                inputs[t] = da
                du += state.T @ dback
                back = dh * z + dback @ u.T
            flat, rows = inputs.reshape(-1, 3 * h), codes.reshape(-1)
            g[f"{d}u"] = du
            g[f"{d}x"] = np.stack([np.bincount(rows, flat[:, j], 256) for j in range(3 * h)], 1).astype(np.float32)
        return g

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> None:
        """Adam over shuffled batches; windows: one row of bytes each."""
        rng, step = np.random.default_rng(11), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            rate = RATE * (1 - epoch / epochs) + 1e-3
            for a in range(0, len(order), BATCH):
                pick = order[a : a + BATCH]
                step += 1
                for k, g in self.gradients(windows[pick].T, labels[pick]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of whole texts, CHUNK_BYTES at a time; a longer text has its windows' sums added up."""
        raws = [t.encode("utf-8", "surrogatepass") if t and _LETTER.search(t) else b"" for t in texts]
        counts = np.array([-(-len(r) // WINDOW) for r in raws], np.int64)
        of = np.repeat(np.arange(len(raws)), counts)
        data = np.frombuffer(b"".join([r.ljust(int(n) * WINDOW, b"\0") for r, n in zip(raws, counts, strict=True)]), np.uint8).reshape(-1, WINDOW)
        total, letters = np.zeros((len(raws), max(1, len(self.languages)))), np.zeros(len(raws))
        for a in range(0, len(data), CHUNK_BYTES // WINDOW):
            codes = np.ascontiguousarray(data[a : a + CHUNK_BYTES // WINDOW].T)
            prob, _ = self.positions(codes)
            on = _LETTER_BYTE[codes]
            prob *= on[:, :, None]
            np.add.at(total, of[a : a + codes.shape[1]], prob.sum(0))
            np.add.at(letters, of[a : a + codes.shape[1]], on.sum(0))
        share = total / np.maximum(letters, 1)[:, None]
        best = share.argmax(1)
        return [(self.languages[b], float(min(1.0, s[b]))) if n and self.languages else ("und", 0.0) for b, s, n in zip(best, share, letters, strict=True)]


def _held_out(doc_id) -> object:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[bytes], list[str]]:
    """Windows and their languages, of at most per_language documents of each: rows that may be learned from, chosen by their ids
    before any text is read, and read again under the same conditions."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held_out("doc_id")).select("doc_id", "lang", "text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = known.select("doc_id", "lang").withColumn("rank", rank).where(F.col("rank") <= per_language).select(F.col("doc_id").alias("id"), F.col("lang").alias("language")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                starts = sorted({int(x) for x in np.linspace(0, max(0, len(raw) - WINDOW), WINDOWS_EACH)})
                out += [(raw[s : s + WINDOW].ljust(WINDOW, b"\0"), lang) for s in starts if raw]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], ["window", "lang"])

    # At most per_language ids for each language: a bounded broadcast.
    same = known["doc_id"].eqNullSafe(F.col("id")) & (known["lang"] == F.col("language"))
    texts = known.join(F.broadcast(chosen), same).groupBy("id", "language").agg(F.min("text").alias("text")).select("text", "language")
    got = texts.mapInArrow(run, "window binary, lang string").toArrow().to_pydict()
    rows = sorted(zip(got["window"], got["lang"], strict=True))
    return [w for w, _ in rows], [x for _, x in rows]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> Network:
    windows, langs = sample(docs, per_language)
    network = Network(names := sorted(set(langs)))
    if len(names) > 1:
        network.train(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW), np.array([names.index(x) for x in langs]), epochs)
    return network


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score; only the text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list = []
            for a in range(0, batch.num_rows, 500):
                got += sent.value.predict(batch.column(2).slice(a, 500).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", _held_out("doc_id").alias("held_out"), "text").mapInArrow(trimmed(run), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
