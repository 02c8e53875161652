"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon.

The words that are most frequent in the corpus (counted over all of it, LEXICON_WORDS of them) are merged once on the driver
and compiled into a minimal acyclic automaton: equal suffixes share their states, and every arc carries the number of
accepted words that it leaves behind, so the sum along a word's path is the word's rank, which addresses its token ids. Tasks
get the automaton as bytes of bounded size, write them to a file of their own, and map that file into memory. A word that the
automaton does not accept is merged exactly, pair by pair in rank order. Each task remembers what it has looked up, within
CACHE_WORDS.

Encoding equals that of the tokenizer file's own library without added special tokens; special tokens that occur in a text
become their ids. Decoding joins the tokens' strings by a space, as that library does for a file without a decoder.

Defined results: null text is encoded as the empty text (no ids); empty tables give empty results; repeated rows are encoded
each; texts of any length are encoded whole; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stash, trimmed

LEXICON_WORDS = 32_768
CACHE_WORDS = 300_000
#: Longer words are neither counted nor remembered.
WORD_CHARS = 64
#: Distinct words that a counting task holds before it passes them on.
COUNT_WORDS = 400_000
#: Characters of text that are looked up at once.
BATCH_CHARS = 2 << 20
#: Longer words are merged one by one.
ROW_BYTES = 40

#: White space of the tokenizer's regular expressions; str.split() also splits at \x1c-\x1f.
_GAP = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")
_LETTER, _NUMBER = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
_CONTRACTION = r"\n|'s|'t|'re|'ve|'m|'ll|'d"
_ASCII_WORD = re.compile(_CONTRACTION + r"|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: Python's \w also holds numerals that are no decimal digits; texts with one of those take the longer way.
_PLAIN_WORD = re.compile(_CONTRACTION + r"|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_NUMERAL = regex.compile(r"[\p{No}\p{Nl}]")


class _Kinds(dict):
    """Stand-ins of one ASCII character for others of their kind: a letter, a number, white space, anything else."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = c if code < 128 else "a" if _LETTER.match(c) else "0" if _NUMBER.match(c) else " " if _GAP.match(c) else "!"
        self[code] = kind
        return kind


_KINDS = _Kinds()


def _prepared(text: str) -> str:
    """Composed and in lower case, which goes by single characters; only the capital sigma would look at its neighbours."""
    return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


def words(text: str) -> list[str]:
    """The words to be merged of a text whose chunks stand on lines of their own: composed, lower case, split by kind of
    character; a line end remains as a word of its own."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    low = _prepared(text)
    if low.replace("\n", "").isprintable() and not _NUMERAL.search(low):
        return _PLAIN_WORD.findall(low)
    return [low[m.start() : m.end()] for m in _ASCII_WORD.finditer(low.translate(_KINDS))]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


def chunks(text: str) -> list[str]:
    """The text between white space; no word crosses it."""
    return [c for c in _GAP.split(text) if c] if _ODD.search(text) else text.split()


_NO_RANK = 1 << 30


#: How a tokenizer file must prepare, split and merge text for this module (fixed values).
_FORM = {
    "normalizer": [["NFC"], ["Replace", r"\s+", " "], ["Lowercase"]],
    "split": [["Split", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "Removed", True], ["ByteLevel", False, False]],
    "model": ["BPE", False, False, False, False, False],
    "after": [False, False],
}


def _form(spec: dict) -> dict:
    parts = lambda x, key: x[key] if x and key in x else [x] if x else []
    regex_of = lambda x: x.get("pattern", {}).get("Regex")
    kept = {"NFC": lambda x: [], "Lowercase": lambda x: [], "Replace": lambda x: [regex_of(x), x["content"]], "Split": lambda x: [regex_of(x), x["behavior"], x["invert"]], "ByteLevel": lambda x: [x["add_prefix_space"], x["use_regex"]]}
    told = lambda x: [x["type"], *kept.get(x["type"], lambda y: [str(y)])(x)]
    model = spec["model"]
    return {
        "normalizer": [told(x) for x in parts(spec["normalizer"], "normalizers")], "split": [told(x) for x in parts(spec["pre_tokenizer"], "pretokenizers")],
        "model": [model["type"], *[bool(model.get(k)) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")]], "after": [bool(spec.get("post_processor")), bool(spec.get("decoder"))],
    }


class Vocabulary:
    """A tokenizer file with word-end suffix: ids, merges by id and special tokens. Tasks get merges and tokens as arrays, which
    hold no object for each entry; ids by name stay on the driver."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"]
        if (found := _form(spec)) != _FORM:
            raise ValueError(f"{path} splits or merges text in another way than this module: {found}")
        self.ids: dict[str, int] = model["vocab"]
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            pairs[self.ids[a], self.ids[b]] = rank, self.ids[a + b]
        symbols = byte_symbols()
        self.inner, self.last = [self.ids[s] for s in symbols], [self.ids[s + end] for s in symbols]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = self.ids | self.special
        tokens = [b""] * (max(names.values()) + 1)
        for t, k in names.items():
            tokens[k] = t.encode()
        self.size, self.spelled, self.ends = len(tokens), b"".join(tokens), np.cumsum([len(t) for t in tokens])
        keys = sorted((a << 32 | b, rank) for (a, b), (rank, _) in pairs.items())
        self.keys, self.ranks = np.array([k for k, _ in keys], np.int64), np.array([*[r for _, r in keys], _NO_RANK], np.int32)
        self.made = np.array([new for _, new in sorted(pairs.values())], np.int64)
        self.inner_of, self.last_of = np.array(self.inner, np.int64), np.array(self.last, np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "ids"}

    def tokens(self) -> list[bytes]:
        ends = self.ends.tolist()
        return [self.spelled[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of many pairs, _NO_RANK for those that never merge."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != key] = len(self.keys)
        return self.ranks[at]

    def merge_rows(self, raw: np.ndarray) -> list[bytes]:
        """Exact merges of many words of one length, a row of bytes each: every round merges each row's best pair."""
        ids = self.inner_of[raw]
        ids[:, -1] = self.last_of[raw[:, -1]]
        out: list = [b""] * len(raw)
        rows, ranks = np.arange(len(raw)), self.rank(ids[:, :-1], ids[:, 1:])

        def give(which: np.ndarray, found: np.ndarray) -> None:
            block, step = found.astype("<u4").tobytes(), 4 * found.shape[1]
            for k, r in enumerate(which.tolist()):
                out[r] = block[k * step : (k + 1) * step]

        while ids.shape[1] > 1 and len(ids):
            j = ranks.argmin(1)
            best = ranks[np.arange(len(j)), j]
            ended = best == _NO_RANK
            if ended.any():
                give(rows[ended], ids[ended])
                ids, ranks, rows, j, best = ids[~ended], ranks[~ended], rows[~ended], j[~ended], best[~ended]
                if not len(ids):
                    return out
            at, col = np.arange(len(j)), np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, col + (col > j[:, None]), 1)
            ids[at, j] = self.made[best]
            ranks = np.take_along_axis(ranks, col[:-1] + (col[:-1] >= j[:, None]), 1)
            k = np.flatnonzero(j > 0)
            ranks[k, j[k] - 1] = self.rank(ids[k, j[k] - 1], ids[k, j[k]])
            k = np.flatnonzero(j < ids.shape[1] - 1)
            ranks[k, j[k]] = self.rank(ids[k, j[k]], ids[k, j[k] + 1])
        give(rows, ids)
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merges: always the pair of lowest rank, the leftmost of equal ones."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        codes = np.array(ids, np.int64)
        left, right = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        ranks = self.rank(codes[:-1], codes[1:])
        heap = [(int(ranks[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(ranks != _NO_RANK).tolist()]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[rank]), -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            near = [(x, y) for x, y in ((left[i], i), (i, right[i])) if x >= 0 and y >= 0]
            found = self.rank(np.array([ids[x] for x, _ in near], np.int64), np.array([ids[y] for _, y in near], np.int64)) if near else ()
            for (x, y), r in zip(near, found, strict=True):
                if r != _NO_RANK:
                    heapq.heappush(heap, (int(r), x, ids[x], ids[y]))
        return [k for k in ids if k >= 0]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton over the words, with their ids, in one block.

    Words are added in order; when a word leaves the path of its forerunner, the states behind that point are final in shape
    and are replaced by equal states made before, found by their outgoing arcs."""
    register: dict[tuple, int] = {}
    arcs_of: list[tuple] = []  # per state: (is final, ((label, target), ...))

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(arcs_of)
            arcs_of.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # open states along the last word: [is final, arcs]
    labels: list[int] = []
    before = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            state = settle(path.pop())
            path[-1][1].append((labels.pop(), state))

    order = sorted(entries)
    for w in order:
        same = len(os.path.commonprefix([before, w]))
        close(same)
        for b in w[same:]:
            labels.append(b)
            path.append([False, []])
        path[-1][0] = True
        before = w
    close(0)
    root = settle(path[0])
    # A target precedes its sources, so counts of accepted words follow in one pass.
    accepted: list[int] = []
    for final, arcs in arcs_of:
        accepted.append(final + sum(accepted[t] for _, t in arcs))
    first, target, skip, label, finals = [0], [], [], bytearray(), bytearray()
    for final, arcs in arcs_of:
        passed = int(final)
        for b, t in arcs:
            label.append(b)
            target.append(t)
            skip.append(passed)
            passed += accepted[t]
        first.append(len(target))
        finals.append(final)
    starts, ids = [0], []
    for w in order:
        ids += entries[w]
        starts.append(len(ids))
    numbers = [root, len(finals), len(target), len(order), len(ids), *first, *target, *skip, *starts, *ids]
    return struct.pack(f"<{len(numbers)}I", *numbers) + bytes(finals) + bytes(label)


class Lexicon:
    """A compiled lexicon, mapped from a file that is gone from its folder at once."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, states, arcs, n, ids = struct.unpack_from("<5I", self.map)
        sizes = [20, 4 * (states + 1), 4 * arcs, 4 * arcs, 4 * (n + 1), 4 * ids, states]
        at = np.cumsum(sizes).tolist()
        part = lambda k, kind, count: np.frombuffer(self.map, kind, count, at[k])
        self.first, self.target, self.skip = part(0, "<u4", states + 1), part(1, "<u4", arcs), part(2, "<u4", arcs)
        self.starts, self.ids_at = part(3, "<u4", n + 1), at[4]
        self.finals, self.labels = part(5, "u1", states), part(6, "u1", arcs)
        source = np.repeat(np.arange(states, dtype=np.int64), np.diff(self.first.astype(np.int64)))
        self.keys = source << 8 | self.labels  # arcs in order of (state, label)

    def ranks_of(self, raw: np.ndarray) -> np.ndarray:
        """For words of one length, a row of bytes each: their ranks among the accepted words, -1 for those not accepted."""
        out, rows = np.full(len(raw), -1, np.int64), np.arange(len(raw))
        state, rank = np.full(len(raw), self.root, np.int64), np.zeros(len(raw), np.int64)
        for k in range(raw.shape[1]):
            key = state << 8 | raw[rows, k]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[arc] == key
            rows, arc = rows[on], arc[on]
            state, rank = self.target[arc].astype(np.int64), rank[on] + self.skip[arc]
        ends = self.finals[state] == 1
        out[rows[ends]] = rank[ends]
        return out

    def ids(self, rank: int) -> bytes:
        return self.map[self.ids_at + 4 * int(self.starts[rank]) : self.ids_at + 4 * int(self.starts[rank + 1])]


class Encoder(dict):
    """Texts to ids as little-endian unsigned 32-bit bytes, and back. As a dict: the ids of the chunks seen so far."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        super().__init__()
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.spelled: list[bytes] = []
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def merged(self, distinct: list[str]) -> dict[str, bytes]:
        """The ids of each word: from the lexicon, else by merging, many words of one length at a time."""
        raws, out = [w.encode("utf-8", "surrogatepass") for w in distinct], {}
        by_length: dict[int, list[int]] = {}
        for k, r in enumerate(raws):
            by_length.setdefault(len(r), []).append(k)
        for length, which in by_length.items():
            if length > ROW_BYTES:
                for k in which:
                    ids = self.vocabulary.merge(raws[k])
                    out[distinct[k]] = struct.pack(f"<{len(ids)}I", *ids)
                continue
            rows = np.frombuffer(b"".join([raws[k] for k in which]), np.uint8).reshape(-1, length)
            rank = self.lexicon.ranks_of(rows) if self.lexicon and len(self.lexicon.keys) else np.full(len(rows), -1)
            unseen = np.flatnonzero(rank < 0)
            for k in np.flatnonzero(rank >= 0).tolist():
                out[distinct[which[k]]] = self.lexicon.ids(rank[k])
            for k, ids in zip(unseen.tolist(), self.vocabulary.merge_rows(rows[unseen]), strict=True):
                out[distinct[which[k]]] = ids
        return out

    def learn(self, unseen: list[str]) -> None:
        """Look up the ids of chunks not seen before. A word is a chunk as well, so words seen before are known too."""
        found = words("\n".join(unseen))
        distinct = dict.fromkeys(found)
        distinct.pop("\n", None)
        ids = self.merged([w for w in distinct if w not in self])
        self.update(ids)
        of, own = iter(unseen), []
        for w in found:
            if w == "\n":
                self[next(of)] = own[0] if len(own) == 1 else b"".join(own)
                own = []
            else:
                own.append(self[w])
        for c in of:
            self[c] = b"".join(own)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, BATCH_CHARS of text at a time."""
        out, a, named = [], 0, self.vocabulary.special
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b] or "") <= BATCH_CHARS):
                size += len(texts[b] or "")
                b += 1
            parts = [self.special.split(t) if t and self.special and "<" in t and self.special.search(t) else (t or "",) for t in texts[a:b]]
            lists = [[p if p in named else chunks(p) for p in own] for own in parts]
            distinct: set[str] = set()
            for own in lists:
                distinct.update(*[x for x in own if not isinstance(x, str)])
            if len(self) > CACHE_WORDS:  # what this batch holds is likely to come again
                kept = {c: self[c] for c in distinct if c in self}
                super().clear()
                self.update(kept)
            if unseen := list(distinct.difference(self)):
                # Few chunks hold characters that need the longer way; they don't slow the others.
                plain = [c for c in unseen if c.isprintable() and (c.isascii() or not _NUMERAL.search(c))]
                for part in (plain, list(set(unseen).difference(plain)) if len(plain) < len(unseen) else []):
                    if part:
                        self.learn(part)
            get = self.__getitem__
            out += [b"".join([struct.pack("<I", named[x]) if isinstance(x, str) else b"".join(map(get, x)) for x in own]) for own in lists]
            a = b
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings in UTF-8, joined by a space."""
        if not self.spelled:
            self.spelled = self.vocabulary.tokens()
        return b" ".join(map(self.spelled.__getitem__, memoryview(ids).cast("I")))

    def clear(self) -> None:
        super().clear()
        self.spelled = []


def frequent_words(docs: DataFrame, limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of all texts, at most limit of them: all whose counts reach a bound that leaves no more.

    The bound comes from the numbers of words by size of count, so no task sends the driver candidates of its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out: Counter = Counter()
            counts = iter([*seen.values(), 0])
            n = next(counts)
            for w in words("\n".join(seen)):
                if w == "\n":
                    n = next(counts)
                elif len(w) <= WORD_CHARS:
                    out[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.string()), pa.array(out.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    seen.update(chunks(t))
                    if len(seen) > COUNT_WORDS:
                        yield flush()
        yield flush()

    counts, path = stash(docs.select("text").mapInArrow(trimmed(count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").withColumn("size", F.floor(16 * F.log2("n"))), "words")
    least, held = None, 0
    for r in counts.groupBy("size").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("size")).collect():
        held += r["c"]
        if held > limit:
            break
        least = r["size"]
    chosen = counts.where(F.col("size") >= least) if least is not None else counts.where("false")
    if least is None and held:
        # Even the most frequent size has more words than the lexicon: about half as many of them as it takes, by their hashes.
        top = counts.agg(F.max("size")).first()[0]
        chosen = counts.where((F.col("size") == top) & (F.pmod(F.xxhash64("word"), F.lit(-(-2 * held // max(1, limit)))) == 0)) if limit else chosen
    found = sorted(r["word"] for r in chosen.select("word").collect())
    discard(docs.sparkSession, path)
    return found


class Sent(NamedTuple):
    id: str
    data: object


_LATEST: dict = {}


class Codec:
    """What tasks need to encode, sent to each executor once: the vocabulary and a compiled lexicon, both of bounded size."""

    def __init__(self, spark: SparkSession, path: str, lexicon_words: list[str]):
        vocabulary = Vocabulary(path)
        merged = Encoder(vocabulary).merged([w for w in sorted(set(lexicon_words)) if w])
        entries = {w.encode(): list(struct.unpack(f"<{len(ids) // 4}I", ids)) for w, ids in merged.items()}
        self.width = 2 if vocabulary.size <= 1 << 16 else 4
        self._sent = Sent(uuid.uuid4().hex, spark.sparkContext.broadcast((vocabulary, compile_lexicon(entries))))

    def encoder(self) -> Encoder:
        """The encoder of this process; what it has looked up serves the tasks that follow."""
        if _LATEST.get("of") != self._sent.id:
            vocabulary, block = self._sent.data.value
            _LATEST.update(of=self._sent.id, encoder=Encoder(vocabulary, Lexicon(block)))
        return _LATEST["encoder"]


def codec(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS) -> Codec:
    """A codec whose lexicon holds the corpus's most frequent words."""
    return Codec(docs.sparkSession, path, frequent_words(docs, lexicon_words))


def plain_codec(spark: SparkSession, path: str) -> Codec:
    """A codec whose lexicon holds the words that are tokens by themselves; needs no look at the corpus."""
    end = "</w>"
    whole = [w.removesuffix(end) for w in Vocabulary(path).ids if w.endswith(end) and w.removesuffix(end).isascii() and w.removesuffix(end).isalpha()]
    return Codec(spark, path, whole)


def encode(docs: DataFrame, c: Codec) -> DataFrame:
    """doc_id and ids: an array of token ids per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = c.encoder()
        for batch in batches:
            got = e.encode_all(batch.column(1).to_pylist())
            offsets = pa.array([0, *_sums(len(x) // 4 for x in got)], pa.int32())
            values = pa.Array.from_buffers(pa.int32(), sum(map(len, got)) // 4, [None, pa.py_buffer(b"".join(got))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def _sums(values) -> Iterator[int]:
    total = 0
    for v in values:
        total += v
        yield total


def decode(encoded: DataFrame, c: Codec) -> DataFrame:
    """doc_id and text: the decoded string of an array column ids (null ids: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = c.encoder()
        for batch in batches:
            texts = [e.decode(struct.pack(f"<{len(x)}I", *x)).decode() if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def report(docs: DataFrame, path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Digests of the ids and of the decoded text per document; both are made and dropped inside the task."""
    c = codec(docs, path, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = c.encoder()
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in e.encode_all(batch.column(1).to_pylist()):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(e.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
