import hashlib
import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemill.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    None, "", " \n\t ", "Hello, World! it's <|endoftext|>x<|startoftext|>", "ΑΣ Σ σς ÉCOLE école ½ x² Ⅷ İstanbul ǅ", "a\x1cb\x85c d", "don't 'sam !'s ''ll 12,345.67", "word " * 3000,
    "x" * 5000, "ab" * 30 + " " + "é" * 200, "日本語テキスト 🙂🙂 test", "Hello, World! it's <|endoftext|>x<|startoftext|>", "<| not special |> __init__ snake_case",
]


def want(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids), LIBRARY.decode(ids, skip_special_tokens=False).encode()


def docs(spark, texts):
    return spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)


@pytest.mark.parametrize("lexicon", [0, 5, 1000])
def test_report_equals_library(spark, lexicon):
    for r in bpe.report(docs(spark, TEXTS), PATH, lexicon).collect():
        ids, text = want(TEXTS[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()), TEXTS[r["doc_id"]]
    assert bpe.report(docs(spark, TEXTS).limit(0), PATH, lexicon).count() == 0


def test_lexicon_where_all_words_are_equally_frequent(spark):
    texts = [" ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400))] * 2
    got = bpe.frequent_words(docs(spark, texts), 100)
    assert 20 <= len(got) <= 100 and bpe.frequent_words(docs(spark, texts), 0) == [] and len(bpe.frequent_words(docs(spark, texts), 1000)) == 400


def test_other_tokenizers_are_refused(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["normalizer"]["normalizers"].pop()
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="splits or merges"):
        bpe.Vocabulary(str(tmp_path / "t.json"))


def test_a_full_cache_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 40)
    e = bpe.Encoder(bpe.Vocabulary(PATH))
    assert e.encode_all(TEXTS * 2) == [want(t)[0] for t in TEXTS] * 2


def test_encode_decode_round(spark):
    c = bpe.codec(docs(spark, TEXTS), PATH, 100)
    for r in bpe.decode(bpe.encode(docs(spark, TEXTS), c), c).collect():
        assert r["text"].encode() == want(TEXTS[r["doc_id"]])[1]


def test_every_character_of_the_first_planes():
    e = bpe.Encoder(bpe.Vocabulary(PATH))
    texts = [f"A{chr(c)}b1" for c in range(0x3000) if chr(c).isprintable() or c < 0xA1]
    known = LIBRARY.encode_batch(texts, add_special_tokens=False)
    assert [t for t, k, got in zip(texts, known, e.encode_all(texts), strict=True) if struct.pack(f"<{len(k.ids)}I", *k.ids) != got] == []


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): [k, k + 1] for k, w in enumerate(["sing", "ring", "singing", "ringing", "s", "zé"])}
    block = bpe.compile_lexicon(words)
    lex = bpe.Lexicon(block)
    import numpy as np

    look = lambda w: lex.ranks_of(np.frombuffer(w, np.uint8)[None])[0]
    assert all(lex.ids(look(w)) == struct.pack("<2I", *ids) for w, ids in words.items())
    assert look(b"singer") == look(b"sin") == look(b"q") == -1
    assert len(lex.finals) < 12  # the suffixes of both words share their states


@pytest.mark.parametrize("window", [7, 2048])
def test_packing(spark, window):
    d = docs(spark, TEXTS)
    rows = packing.pack(d, bpe.plain_codec(spark, PATH), window, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for k, t in enumerate(TEXTS):
        own = sorted(by_doc[k], key=lambda r: r["start"])
        ids = want(t)[0] + struct.pack("<I", 1)
        assert b"".join(bytes(r["ids"]) for r in own) == ids and {r["doc_tokens"] for r in own} == {len(ids) // 4}
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
    total = sum(r["length"] for r in rows)
    assert sorted(by_sequence) == list(range(-(-total // window)))
    for s, own in by_sequence.items():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) == (window if s < max(by_sequence) else total - window * s)
    assert packing.pack(d.limit(0), bpe.plain_codec(spark, PATH)).count() == 0


def test_rows_that_share_an_id_are_packed_each(spark):
    rows = [(7, "one two three", 1, 5), (7, "one two three", 2, 5), (7, "other", 3, 5), (None, "no id", 4, 5), (7, None, 5, 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, start long, part int").repartition(2)
    got = packing.pack(d, bpe.plain_codec(spark, PATH), 4, with_ids=True).collect()
    ids = sorted((r["doc_id"] or 0, r["sequence_id"], r["offset"], bytes(r["ids"])) for r in got)
    assert sum(len(x[3]) // 4 for x in ids) == sum(len(want(r[1])[0]) // 4 + 1 for r in rows)
    stream = b"".join(x[3] for x in sorted(ids, key=lambda x: x[1:3]))
    assert sorted(stream.split(struct.pack("<I", 1))[:-1]) == sorted(want(r[1])[0] for r in rows)
