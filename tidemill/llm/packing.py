"""Packing by concatenate and cut.

All documents' ids, each document's followed by an end mark, form one long sequence that fixed windows cut. The first pass
encodes each text once, writes the ids to the shared folder and notes how many ids its partition held before the document;
prefix sums over the partitions' totals (one number a partition) then give every document its place in the long sequence. The
second pass reads the written ids, task by task and without a shuffle, and cuts them where windows end; a document that
crosses a boundary leaves one piece on either side. Only the very last sequence needs padding.

The ids are written once, so both passes agree even where a lost executor makes Spark read the texts again.

Defined results: null text is empty and packs as its end mark alone; an empty table gives no pieces; repeated rows are packed
each, as documents of their own; a document of any length spans as many sequences as it needs; extra columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import maybe_broadcast, stash, trimmed

WINDOW = 2048
END_ID = 1
#: Partition totals that may be broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 500_000
PIECES = "doc_id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def encoded(docs: DataFrame, c: bpe.Codec, end_id: int = END_ID) -> DataFrame:
    """part, before, doc_id, n, ids: per document its ids and the number of ids before it in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, before = c.encoder(), TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            starts, sizes, ids = [], [], []
            for own in e.encode_all(batch.column(1).to_pylist()):
                raw = own + end
                ids.append(np.frombuffer(raw, "<u4").astype("<u2").tobytes() if c.width == 2 else raw)
                starts.append(before)
                sizes.append(len(raw) // 4)
                before += sizes[-1]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["part", "before", "doc_id", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), f"part int, before bigint, doc_id {dict(docs.dtypes)['doc_id']}, n bigint, ids binary")


def pack(docs: DataFrame, c: bpe.Codec, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the piece's ids themselves, little-endian."""
    ids, _ = stash(encoded(docs, c, end_id), "token-ids")
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    base = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    base, _ = stash(base, "bases")
    placed = ids.join(maybe_broadcast(base, BROADCAST_ROWS), "part").select("doc_id", (F.col("base") + F.col("before")).alias("at"), "ids")
    kind = f"<u{c.width}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows = [], []
            for k, (at, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = np.frombuffer(raw, kind).astype("<u4")
                a = 0
                while a < len(own):
                    b = min(len(own), a + window - (at + a) % window)
                    piece = own[a:b].tobytes()
                    of.append(k)
                    rows.append((a, b - a, zlib.crc32(piece), len(own), (at + a) // window, (at + a) % window, piece))
                    a = b
            columns = list(zip(*rows, strict=True)) or [()] * 7
            data = [batch.column(0).take(pa.array(of, pa.int64())), *[pa.array(x, pa.int64()) for x in columns[:6]]]
            if with_ids:
                data.append(pa.array(columns[6], pa.binary()))
            yield pa.RecordBatch.from_arrays(data, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(data)])

    return placed.mapInArrow(trimmed(cut), PIECES.format(dict(docs.dtypes)["doc_id"]) + (", ids binary" if with_ids else ""))
