"""The corpus pipeline: quality rules, quality classifier, near duplicates, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes as Parquet and reads again as the next
stage's docs. All but the last return the columns of documents, extra ones included, whatever their names; each works on every row
it gets and on whole texts. Empty tables give empty results everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import bpe, jaccard, packing, quality_classifier, quality_rules, secrets
from tidemill.llm.common import stash, sweep, table, written
from tidemill.llm.registry import WORD_BPE


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules accept. Null and empty texts, and all of fewer than 50 words, fail the base rule and go;
    null languages and sources are groups of their own; a measure equal to its limit passes; repeated rows are judged each, so they
    stay or go together; very long texts are measured whole."""
    return quality_rules.keep(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is likelier than not and that aren't likely toxic. Null and empty texts are judged by their
    style and site; exactly even odds keep, so all stay where there are no labels; repeated rows are judged each, and of labels that
    repeat an id the largest counts; null sources and languages are sites of their own; very long texts are read whole."""
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more: that with the smallest doc_id, and of
    rows that share it that with the least digest. Rows without words or without an id are linked with nothing and stay; rows equal
    in id and text are one document; rows that share only the id are documents of their own; very long texts count whole."""
    return jaccard.keep_one(docs, n=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by marks and n_chars brought up to date. Null texts stay null; spans that overlap
    become one mark, named by the first; repeated rows are treated alike; very long texts are scanned whole."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens. Null and empty texts pack as their end mark; repeated rows are packed each; a very
    long text spans as many sequences as it needs; only the last sequence is not full."""
    return packing.pack(docs, bpe.plain_codec(spark, WORD_BPE))


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan), ("packing", pack)]

#: The classifier is fitted, so SQL can't state the rows; a test holds them against plain loops over a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has left behind is removed once its result is written."""
    docs, others = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs, path = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, [p for p in written() if p not in others and p != path])
    return STAGES[-1][1](spark, docs, sf_dir)
