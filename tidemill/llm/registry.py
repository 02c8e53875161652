"""The queries of this package and the SQL that states the same results."""

from __future__ import annotations

import public_tokenizers

from . import bpe, embedding_dedup, jaccard, language_id, packing, quality_classifier, quality_rules, secrets, url_filter, warc
from .common import table


def op1_quality_classifier(spark, sf_dir):
    return quality_classifier.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark, sf_dir):
    return embedding_dedup.join(table(spark, sf_dir, "embeddings"))


def op3_url_filters(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_ngram_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"), n=3, percent=90)


#: The tokenizer file; a parameter of the operators.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark, sf_dir):
    return bpe.report(table(spark, sf_dir, "documents"), WORD_BPE)


def op6_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, bpe.plain_codec(spark, WORD_BPE))


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op8_secret_scans(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_classifier, op2_embedding_dedup, op3_url_filters, op4_ngram_jaccard, op5_bpe, op6_packing, op7_language_id, op8_secret_scans, op9_quality_rules, op10_warc)}


def oracle_sql() -> dict:
    return {"op2_embedding_dedup": embedding_dedup.ORACLE_SQL, "op4_ngram_jaccard": jaccard.oracle_sql(3, 90), "op3_url_filters": url_filter.ORACLE_SQL, "op9_quality_rules": quality_rules.ORACLE_SQL, "op10_warc": warc.ORACLE_SQL}
