"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, circulant, jaccard, media, negatives, search, secrets, sst, surrogates, templates, toxicity, unigram, warc
from .common import table

#: Key of the surrogates that the registered queries make.  A deployment brings its own.
KEY = "registered queries"


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_media_columns(spark, sf_dir):
    return media.digest_media(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark, sf_dir):
    return jaccard.link_documents(table(spark, sf_dir, "documents"))


def op3_template_leaks(spark, sf_dir):
    return templates.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_byte_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.digest_ids(bpe.encode_decode(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), pattern(), keep=["doc_id"]))


def op5_surrogates(spark, sf_dir):
    return surrogates.surrogate_documents(table(spark, sf_dir, "documents"), KEY)


def op6_warc_segments(spark, sf_dir):
    return warc.archive_pages(spark, table(spark, sf_dir, "pages"))


def op7_toxicity(spark, sf_dir):
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark, sf_dir):
    return secrets.digest_secrets(table(spark, sf_dir, "documents"))


def op9_token_shards(spark, sf_dir):
    return sst.token_shards(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.token_counts(docs, vocabulary("byte_bpe_multi_50k.tiktoken"), pattern()).drop("text")


def op11_circulant_minhash(spark, sf_dir):
    return circulant.near_duplicates(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark, sf_dir):
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_media_columns,
        op2_ngram_jaccard,
        op3_template_leaks,
        op4_byte_bpe,
        op5_surrogates,
        op6_warc_segments,
        op7_toxicity,
        op8_secret_scan,
        op9_token_shards,
        op10_token_counts,
        op11_circulant_minhash,
        op12_ranked_search,
        op13_hard_negatives,
    )
}
ORACLE_SQL = {
    "op2_ngram_jaccard": jaccard.ORACLE,
    "op8_secret_scan": secrets.ORACLE,
    "op11_circulant_minhash": circulant.ORACLE,
    "op12_ranked_search": search.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
