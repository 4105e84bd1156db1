"""From raw documents to token ids, in five stages over the whole corpus.

Each stage is written to the shared folder and read again, so a later stage never repeats an
earlier one, and a lost executor costs the tasks it ran.  Once a stage is written, what its
operators saved and the stage before go; only the last one's rows stay, with their ids.

Null and empty texts score by the bias alone, are copies of nothing, leak nothing, stay as
they are and have no ids.  Of repeated rows one stays, unless their text is null or empty.
Ties between copies go to the least identifier, then the least digest.  All columns of
``documents`` pass through all stages but the last, whatever their names; an empty table gives
no rows, and without labels nothing is rejected as toxic.

Stages lower the session's Arrow batches (``small_batches``), as each hands long texts to
Python workers beside executors that the stages before have filled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm import bpe, catalog, jaccard, surrogates, templates, toxicity
from scriptloom.llm.common import Workspace, small_batches, table, unused

#: Pieces that the last stage remembers in a worker: few, as the stages before have grown the
#: executors' heaps.
CACHED = 200_000


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns of these names, which an operator is about to add, renamed;
    and what they were called."""
    clash = [c for c in docs.columns if c.lower() in names]
    kept = dict(zip(unused(docs.columns, *(f"own_{c}" for c in clash)), clash, strict=True))
    for new, old in kept.items():
        docs = docs.withColumnRenamed(old, new)
    return docs, kept


def restored(docs: DataFrame, columns: list[str], kept: dict[str, str]) -> DataFrame:
    """The columns of before, in their order, under their names."""
    now = {old: new for new, old in kept.items()}
    return docs.select(*(F.col(f"`{now.get(c, c)}`").alias(c) for c in columns))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of half or more go."""
    small_batches(spark)
    counts, weights = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    own, kept = aside(docs, "score")
    return restored(toxicity.score(own, counts, weights).where("score < 0.5"), docs.columns, kept)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    small_batches(spark)
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    small_batches(spark)
    return templates.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data make way for surrogates; lengths are counted anew."""
    own, kept = aside(docs, "entities")
    out = surrogates.replace_entities(own, catalog.KEY).drop("entities")
    return restored(out.withColumn("n_chars", F.length("text").cast("long")), docs.columns, kept)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary, little-endian 32-bit), with their number, and digests of them and of
    what they decode to."""
    small_batches(spark)
    ranks = catalog.vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode_decode(docs, ranks, catalog.pattern(), keep=["doc_id"], cached=CACHED)
    kept = bpe.digest_ids(coded.withColumn("token_ids", F.col("ids")))
    return kept.withColumnRenamed("token_ids", "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", drop_leaks),
    ("pii_surrogates", replace_personal_data),
    ("byte_bpe", encode),
]

#: SQL expresses neither the trained score nor the keyed cipher; the tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``."""
    work = Workspace(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with Workspace(spark, "stage").temporary():
            docs = work.save(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)
        before = name
    return docs
