"""The plain tables as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import body, header

TITLE = "Conversation "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_title() -> Column:
    return F.concat(F.lit(TITLE), F.col("conv_id").cast("string"))


def turn_block() -> Column:
    """A turn as a block: the system's are paragraphs, others utterances by their role."""
    own = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-t"), F.col("turn").cast("string"))
    said = body.text(F.col("text"))
    none = F.lit(None).cast("string")
    system = F.col("role") == "system"
    return F.struct(F.when(system, "p").otherwise("u").alias("kind"), own.alias("id"), F.when(system, none).otherwise(F.col("role")).alias("who"), said.alias("inline")).cast(body.BLOCK)


def conversation_blocks(conversations: DataFrame) -> DataFrame:
    """doc_key, block_pos, block."""
    return conversations.select(F.col("conv_id").cast("string").alias("doc_key"), F.col("turn").alias("block_pos"), turn_block().alias("block"))


def conversation_documents(conversations: DataFrame) -> DataFrame:
    """A document for each conversation, its cast the roles but the system's: one shuffle."""
    speaker = F.when(F.col("role") != "system", F.col("role"))
    rows = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn_block().alias("block")))).alias("s"), F.array_sort(F.collect_set(speaker)).alias("cast"))
    head = header.header(header.file_desc(conversation_title()), header.profile_desc(speakers=F.col("cast")))
    return rows.select(F.col("conv_id").cast("string").alias("doc_key"), head.alias("header"), F.col("s.block").alias("blocks"))


def text_documents(documents: DataFrame) -> DataFrame:
    """A document for each text: its source the series, its language listed, a paragraph for
    each line that isn't blank."""
    from ..functions.text import is_blank

    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~is_blank(x))
    paragraphs = F.transform(lines, lambda x: F.struct(F.lit("p").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("who"), body.text(x).alias("inline")))
    languages = F.array_compact(F.array(header.language_tag(F.col("lang"))["value"]))
    head = header.header(header.file_desc(F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.col("source")), header.profile_desc(languages=languages))
    return documents.select(F.col("doc_id").cast("string").alias("doc_key"), head.alias("header"), paragraphs.cast(body.BLOCKS).alias("blocks"))
