"""Documents as rows: ``doc_key``, ``header``, ``blocks``; and their long forms.

The long form has a row for each block or token with its place, so order never depends on
how rows are stored.  Grouping back is one shuffle by ``doc_key``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import body, header, xml
from ..functions.body import BLOCKS
from ..functions.header import HEADER

#: Documents whose trees are held at once.
PARSED_TOGETHER = 200

SCHEMA = f"doc_key string, header {HEADER}, blocks {BLOCKS}"


def from_titles(df: DataFrame, key: Column, title: Column) -> DataFrame:
    """A document with an empty body for each valid title; others have an error and no header."""
    own = header.document_title(title)
    out = df.select(key.cast("string").alias("doc_key"), own.alias("t"))
    return out.select("doc_key", F.when(F.col("t.error").isNull(), header.header(header.file_desc(F.col("t.value")))).alias("header"), body.empty_body().alias("blocks"), F.col("t.error").alias("error"))


def title_of(df: DataFrame) -> Column:
    return df["header"]["fileDesc"]["title"]


def blocks_long(docs: DataFrame) -> DataFrame:
    """doc_key, block_pos, kind, id, who, inline."""
    return docs.select("doc_key", F.posexplode("blocks").alias("block_pos", "b")).select("doc_key", F.col("block_pos").cast("bigint").alias("block_pos"), "b.kind", "b.id", "b.who", "b.inline")


def tokens_long(docs: DataFrame) -> DataFrame:
    """doc_key, block_pos, tok_pos, depth, kind, text, rend, dur, type."""
    rows = blocks_long(docs).select("doc_key", "block_pos", F.posexplode("inline").alias("tok_pos", "t"))
    return rows.select("doc_key", "block_pos", F.col("tok_pos").cast("bigint").alias("tok_pos"), "t.*")


def from_blocks(blocks: DataFrame) -> DataFrame:
    """doc_key and its blocks in order of ``block_pos``, from rows of ``block``."""
    rows = blocks.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("block_pos", "block"))).alias("s"))
    return rows.select("doc_key", F.col("s.block").alias("blocks"))


def compose(headers: DataFrame, bodies: DataFrame) -> DataFrame:
    """Documents from headers (doc_key, header) and bodies (doc_key, blocks); a document
    without a body has an empty one."""
    return headers.join(bodies, "doc_key", "left").select("doc_key", "header", F.coalesce("blocks", body.empty_body()).alias("blocks"))


def extend_bodies(first: DataFrame, second: DataFrame) -> DataFrame:
    """Long blocks of both, the second's after the first's; nothing is dropped."""
    ends = first.groupBy("doc_key").agg((F.max("block_pos") + 1).alias("offset"))
    moved = second.join(ends, "doc_key", "left").withColumn("block_pos", F.col("block_pos") + F.coalesce("offset", F.lit(0))).drop("offset")
    return first.unionByName(moved)


def emitted(rows: DataFrame) -> DataFrame:
    """doc_key, xml, error from markup (doc_key, xml) that may have forbidden characters.
    Each step is a projection over the one before, so markup and check are made once."""
    rows = rows.select("doc_key", "xml", xml.emission_error(F.col("xml")).alias("error"))
    return rows.select("doc_key", F.when(F.col("error").isNull(), F.col("xml")).alias("xml"), "error")


def emit(docs: DataFrame) -> DataFrame:
    """doc_key, xml, error: canonical XML of each document; no shuffle."""
    return emitted(docs.select("doc_key", xml.blocks_document(F.col("header"), F.col("blocks")).alias("xml")))


def emit_long(blocks: DataFrame, headers: DataFrame) -> DataFrame:
    """The same from long blocks (doc_key, block_pos, markup): markup is made before the one
    shuffle that puts it in order."""
    bodies = blocks.groupBy("doc_key").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block_pos", "markup")))["markup"], "").alias("markup"))
    rows = headers.join(bodies, "doc_key", "left").withColumn("markup", F.coalesce("markup", F.lit("")))
    return emitted(rows.select("doc_key", xml.document_xml(F.col("header"), F.col("markup"), F.col("markup") == "").alias("xml")))


def parse(df: DataFrame, key: str, text: str, form: str = "xml", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_key, header, blocks, error from a column of XML (or, by ``form``, JSON or MessagePack) documents,
    and the columns in ``keep`` as they are, so that nothing has to be joined to them again.

    A plan node of its own over Arrow batches: what follows, higher-order functions included,
    is never drawn into the parser, and it runs once a row."""
    from ..functions.parse import as_arrow, guarded, read_json, read_msgpack, read_xml

    read = {"xml": read_xml, "json": read_json, "msgpack": read_msgpack}[form]
    rows = df.select(F.col(key).cast("string").alias("doc_key"), F.col(text).alias("__text"), *keep)
    schema = T.StructType([*T.StructType.fromDDL(f"{SCHEMA}, error string").fields, *(df.schema[c] for c in keep)])
    types = to_arrow_schema(schema)
    made = pa.struct([types.field(n) for n in ("header", "blocks", "error")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PARSED_TOGETHER):
                own = batch.slice(lo, PARSED_TOGETHER)
                found = as_arrow([guarded(read, x) for x in own.column("__text").to_pylist()], made)
                yield pa.RecordBatch.from_arrays([own.column("doc_key"), *found.flatten(), *(own.column(c) for c in keep)], names=types.names)

    return rows.mapInArrow(run, schema)


def parse_json(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``parse`` of JSON documents.  Those that the library has written are decoded by built-in
    expressions (``functions.variant``); the Arrow node gets the others alone, to read them or to
    say what is wrong with them."""
    from ..functions.variant import is_own, parsed

    d, own, value = (f"__{n}" for n in ("decoded", "own", "text"))
    # Behind a generator what was decoded is a column, and not put in wherever it is named.
    rows = df.select(F.col(key).cast("string").alias("doc_key"), F.col(text).alias(value), F.explode(F.array(parsed(F.col(text)))).alias(d), *keep)
    rows = rows.withColumn(own, is_own(F.col(f"{d}.header"), F.col(f"{d}.blocks"), F.col(value)))
    good = rows.where(own).select("doc_key", f"{d}.header", f"{d}.blocks", F.lit(None).cast("string").alias("error"), *keep)
    return good.unionByName(parse(rows.where(~F.col(own)), "doc_key", value, "json", keep))


def to_msgpack(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_key, packed, and the columns in ``keep``: each document in MessagePack, by built-in
    expressions; null without a header."""
    from ..functions.msgpack import document_msgpack

    return docs.select("doc_key", F.when(F.col("header").isNotNull(), document_msgpack(F.col("header"), F.col("blocks"))).alias("packed"), *keep)


def error_of(kind: str, message: Column) -> Column:
    """Any operator's error in one form: kind and message."""
    return F.when(message.isNotNull(), F.struct(F.lit(kind).alias("kind"), message.alias("message")))
