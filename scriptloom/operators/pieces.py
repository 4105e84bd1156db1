"""Documents written from long tokens, piece by piece: none is ever one row or one array.

A piece is what ends with a tag: markup without its last ``>``, which the text sink puts between
pieces and behind the last.  So a folder for each document has files whose bytes are its canonical
markup, and ``streaming.pull.file_blocks`` reads them the same way.

Rows: headers (doc_key, header); blocks (doc_key, block_pos, kind, id, who); tokens as of
``documents.tokens_long``.  Blocks without a header are left out, and tokens without a block; a
document without blocks has an empty body.  Keys mustn't be null, and become names of folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import xml
from ..functions.text import IN_TEXT, escape

_LAST = (1 << 63) - 1


def token_markup(kind: Column, text: Column, rend: Column, dur: Column, type_: Column, hollow: Column) -> Column:
    """A token's own markup; an emphasis's start tag, closed in itself if it is hollow."""
    pause = F.concat(F.lit("<pause"), xml.attribute("dur", dur), xml.attribute("type", type_), F.lit("/>"))
    hi = F.concat(F.lit("<hi"), xml.attribute("rend", rend), F.when(hollow, "/>").otherwise(">"))
    return F.when(kind == "text", escape(text, IN_TEXT)).when(kind == "pause", pause).otherwise(hi)


def markup_rows(headers: DataFrame, blocks: DataFrame, tokens: DataFrame) -> DataFrame:
    """doc_key, block_pos, tok_pos, markup: a document's markup in the order of the places, a
    row for each token and tag.  What ends after a token is known from the next one's depth, by a
    window over its block."""
    order = Window.partitionBy("doc_key", "block_pos").orderBy("tok_pos")
    after = F.coalesce(F.lead("depth").over(order), F.lit(0))
    rows = tokens.withColumn("after", after).withColumn("hollow", (F.col("kind") == "hi") & (F.col("after") <= F.col("depth")))
    own = token_markup(*(F.col(c) for c in ("kind", "text", "rend", "dur", "type", "hollow")))
    opened = F.col("depth") + F.when((F.col("kind") == "hi") & ~F.col("hollow"), 1).otherwise(0)
    rows = rows.select("doc_key", "block_pos", "tok_pos", F.concat(own, F.repeat(F.lit("</hi>"), opened - F.col("after"))).alias("markup"))

    full = tokens.groupBy("doc_key", "block_pos").agg(F.max((F.col("kind") != "text") | (F.col("text") != "")).alias("full"))
    ends = blocks.join(full, ["doc_key", "block_pos"], "left").withColumn("full", F.coalesce("full", F.lit(False)))
    who = F.when(F.col("kind") == "u", xml.attribute("who", F.col("who"))).otherwise("")
    start = F.concat(F.lit("<"), "kind", xml.attribute("xml:id", F.col("id")), who, F.when(F.col("full"), ">").otherwise("/>"))
    starts = ends.select("doc_key", "block_pos", F.lit(-1).cast("long").alias("tok_pos"), start.alias("markup"))
    stops = ends.where("full").select("doc_key", "block_pos", F.lit(_LAST).alias("tok_pos"), F.concat(F.lit("</"), "kind", F.lit(">")).alias("markup"))
    inside = rows.unionByName(starts).unionByName(stops).where("markup <> ''")

    some = blocks.select("doc_key").distinct().withColumn("some", F.lit(True))
    heads = headers.join(some, "doc_key", "left")
    head = F.concat(F.lit("<TEI>"), xml.header_xml(F.col("header")), F.lit("<text>"), F.when(F.col("some"), "<body>").otherwise("<body/>"))
    tail = F.concat(F.when(F.col("some"), "</body>").otherwise(""), F.lit("</text></TEI>"))
    frame = heads.select("doc_key", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("block_pos"), head.alias("markup")), F.struct(F.lit(_LAST).alias("block_pos"), tail.alias("markup")))).alias("f"))
    return inside.join(headers.select("doc_key"), "doc_key", "left_semi").unionByName(frame.select("doc_key", "f.block_pos", F.lit(-1).cast("long").alias("tok_pos"), "f.markup"))


def markup_pieces(markup: DataFrame) -> DataFrame:
    """doc_key, piece_pos, piece: rows of markup joined until each ends with a tag, without that
    tag's ``>``.  One shuffle by doc_key; texts between two tags are joined, and no more."""
    order = Window.partitionBy("doc_key").orderBy("block_pos", "tok_pos").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.count(F.when(F.endswith("markup", F.lit(">")), 1)).over(order), F.lit(0))
    rows = markup.withColumn("piece_pos", ended).groupBy("doc_key", "piece_pos")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_pos", "tok_pos", "markup"))), lambda x: x["markup"]), "")
    return rows.agg(whole.alias("piece")).select("doc_key", "piece_pos", F.expr("left(piece, length(piece) - 1)").alias("piece"))


def write_pieces(pieces: DataFrame, path: str) -> None:
    """A folder ``doc_key=...`` for each document, with one file of its markup.  Tasks stream
    sorted rows, so a document may be larger than memory."""
    rows = pieces.repartition("doc_key").sortWithinPartitions("doc_key", "piece_pos")
    rows.select("doc_key", "piece").write.mode("error").partitionBy("doc_key").option("lineSep", ">").text(path)
