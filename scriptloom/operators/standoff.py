"""Annotations that stand off: spans between anchors of a document's text, in XML and in line.

A span (doc_key, span_id, type, resp, from, to, ana) goes from one anchor to another.  An anchor is
``#id:offset``: characters of the flattened text of the block with that identifier; ``#id``
alone is the block's start in ``from`` and its end in ``to``.  Spans may cross blocks and
each other.  In XML they are ``<standOff><spanGrp type resp><span xml:id from to ana/>``
behind the text, where parsers of documents pass over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import body, errors
from ..functions.body import TOKENS
from ..functions.parse import ill_formed
from ..functions.pull import pieces_of
from ..functions.spans import unwoven, woven
from ..functions.xml import attribute, element
from .documents import blocks_long

SPANS = "doc_key string, type string, resp string, span_id string, from string, to string, ana string"
ANCHOR = r"^#?(.*?)(?::(-?[0-9]+))?$"
#: Spans sent at once.
SENT = 5_000


def standoff_xml(spans: DataFrame) -> DataFrame:
    """doc_key, markup: a document's spans by group, groups by type and resp, spans by their
    identifiers.  Markup is made before the shuffle."""
    one = F.concat(F.lit("<span"), *(attribute(n, F.col(c)) for n, c in (("xml:id", "span_id"), ("from", "from"), ("to", "to"), ("ana", "ana"))), F.lit("/>"))
    rows = spans.select("doc_key", "type", "resp", F.struct("span_id", one.alias("markup")).alias("s"))
    groups = rows.groupBy("doc_key", "type", "resp").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["markup"]), "").alias("content"))
    groups = groups.select("doc_key", F.struct("type", "resp", element("spanGrp", F.col("content"), F.concat(attribute("type", F.col("type")), attribute("resp", F.col("resp")))).alias("markup")).alias("g"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("g")), lambda g: g["markup"]), "")
    return groups.groupBy("doc_key").agg(element("standOff", whole).alias("markup"))


def with_standoff(xml: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_key, xml of documents (doc_key, xml: canonical) with their spans behind the text."""
    rows = xml.join(standoff_xml(spans), "doc_key", "left")
    end = F.lit("</TEI>")
    grown = F.concat(F.expr(f"left(xml, length(xml) - {len('</TEI>')})"), F.col("markup"), end)
    return rows.select("doc_key", F.coalesce(grown, F.col("xml")).alias("xml"))


def parse_standoff(df: DataFrame, key: str, text: str) -> DataFrame:
    """SPANS and error: a row for each span of documents in XML, as it is met, so memory is
    that of the text.  Attributes that aren't there are null.  A document that isn't well formed
    ends in a row with its error."""
    schema = T.StructType.fromDDL(f"{SPANS}, error string")
    types = to_arrow_schema(schema)
    names = types.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for own, text_ in zip(*batch.columns, strict=True):
                path: list[str] = []
                group: dict = {}
                parser = expat.ParserCreate("utf-8")

                def start(name, a, path=path, group=group, own=own):
                    path.append(name)
                    if path[1:] == ["standOff", "spanGrp"]:
                        group.clear()
                        group.update(a)
                    elif path[1:] == ["standOff", "spanGrp", "span"]:
                        rows.append(dict.fromkeys(names) | {"doc_key": own.as_py(), "type": group.get("type"), "resp": group.get("resp"), "span_id": a.get("xml:id", a.get("id")), "from": a.get("from"), "to": a.get("to"), "ana": a.get("ana")})

                parser.StartElementHandler, parser.EndElementHandler = start, lambda _, path=path: path.pop()
                try:
                    for piece in pieces_of(text_.as_py()):
                        parser.Parse(piece, False)
                        if len(rows) >= SENT:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows.clear()
                    parser.Parse(b"", True)
                except expat.ExpatError as e:
                    rows.append(dict.fromkeys(names) | {"doc_key": own.as_py(), "error": errors.XML + str(ill_formed(e))})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, types)

    return df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def resolved(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """The spans with from_pos, to_pos (their blocks' places), from_at, to_at (offsets there),
    start, stop (offsets in the text of all blocks), and error.

    Where a block starts is a running sum of the lengths before it; anchors meet blocks by an
    equi-join, one for each end."""
    order = Window.partitionBy("doc_key").orderBy("block_pos").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks_long(docs).select("doc_key", "block_pos", "id", F.coalesce(F.length(body.flat_text(F.col("inline"))), F.lit(0)).cast("long").alias("size"))
    blocks = blocks.withColumn("base", F.coalesce(F.sum("size").over(order), F.lit(0))).where("id is not null")
    # Of blocks with the same identifier the first is meant.
    blocks = blocks.groupBy("doc_key", "id").agg(F.min(F.struct("block_pos", "size", "base")).alias("b"))
    out = spans
    for end in ("from", "to"):
        out = out.withColumns({f"{end}_{part}": F.regexp_extract(F.col(end), ANCHOR, k) for k, part in ((1, "id"), (2, "offset"))})
        block = blocks.select("doc_key", F.col("id").alias(f"{end}_id"), F.col("b").alias(f"{end}_block"))
        out = out.join(block, ["doc_key", f"{end}_id"], "left")
        b, given = F.col(f"{end}_block"), F.col(f"{end}_offset").try_cast("bigint")
        at = F.when(F.col(f"{end}_offset") == "", F.lit(0).cast("long") if end == "from" else b["size"]).otherwise(given)
        out = out.withColumns({f"{end}_pos": b["block_pos"], f"{end}_at": at, f"{end}_size": b["size"], "start" if end == "from" else "stop": b["base"] + at})
    outside = (F.col("from_at") < 0) | (F.col("from_at") > F.col("from_size")) | (F.col("to_at") < 0) | (F.col("to_at") > F.col("to_size"))
    error = F.when(F.col("from").isNull() | F.col("to").isNull(), "span without start or end").when(F.col("from_pos").isNull() | F.col("to_pos").isNull(), "unknown block").when(F.coalesce(outside, F.lit(True)), "outside the block").when(F.col("start") >= F.col("stop"), "empty span")
    return out.select(*spans.columns, "from_pos", "from_at", "to_pos", "to_at", "start", "stop", error.alias("error"))


def pieces(spans: DataFrame) -> DataFrame:
    """A row for each block that a resolved span without error touches: the span's columns,
    block_pos, and lo, hi (hi null: to the block's end)."""
    rows = spans.where("error is null").withColumn("block_pos", F.explode(F.sequence("from_pos", "to_pos")))
    lo = F.when(F.col("block_pos") == F.col("from_pos"), F.col("from_at")).otherwise(F.lit(0).cast("long"))
    return rows.withColumns({"lo": lo, "hi": F.when(F.col("block_pos") == F.col("to_pos"), F.col("to_at"))})


def texts(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_key, span_id, text: what resolved spans mark, over all blocks that they touch."""
    blocks = blocks_long(docs).select("doc_key", "block_pos", body.flat_text(F.col("inline")).alias("text"))
    cut = pieces(spans).select("doc_key", "span_id", "block_pos", "lo", "hi").join(blocks, ["doc_key", "block_pos"])
    part = F.substring("text", F.col("lo").cast("int") + 1, F.coalesce(F.col("hi"), F.length("text")).cast("int") - F.col("lo").cast("int"))
    rows = cut.select("doc_key", "span_id", F.struct("block_pos", part.alias("part")).alias("s"))
    return rows.groupBy("doc_key", "span_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["part"]), "").alias("text"))


def _over_tokens(rows: DataFrame, add: str, change) -> DataFrame:
    """One Arrow node: ``inline`` and the columns of ``add`` made anew from each row."""
    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("inline", "spans")] + T.StructType.fromDDL(f"inline {TOKENS}{add}").fields)
    types = to_arrow_schema(schema)
    made = types.names[len(rows.columns) - ("spans" in rows.columns) - 1 :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inline = batch.column("inline").to_pylist()
            spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * len(inline)
            new = [change(i or [], s or []) for i, s in zip(inline, spans, strict=True)]
            kept = [batch.column(n) for n in types.names if n not in made]
            yield pa.RecordBatch.from_arrays(kept + [pa.array([x[k] for x in new], types.field(n).type) for k, n in enumerate(made)], schema=types)

    return rows.mapInArrow(run, schema)


def weave(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Long blocks (doc_key, block_pos, kind, id, who, inline) with resolved spans as emphases
    whose ``rend`` is ``#span_id``; the text is unchanged.  One shuffle joins spans to blocks."""
    marks = pieces(spans).select("doc_key", "block_pos", F.struct("lo", "hi", F.concat(F.lit("#"), "span_id").alias("rend")).alias("s"))
    marks = marks.groupBy("doc_key", "block_pos").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    rows = blocks_long(docs).join(marks, ["doc_key", "block_pos"], "left").select("doc_key", "block_pos", "kind", "id", "who", "inline", "spans")
    return _over_tokens(rows, "", lambda inline, own: (woven(inline, [(s["lo"], 1 << 60 if s["hi"] is None else s["hi"], s["rend"]) for s in own]),))


def unweave(blocks: DataFrame) -> DataFrame:
    """Long blocks without emphases, and ``marks``: start, stop, rend of those that were there."""
    rows = blocks.select("doc_key", "block_pos", "kind", "id", "who", "inline")

    def change(inline: list[dict], _) -> tuple:
        plain, found = unwoven(inline)
        return plain, [dict(zip(("start", "stop", "rend"), s, strict=True)) for s in found]

    return _over_tokens(rows, ", marks array<struct<start:bigint,stop:bigint,rend:string>>", change)
