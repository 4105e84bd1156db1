"""JSON documents decoded by built-in expressions, through Spark's Variant.

``decoded`` takes documents as ``functions.json`` writes them, with emphases up to ``DEPTH`` deep.
Whether a payload is such a one is decided by writing what was decoded again: only where that is
the payload, letter for letter, is the result given; all else, good or bad, is null and for
``functions.parse`` to read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .body import BLOCKS, TOKENS
from .header import CHANGE, ENCODING, HEADER, PROFILE, REVISION, SYSTEM, xml_id
from .json import document_json
from .text import is_blank, optional

#: Emphases within each other that are decoded here.
DEPTH = 3


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _valid(value: Column) -> Column:
    """A text that is neither blank nor in need of trimming, or null."""
    return F.when(optional(value) == value, value)


def _tokens(items: Column, depth: int) -> Column:
    """Tokens of an array of Variants; what is neither a text, a pause nor an emphasis that is
    shallow enough is null, which is never written as it was read."""
    none = F.lit(None).cast("string")

    def one(v: Column) -> Column:
        is_text = F.schema_of_variant(v) == "STRING"
        children = _get(v, "$['$value']", "array<variant>")
        token = lambda kind, **rest: F.array(F.struct(F.lit(depth).alias("depth"), F.lit(kind).alias("kind"), *(rest.get(n, none).alias(n) for n in ("text", "rend", "dur", "type")))).cast(TOKENS)
        pause = token("pause", dur=_get(v, "$['@dur']"), type=_get(v, "$['@type']"))
        hi = F.lit(None).cast(TOKENS)
        if depth < DEPTH:
            hi = F.when(F.size(children) > 0, F.concat(token("hi", rend=_get(v, "$.rend")), _tokens(children, depth + 1)))
        return F.when(is_text, token("text", text=v.cast("string"))).when(children.isNull(), pause).otherwise(hi)

    return F.flatten(F.transform(items, one))


def _block(v: Column) -> Column:
    def of(kind: str) -> Column:
        own = _get(v, f"$.{kind}", "variant")
        identifier = _get(own, "$['@xml:id']")
        who = _valid(_get(own, "$['@who']")) if kind == "u" else F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), F.when(xml_id(identifier)["error"].isNull(), identifier).alias("id"), who.alias("who"), _tokens(_get(own, "$['$value']", "array<variant>"), 0).alias("inline"))

    return F.when(_get(v, "$.p", "variant").isNotNull(), of("p")).when(_get(v, "$.u", "variant").isNotNull(), of("u"))


def _header(v: Column) -> Column:
    at = lambda name: _get(v, f"$.teiHeader.{name}", "variant")
    file, profile, encoding, revision = (at(n) for n in ("fileDesc", "profileDesc", "encodingDesc", "revisionDesc"))
    listed = lambda part, name, one, kind: F.coalesce(F.transform(_get(part, f"$.{name}", "array<variant>"), one), F.array()).cast(f"array<{kind}>").alias(name)
    words = lambda name: listed(profile, name, lambda s: _valid(s.cast("string")), "string")
    system = lambda s: F.struct(_valid(_get(s, "$['@xml:id']")).alias("id"), _get(s, "$.desc").alias("desc"))
    change = lambda c: F.struct(_valid(_get(c, "$['$value']")).alias("description"), _valid(_get(c, "$.resp")).alias("resp"))
    return F.struct(
        F.struct(_valid(_get(file, "$.title")).alias("title"), _get(file, "$.series").alias("series"), _get(file, "$.synopsis").alias("synopsis")).alias("fileDesc"),
        F.when(profile.isNotNull(), F.struct(_get(profile, "$.synopsis").alias("synopsis"), words("speaker"), words("lang"))).cast(PROFILE).alias("profileDesc"),
        F.when(encoding.isNotNull(), F.struct(listed(encoding, "annotationSystem", system, SYSTEM))).cast(ENCODING).alias("encodingDesc"),
        F.when(revision.isNotNull(), F.struct(listed(revision, "change", change, CHANGE))).cast(REVISION).alias("revisionDesc"),
    ).cast(HEADER)


def parsed(payload: Column) -> Column:
    """header and blocks of a payload, whether it is what they say or not."""
    v = F.try_parse_json(payload)
    blocks = F.transform(_get(v, "$.text.body['$value']", "array<variant>"), _block)
    return F.struct(_header(v).alias("header"), blocks.cast(BLOCKS).alias("blocks"))


def is_own(header: Column, blocks: Column, payload: Column) -> Column:
    """Whether the payload is what is written of a valid document of this header and blocks."""

    def hollow(b: Column) -> Column:
        inner = F.transform(b["inline"], lambda t, i: ((t["kind"] == "text") & is_blank(t["text"]) & (t["depth"] > 0)) | ((t["kind"] == "hi") & (F.coalesce(F.get(b["inline"], i + 1)["depth"], F.lit(-1)) <= t["depth"])))
        return F.exists(inner, lambda x: F.coalesce(x, F.lit(True)))

    good = header["fileDesc"]["title"].isNotNull() & blocks.isNotNull() & ~F.exists(blocks, lambda b: b.isNull() | b["inline"].isNull() | hollow(b))
    return F.coalesce(F.when(good, document_json(header, blocks) == payload), F.lit(False))
