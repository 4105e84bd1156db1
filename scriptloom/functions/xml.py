"""Documents as canonical XML, and titles as markup, by built-in expressions.

Canonical: no declaration, no white space between elements, no namespace; empty elements are
closed in themselves; parts come in the model's order; ``xml:id`` comes before ``who``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import errors
from .header import document_title, encoding_is_empty, profile_is_empty, revision_is_empty
from .text import IN_ATTRIBUTE, IN_TEXT, checked, escape, forbidden_error


def serialize_title(title: Column) -> Column:
    return F.concat(F.lit("<title>"), escape(title), F.lit("</title>"))


def title_markup(raw: Column) -> Column:
    """Validates and trims a raw title first: value and error."""
    own = document_title(raw)
    return checked(serialize_title(own["value"]), own["error"])


def element(name: str | Column, content: Column, attributes: Column | None = None, empty: Column | None = None) -> Column:
    """``empty`` says when there is no content, so that the content stands in the expression
    once, however deep elements nest; without it there always is some."""
    name = F.lit(name) if isinstance(name, str) else name
    start = F.concat(F.lit("<"), name) if attributes is None else F.concat(F.lit("<"), name, attributes)
    whole = F.concat(start, F.lit(">"), content, F.lit("</"), name, F.lit(">"))
    return whole if empty is None else F.when(empty, F.concat(start, F.lit("/>"))).otherwise(whole)


def attribute(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f' {name}="'), escape(value, IN_ATTRIBUTE), F.lit('"')), F.lit(""))


def _leaf(name: str, value: Column) -> Column:
    """Nothing for null."""
    return F.when(value.isNotNull(), element(name, escape(value, IN_TEXT), empty=value == "")).otherwise("")


def _each(items: Column, one) -> Column:
    return F.array_join(F.transform(items, one), "")


def file_xml(f: Column) -> Column:
    return element("fileDesc", F.concat(_leaf("title", f["title"]), _leaf("series", f["series"]), _leaf("synopsis", f["synopsis"])))


def profile_xml(p: Column) -> Column:
    content = F.concat(_leaf("synopsis", p["synopsis"]), _each(p["speaker"], lambda s: _leaf("speaker", s)), _each(p["lang"], lambda s: _leaf("lang", s)))
    return element("profileDesc", content, empty=profile_is_empty(p))


def encoding_xml(e: Column) -> Column:
    systems = _each(e["annotationSystem"], lambda s: element("annotationSystem", _leaf("desc", s["desc"]), attribute("xml:id", s["id"]), s["desc"].isNull()))
    return element("encodingDesc", systems, empty=encoding_is_empty(e))


def revision_xml(r: Column) -> Column:
    changes = _each(r["change"], lambda c: element("change", F.concat(escape(c["description"], IN_TEXT), _leaf("resp", c["resp"]))))
    return element("revisionDesc", changes, empty=revision_is_empty(r))


def header_xml(h: Column) -> Column:
    section = lambda name, xml: F.when(h[name].isNotNull(), xml(h[name])).otherwise("")
    return element("teiHeader", F.concat(file_xml(h["fileDesc"]), section("profileDesc", profile_xml), section("encodingDesc", encoding_xml), section("revisionDesc", revision_xml)))


def inline_xml(tokens: Column) -> Column:
    """Each token with the end tags of the emphases that end after it."""

    def one(t: Column, i: Column) -> Column:
        after = F.coalesce(F.get(tokens, i + 1)["depth"], F.lit(0))
        hollow = (t["kind"] == "hi") & (after <= t["depth"])
        opened = t["depth"] + F.when((t["kind"] == "hi") & ~hollow, 1).otherwise(0)
        own = (
            F.when(t["kind"] == "text", escape(t["text"], IN_TEXT))
            .when(t["kind"] == "pause", F.concat(F.lit("<pause"), attribute("dur", t["dur"]), attribute("type", t["type"]), F.lit("/>")))
            .otherwise(F.concat(F.lit("<hi"), attribute("rend", t["rend"]), F.when(hollow, "/>").otherwise(">")))
        )
        return F.concat(own, F.repeat(F.lit("</hi>"), opened - after))

    return F.array_join(F.transform(tokens, one), "")


def block_xml(block: Column) -> Column:
    who = F.when(block["kind"] == "u", attribute("who", block["who"])).otherwise("")
    hollow = ~F.exists(block["inline"], lambda t: (t["kind"] != "text") | (t["text"] != ""))
    return element(block["kind"], inline_xml(block["inline"]), F.concat(attribute("xml:id", block["id"]), who), hollow)


def document_xml(header: Column, body: Column, empty: Column) -> Column:
    """``body``: the blocks' markup; ``empty``: there are no blocks."""
    return F.concat(F.lit("<TEI>"), header_xml(header), F.lit("<text>"), element("body", body, empty=empty), F.lit("</text></TEI>"))


def blocks_document(header: Column, blocks: Column) -> Column:
    """A document's XML, not yet checked for forbidden characters."""
    return document_xml(header, _each(blocks, block_xml), F.size(blocks) == 0)


def emission_error(xml: Column) -> Column:
    return F.concat(F.lit(errors.XML), forbidden_error(xml))


def emit_xml(header: Column, blocks: Column) -> Column:
    """A document's canonical XML: value and error.  As an expression by itself it makes the
    markup more than once; over tables use ``operators.documents.emit``."""
    xml = blocks_document(header, blocks)
    return checked(xml, emission_error(xml))
