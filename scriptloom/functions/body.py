"""Blocks and inline content as columns.

Inline content nests, Spark's types don't: it is kept as tokens in reading order, each with
its depth.  After token i the open depth is its own depth, plus one if it is an emphasis, so
the next token's depth tells how many emphases end between them.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import errors
from .header import optional_speaker, speaker, xml_id
from .text import checked, is_blank

TOKEN = "struct<depth:int,kind:string,text:string,rend:string,dur:string,type:string>"
TOKENS = f"array<{TOKEN}>"
BLOCK = f"struct<kind:string,id:string,who:string,inline:{TOKENS}>"
BLOCKS = f"array<{BLOCK}>"
PARAGRAPH, UTTERANCE, EMPHASIS = "paragraph", "utterance", "hi"


def _token(kind: str, text: Column | None = None, rend: Column | None = None, dur: Column | None = None, type_: Column | None = None, depth: int = 0) -> Column:
    values = {"depth": F.lit(depth), "kind": F.lit(kind), "text": text, "rend": rend, "dur": dur, "type": type_}
    return F.struct(*((F.lit(None).cast("string") if v is None else v).alias(n) for n, v in values.items())).cast(TOKEN)


def text(value: Column) -> Column:
    """Tokens of a text; nothing is checked."""
    return F.array(_token("text", text=value))


def pause(duration: Column | None = None, kind: Column | None = None) -> Column:
    return F.array(_token("pause", dur=duration, type_=kind))


def hi(content: Column, rend: Column | None = None) -> Column:
    """Tokens of an emphasis around others; nothing is checked."""
    inner = F.transform(content, lambda t: t.withField("depth", t["depth"] + 1))
    return F.concat(F.array(_token("hi", rend=rend)), inner).cast(TOKENS)


def checked_hi(content: Column, rend: Column | None = None) -> Column:
    return checked(hi(content, rend), content_error(content, EMPHASIS))


def joined(*parts: Column) -> Column:
    """Tokens of several pieces of content, one after another."""
    return F.concat(*parts).cast(TOKENS)


def as_text(token: Column) -> Column:
    return F.when(token["kind"] == "text", token["text"])


def with_attribute(token: Column, name: str, value: Column | None) -> Column:
    """The token with rend, dur or type set, or cleared (None)."""
    return token.withField(name, F.lit(None).cast("string") if value is None else value)


def segments(texts: Column) -> Column:
    """A text token for each text, as it stands."""
    return F.transform(texts, lambda t: _token("text", text=t)).cast(TOKENS)


def content_error(tokens: Column, container: str) -> Column:
    """What is wrong with a container's content: the first offence in reading order.  It is
    named after the outer container however deep it is."""
    empty, blank = F.lit(errors.CONTENT.format(container)), F.lit(errors.SEGMENT.format(container))

    def offence(token: Column, i: Column) -> Column:
        follows = F.coalesce(F.get(tokens, i + 1)["depth"], F.lit(-1))
        return F.when((token["kind"] == "text") & is_blank(token["text"]), blank).when((token["kind"] == "hi") & (follows <= token["depth"]), empty)

    first = F.try_element_at(F.filter(F.transform(tokens, offence), lambda e: e.isNotNull()), F.lit(1))
    return F.when(F.coalesce(F.size(tokens), F.lit(0)) < 1, empty).otherwise(first)


def _block(kind: str, who: Column | None, tokens: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("kind"), none.alias("id"), (none if who is None else who).alias("who"), tokens.alias("inline")).cast(BLOCK)


def paragraph(tokens: Column) -> Column:
    return checked(_block("p", None, tokens), content_error(tokens, PARAGRAPH))


def paragraph_of(texts: Column) -> Column:
    return paragraph(segments(texts))


def utterance(who: Column | None, tokens: Column) -> Column:
    """A wrong speaker is reported before wrong content."""
    by = optional_speaker(F.lit(None).cast("string") if who is None else who)
    return checked(_block("u", by["value"], tokens), F.coalesce(by["error"], content_error(tokens, UTTERANCE)))


def utterance_of(who: Column | None, texts: Column) -> Column:
    return utterance(who, segments(texts))


def new_paragraph(texts: Column) -> Column:
    warnings.warn("use paragraph_of", DeprecationWarning, stacklevel=2)
    return paragraph_of(texts)


def new_utterance(who: Column | None, texts: Column) -> Column:
    warnings.warn("use utterance_of", DeprecationWarning, stacklevel=2)
    return utterance_of(who, texts)


def container_of(block: Column) -> Column:
    return F.when(block["kind"] == "p", PARAGRAPH).otherwise(UTTERANCE)


def _kept(block: Column, changed: Column, error: Column) -> Column:
    """The changed block, or the old one with the error."""
    return F.struct(F.when(error.isNull(), changed).otherwise(block).alias("value"), error.alias("error"))


def set_id(block: Column, identifier: Column) -> Column:
    """A rejected identifier leaves the block's own."""
    p, u = xml_id(identifier, PARAGRAPH), xml_id(identifier, UTTERANCE)
    error = F.when(block["kind"] == "p", p["error"]).otherwise(u["error"])
    return _kept(block, block.withField("id", p["value"]), error)


def clear_id(block: Column) -> Column:
    return block.withField("id", F.lit(None).cast("string"))


def set_speaker(block: Column, who: Column) -> Column:
    own = speaker(who)
    return _kept(block, block.withField("who", own["value"]), own["error"])


def clear_speaker(block: Column) -> Column:
    return block.withField("who", F.lit(None).cast("string"))


def push_segment(block: Column, segment: Column) -> Column:
    return push_inline(block, text(segment))


def push_inline(block: Column, tokens: Column) -> Column:
    """Appends content if it is right by itself."""
    error = F.when(block["kind"] == "p", content_error(tokens, PARAGRAPH)).otherwise(content_error(tokens, UTTERANCE))
    return _kept(block, block.withField("inline", F.concat(block["inline"], tokens)), error)


def push_into_hi(emphasis: Column, tokens: Column) -> Column:
    """Appends content to an emphasis's tokens (the first is the emphasis itself)."""
    inner = F.transform(tokens, lambda t: t.withField("depth", t["depth"] + 1))
    return _kept(emphasis, F.concat(emphasis, inner), content_error(tokens, EMPHASIS))


def empty_body() -> Column:
    return F.array().cast(BLOCKS)


def push_block(blocks: Column, block: Column) -> Column:
    return F.array_append(blocks, block)


def extend(blocks: Column, more: Column) -> Column:
    """Both bodies' blocks in order; none is dropped."""
    return F.concat(blocks, more)


def paragraphs(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["kind"] == "p")


def utterances(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["kind"] == "u")


def count_blocks(blocks: Column) -> Column:
    return F.size(blocks).cast("bigint")


def body_is_empty(blocks: Column) -> Column:
    return F.size(blocks) == 0


def flat_text(tokens: Column) -> Column:
    """The content's text alone."""
    return F.array_join(F.transform(F.filter(tokens, lambda t: t["kind"] == "text"), lambda t: t["text"]), "")


def empty_tokens() -> Column:
    return F.array().cast(TOKENS)
