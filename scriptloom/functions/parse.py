"""XML and JSON documents to the model, in Arrow batches.

Spark's own XML reader loses text between inline elements, so this is the one place where
documents leave the JVM.  A bad document gives an error in its row, never a failed job:
members of a wrong type and texts that Arrow can't hold are errors too.

A document is a string, so what its declaration says of its encoding is not heeded.  Raw
carriage returns are line ends, as XML has it; those that the writer escapes stay.
"""

from __future__ import annotations

import json
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import errors
from .body import BLOCKS
from .header import HEADER

PARSED = f"struct<header:{HEADER},blocks:{BLOCKS},error:string>"

# White space of Unicode.
_SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"


class Rejected(ValueError):
    """A document that isn't one."""


class _Node:
    """An element: name, attributes, and children (strings and elements) in order."""

    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []

    def elements(self, name: str) -> list[_Node]:
        return [c for c in self.children if isinstance(c, _Node) and c.name == name]

    def one(self, name: str, needed: bool = False) -> _Node | None:
        found = self.elements(name)
        if len(found) > 1:
            raise Rejected(f"duplicate field `{name}`")
        if needed and not found:
            raise Rejected(f"missing field `{name}`")
        return found[0] if found else None

    def text(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))


def read_tree(xml: str) -> _Node:
    top = _Node("", {})
    stack = [top]
    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True

    def start(name, attributes):
        node = _Node(name, attributes)
        stack[-1].children.append(node)
        stack.append(node)

    def chars(data):
        own = stack[-1].children
        if own and isinstance(own[-1], str):
            own[-1] += data
        else:
            own.append(data)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda name: stack.pop(), chars
    try:
        parser.Parse(xml.encode(), True)
    except expat.ExpatError as e:
        raise ill_formed(e) from None
    return top.children[0]


def ill_formed(e: expat.ExpatError) -> Rejected:
    cut = e.code in (expat.errors.codes[expat.errors.XML_ERROR_NO_ELEMENTS], expat.errors.codes[expat.errors.XML_ERROR_UNCLOSED_TOKEN])
    return Rejected(errors.UNCLOSED if cut else f"{expat.ErrorString(e.code)} at line {e.lineno}")


def _string(value, name: str) -> str | None:
    if value is not None and not isinstance(value, str):
        raise Rejected(f"invalid type for `{name}`: expected a string")
    return value


def _listed(value, name: str) -> list:
    if not isinstance(value, list):
        raise Rejected(f"invalid type for `{name}`: expected a sequence")
    return value


def _map(value, name: str) -> dict:
    if not isinstance(value, dict):
        raise Rejected(f"invalid type for `{name}`: expected a map")
    return value


def _needed(text: str | None, message: str) -> str:
    text = (text or "").strip(_SPACES)
    if not text:
        raise Rejected(message)
    return text


def _optional(node: _Node | None) -> str | None:
    return None if node is None else node.text()


def _identifier(value: str | None) -> str | None:
    if value is None:
        return None
    value = _needed(value, errors.ID_EMPTY)
    if any(c in _SPACES for c in value):
        raise Rejected(errors.ID_SPACE)
    return value


def _id_of(node: _Node) -> str | None:
    return node.attributes.get("xml:id", node.attributes.get("id"))


def _header(node: _Node) -> dict:
    file = node.one("fileDesc", True)
    profile, encoding, revision = (node.one(n) for n in ("profileDesc", "encodingDesc", "revisionDesc"))
    field = lambda n, name: _needed(n.text(), errors.FIELD.format(name))

    def system(s: _Node) -> dict:
        if _id_of(s) is None:
            raise Rejected("missing field `@xml:id`")
        return {"id": _needed(_id_of(s), errors.FIELD.format(errors.SYSTEM)), "desc": _optional(s.one("desc"))}

    def change(c: _Node) -> dict:
        resp = c.one("resp")
        by = resp.text() if resp is not None else c.attributes.get("resp")
        return {"description": _needed(c.text(), errors.NOTE), "resp": None if by is None else _needed(by, errors.FIELD.format(errors.RESPONSIBLE))}

    return {
        "fileDesc": {"title": _needed(file.one("title", True).text(), errors.TITLE), "series": _optional(file.one("series")), "synopsis": _optional(file.one("synopsis"))},
        "profileDesc": profile and {"synopsis": _optional(profile.one("synopsis")), "speaker": [field(s, errors.SPEAKER_NAME) for s in profile.elements("speaker")], "lang": [field(s, errors.LANGUAGE) for s in profile.elements("lang")]},
        "encodingDesc": encoding and {"annotationSystem": [system(s) for s in encoding.elements("annotationSystem")]},
        "revisionDesc": revision and {"change": [change(c) for c in revision.elements("change")]},
    }


def _token(depth: int, kind: str, **rest) -> dict:
    return {"depth": depth, "kind": kind, "text": None, "rend": None, "dur": None, "type": None, **rest}


def is_pause(name: str, attributes: dict) -> bool:
    return name == "pause" and set(attributes) <= {"dur", "type"}


def is_hi(name: str, attributes: dict) -> bool:
    return name == "hi" and set(attributes) <= {"rend"}


def _inline(children: list, out: list[dict]) -> None:
    """Tokens of mixed content.  A stack of its own, so that content nests as deep as it likes."""
    stack = [(iter(children), -1)]
    while stack:
        rest, before = stack[-1]
        for c in rest:
            if isinstance(c, str):
                if c.strip(_SPACES):
                    out.append(_token(len(stack) - 1, "text", text=c))
            elif is_pause(c.name, c.attributes) and not any(isinstance(x, _Node) or x.strip(_SPACES) for x in c.children):
                out.append(_token(len(stack) - 1, "pause", **c.attributes))
            elif is_hi(c.name, c.attributes):
                out.append(_token(len(stack) - 1, "hi", **c.attributes))
                stack.append((iter(c.children), len(out)))
                break
            else:
                raise Rejected(errors.INLINE)
        else:
            stack.pop()
            if len(out) == before:
                raise Rejected(errors.INLINE)


def block_of(kind: str, identifier: str | None, who: str | None, tokens: list[dict]) -> dict:
    return {"kind": kind, "id": _identifier(identifier), "who": None if who is None else _needed(who, errors.SPEAKER), "inline": tokens}


def _blocks(body: _Node) -> list[dict]:
    out = []
    for c in body.children:
        if isinstance(c, str):
            if c.strip(_SPACES):
                raise Rejected("unknown variant `$text`, expected `p` or `u`")
            continue
        if c.name not in ("p", "u"):
            raise Rejected(f"unknown variant `{c.name}`, expected `p` or `u`")
        who = c.attributes.get("who") if c.name == "u" else None
        own: list[dict] = []
        _inline(c.children, own)
        out.append(block_of(c.name, _id_of(c), who, own))
    return out


def read_xml(xml: str) -> dict:
    """header and blocks of a document, or Rejected."""
    root = read_tree(xml)
    if root.name != "TEI":
        raise Rejected("missing field `teiHeader`")
    header = _header(root.one("teiHeader", True))
    return {"header": header, "blocks": _blocks(root.one("text", True).one("body", True)), "error": None}


def read_inline(value, out: list[dict]) -> None:
    """Tokens of a JSON inline: a text, else an emphasis, else a pause."""
    stack = [[iter([value]), False]]  # what is left of a list, and whether a text in it is blank
    while stack:
        depth, frame = len(stack) - 1, stack[-1]
        for v in frame[0]:
            if isinstance(v, str):
                frame[1] |= not v.strip(_SPACES)
                out.append(_token(depth, "text", text=v))
            elif isinstance(v, dict) and set(v) <= {"rend", "$value"} and isinstance(v.get("$value"), list) and v["$value"]:
                out.append(_token(depth, "hi", rend=_string(v.get("rend"), "rend")))
                stack.append([iter(v["$value"]), False])
                break
            elif isinstance(v, dict) and set(v) <= {"@dur", "@type"}:
                out.append(_token(depth, "pause", dur=_string(v.get("@dur"), "@dur"), type=_string(v.get("@type"), "@type")))
            else:
                raise Rejected(errors.INLINE)
        else:
            stack.pop()
            if frame[1] and depth:
                raise Rejected(errors.INLINE)


def _loaded(payload: str):
    """A JSON text's value.  The standard reader keeps a depth that it doesn't go beyond."""
    try:
        return json.loads(payload)
    except RecursionError:
        raise Rejected("invalid JSON: nested too deeply") from None
    except ValueError as e:
        raise Rejected(f"invalid JSON: {e}") from None


def inline_error(payload: str | None) -> str | None:
    """What is wrong with a JSON text as an inline."""
    try:
        read_inline(_loaded(payload or ""), [])
    except Rejected as e:
        return str(e).encode("utf-8", "replace").decode()
    return None


def read_json(payload: str) -> dict:
    """header and blocks of a document in JSON, or Rejected."""
    return read_members(_loaded(payload))


def read_msgpack(payload: bytes) -> dict:
    """header and blocks of a document in MessagePack, or Rejected."""
    from .msgpack import unpack

    return read_members(unpack(payload or b""))


def read_members(top) -> dict:
    """header and blocks of a document's plain maps and lists, or Rejected."""

    def member(of, name: str, owner: str):
        if name not in _map(of, owner):
            raise Rejected(f"missing field `{name}`")
        return of[name]

    def each(of: dict, name: str) -> list:
        return _listed(of.get(name) or [], name)

    def field(value, name: str) -> str:
        return _needed(_string(value, name), errors.FIELD.format(name))

    h = _map(member(top, "teiHeader", "document"), "teiHeader")
    f = _map(member(h, "fileDesc", "teiHeader"), "fileDesc")
    p, e, r = (None if h.get(n) is None else _map(h[n], n) for n in ("profileDesc", "encodingDesc", "revisionDesc"))

    def system(s) -> dict:
        s = _map(s, "annotationSystem")
        return {"id": field(s.get("@xml:id", s.get("@id")), errors.SYSTEM), "desc": _string(s.get("desc"), "desc")}

    def change(c) -> dict:
        c = _map(c, "change")
        return {"description": _needed(_string(c.get("$value"), "change"), errors.NOTE), "resp": None if c.get("resp") is None else field(c["resp"], errors.RESPONSIBLE)}

    header = {
        "fileDesc": {"title": _needed(_string(member(f, "title", "fileDesc"), "title"), errors.TITLE), "series": _string(f.get("series"), "series"), "synopsis": _string(f.get("synopsis"), "synopsis")},
        "profileDesc": None if p is None else {"synopsis": _string(p.get("synopsis"), "synopsis"), "speaker": [field(s, errors.SPEAKER_NAME) for s in each(p, "speaker")], "lang": [field(s, errors.LANGUAGE) for s in each(p, "lang")]},
        "encodingDesc": None if e is None else {"annotationSystem": [system(s) for s in each(e, "annotationSystem")]},
        "revisionDesc": None if r is None else {"change": [change(c) for c in each(r, "change")]},
    }
    blocks = []
    for b in _listed(member(_map(member(member(top, "text", "document"), "body", "text"), "body"), "$value", "body"), "$value"):
        if len(_map(b, "block")) != 1:
            raise Rejected("a block has one member, `p` or `u`")
        ((kind, own),) = b.items()
        if kind not in ("p", "u"):
            raise Rejected(f"unknown variant `{kind}`, expected `p` or `u`")
        own = _map(own, kind)
        tokens: list[dict] = []
        for v in each(own, "$value"):
            read_inline(v, tokens)
        who = _string(own.get("@who"), "@who") if kind == "u" else None
        identifier = _string(own.get("@xml:id", own.get("@id")), "@xml:id")
        blocks.append({"kind": kind, "id": _identifier(identifier), "who": None if who is None else _needed(who, errors.SPEAKER), "inline": tokens})
    return {"header": header, "blocks": blocks, "error": None}


def _failed(error: str) -> dict:
    # Errors may quote what no UTF-8 text can hold.
    return {"header": None, "blocks": None, "error": error.encode("utf-8", "replace").decode()}


def guarded(read, text: str | bytes | None) -> dict:
    """The document, or its error; a null text is an empty one."""
    try:
        return read(text or "")
    except Rejected as e:
        return _failed(errors.XML + str(e) if read is read_xml else str(e))
    except (ValueError, TypeError, AttributeError, LookupError, RecursionError, OverflowError) as e:
        return _failed(f"not a document: {e}")


def as_arrow(found: list[dict], kind: pa.DataType) -> pa.Array:
    """Structs of header, blocks and error; what Arrow can't hold is an error of its row."""
    pick = lambda f: {n.name: f[n.name] for n in kind}
    try:
        return pa.array([pick(f) for f in found], kind)
    except (ValueError, TypeError, OverflowError):
        out = []
        for f in found:
            try:
                out.append(pa.array([pick(f)], kind))
            except (ValueError, TypeError, OverflowError) as e:
                out.append(pa.array([pick(_failed(f"not a document: {e}"))], kind))
        return pa.concat_arrays(out)


def _udf(read):
    """An Arrow function over texts.  It is pure, but marked otherwise so that plans keep it
    apart: evaluated once a row, and never drawn into a higher-order function."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark_type = T.StructType.fromDDL(f"x {PARSED}").fields[0].dataType
    arrow_type = to_arrow_type(spark_type)

    def run(texts: pa.Array) -> pa.Array:
        return as_arrow([guarded(read, x) for x in texts.to_pylist()], arrow_type)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, spark_type).asNondeterministic()


def parse_xml(xml: Column) -> Column:
    """A struct of header, blocks and error.  Over plain columns; where the text is made by
    higher-order functions in the same plan node, use ``operators.documents.parse``."""
    return _udf(read_xml)(xml)


def parse_json(payload: Column) -> Column:
    return _udf(read_json)(payload)


def check_inline(payload: Column) -> Column:
    """The error of a JSON inline, or null."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([inline_error(x) for x in texts.to_pylist()], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.StringType())(payload)
