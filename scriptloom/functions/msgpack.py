"""Documents as MessagePack, of the same members as their JSON form.

``document_msgpack`` writes them by built-in expressions: hexadecimal text, which joins as
strings do, and bytes of it at the end.  ``pack`` and ``unpack`` do plain values: the public
format's nil, booleans, integers, texts, lists and maps; the model needs no more.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import Rejected


def _head(n: int, fixed: int, most: int, wide: tuple[tuple[int, int, str], ...]) -> bytes:
    """The type and length of a text, list or map."""
    if n <= most:
        return bytes([fixed | n])
    for limit, code, form in wide:
        if n <= limit:
            return bytes([code]) + struct.pack(form, n)
    raise ValueError("too long for MessagePack")


def pack(value) -> bytes:
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        return bytes([value]) if 0 <= value < 128 else b"\xd3" + struct.pack(">q", value)
    if isinstance(value, str):
        raw = value.encode()
        return _head(len(raw), 0xA0, 31, ((0xFF, 0xD9, ">B"), (0xFFFF, 0xDA, ">H"), (0xFFFFFFFF, 0xDB, ">I"))) + raw
    if isinstance(value, list):
        return _head(len(value), 0x90, 15, ((0xFFFF, 0xDC, ">H"), (0xFFFFFFFF, 0xDD, ">I"))) + b"".join(map(pack, value))
    if isinstance(value, dict):
        return _head(len(value), 0x80, 15, ((0xFFFF, 0xDE, ">H"), (0xFFFFFFFF, 0xDF, ">I"))) + b"".join(pack(k) + pack(v) for k, v in value.items())
    raise TypeError(f"MessagePack has no form here for {type(value).__name__}")


_LENGTHS = {0xD9: (">B", "text"), 0xDA: (">H", "text"), 0xDB: (">I", "text"), 0xDC: (">H", "list"), 0xDD: (">I", "list"), 0xDE: (">H", "map"), 0xDF: (">I", "map")}
_NUMBERS = {0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}


def _unpack(data: bytes, at: int) -> tuple[object, int]:
    code = data[at]
    at += 1
    if code < 0x80:
        return code, at
    if code >= 0xE0:
        return code - 256, at
    if code in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[code], at
    if code in _NUMBERS:
        form = _NUMBERS[code]
        return struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)
    if code in _LENGTHS:
        form, kind = _LENGTHS[code]
        n = struct.unpack_from(form, data, at)[0]
        at += struct.calcsize(form)
    elif code < 0x90:
        kind, n = "map", code & 15
    elif code < 0xA0:
        kind, n = "list", code & 15
    elif code < 0xC0:
        kind, n = "text", code & 31
    else:
        raise Rejected(f"no part of a document has the MessagePack type {code:#x}")
    if kind == "text":
        if at + n > len(data):
            raise Rejected("the MessagePack data end too early")
        return data[at : at + n].decode(), at + n
    out = []
    for _ in range(n * (2 if kind == "map" else 1)):
        item, at = _unpack(data, at)
        out.append(item)
    return (out if kind == "list" else dict(zip(out[::2], out[1::2], strict=True))), at


def unpack(data: bytes):
    try:
        value, at = _unpack(data, 0)
    except (IndexError, struct.error):
        raise Rejected("the MessagePack data end too early") from None
    if at != len(data):
        raise Rejected("more data follow the document")
    return value


def _number(n: Column, digits: int) -> Column:
    return F.lpad(F.hex(n.cast("long")), digits, "0")


def _text(value: Column) -> Column:
    """A text's head and bytes; null stays null."""
    n = F.octet_length(value)
    head = F.when(n < 32, _number(n + 0xA0, 2)).when(n < 1 << 8, F.concat(F.lit("D9"), _number(n, 2))).when(n < 1 << 16, F.concat(F.lit("DA"), _number(n, 4))).otherwise(F.concat(F.lit("DB"), _number(n, 8)))
    return F.concat(head, F.hex(F.encode(value, "UTF-8")))


def _list_head(n: Column) -> Column:
    return F.when(n < 16, _number(n + 0x90, 2)).when(n < 1 << 16, F.concat(F.lit("DC"), _number(n, 4))).otherwise(F.concat(F.lit("DD"), _number(n, 8)))


def _list(items: Column, one) -> Column:
    return F.concat(_list_head(F.size(items)), F.array_join(F.transform(items, one), ""))


def _member(name: str, value: Column) -> Column:
    return F.concat(F.lit(pack(name).hex().upper()), value)


def _map(*members: Column) -> Column:
    """Members that are null are left out; there are fewer than sixteen."""
    there = F.array_compact(F.array(*members))
    return F.concat(_number(F.size(there) + 0x80, 2), F.array_join(there, ""))


def _some(name: str, items: Column, one) -> Column:
    return F.when(F.size(items) > 0, _member(name, _list(items, one)))


def _inline(tokens: Column) -> Column:
    def children(t: Column, i: Column) -> Column:
        """How many tokens an emphasis holds itself: those one deeper, up to the first that isn't."""
        start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"))
        step = lambda acc, x: F.struct((acc["n"] + F.when(acc["open"] & (x["depth"] == t["depth"] + 1), 1).otherwise(0)).alias("n"), (acc["open"] & (x["depth"] > t["depth"])).alias("open"))
        return F.aggregate(F.slice(tokens, i + 2, F.size(tokens)), start, step, lambda acc: acc["n"])

    def one(t: Column, i: Column) -> Column:
        rend = F.coalesce(_member("rend", _text(t["rend"])), F.lit(""))
        hi = F.concat(F.when(t["rend"].isNull(), "81").otherwise("82"), rend, F.lit(pack("$value").hex().upper()), _list_head(children(t, i)))
        return F.when(t["kind"] == "text", _text(t["text"])).when(t["kind"] == "pause", _map(_member("@dur", _text(t["dur"])), _member("@type", _text(t["type"])))).otherwise(hi)

    return F.concat(_list_head(F.size(F.filter(tokens, lambda t: t["depth"] == 0))), F.array_join(F.transform(tokens, one), ""))


def _block(b: Column) -> Column:
    who = F.when(b["kind"] == "u", _member("@who", _text(b["who"])))
    return F.concat(F.lit("81"), _text(b["kind"]), _map(_member("@xml:id", _text(b["id"])), who, _member("$value", _inline(b["inline"]))))


def document_msgpack(header: Column, blocks: Column) -> Column:
    """A document's bytes, those of ``pack`` over its JSON form's members."""
    f, p, e, r = (header[n] for n in ("fileDesc", "profileDesc", "encodingDesc", "revisionDesc"))
    text = lambda part, name: _member(name, _text(part[name]))
    head = _map(
        _member("fileDesc", _map(text(f, "title"), text(f, "series"), text(f, "synopsis"))),
        F.when(p.isNotNull(), _member("profileDesc", _map(text(p, "synopsis"), _some("speaker", p["speaker"], _text), _some("lang", p["lang"], _text)))),
        F.when(e.isNotNull(), _member("encodingDesc", _map(_some("annotationSystem", e["annotationSystem"], lambda s: _map(_member("@xml:id", _text(s["id"])), text(s, "desc")))))),
        F.when(r.isNotNull(), _member("revisionDesc", _map(_some("change", r["change"], lambda c: _map(_member("$value", _text(c["description"])), text(c, "resp")))))),
    )
    return F.unhex(_map(_member("teiHeader", head), _member("text", _map(_member("body", _map(_member("$value", _list(blocks, _block))))))))
