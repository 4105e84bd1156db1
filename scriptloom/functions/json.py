"""Documents as JSON text by built-in expressions, with the model's names and order.

Members that are null or empty lists are left out, but for content, which always stays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: Column) -> Column:
    """A JSON string; null stays null."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def _object(*members: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*members)), ","), F.lit("}"))


def _member(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), value)


def _strings(name: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, _member(name, F.to_json(items)))


def _list(items: Column, one) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, one), ","), F.lit("]"))


def header_json(h: Column) -> Column:
    f, p, e, r = (h[n] for n in ("fileDesc", "profileDesc", "encodingDesc", "revisionDesc"))
    text = lambda part, name: _member(name, quoted(part[name]))
    file = _object(text(f, "title"), text(f, "series"), text(f, "synopsis"))
    profile = _object(text(p, "synopsis"), _strings("speaker", p["speaker"]), _strings("lang", p["lang"]))
    systems = _list(e["annotationSystem"], lambda s: _object(_member("@xml:id", quoted(s["id"])), text(s, "desc")))
    changes = _list(r["change"], lambda c: _object(_member("$value", quoted(c["description"])), text(c, "resp")))
    return _object(
        _member("fileDesc", file),
        F.when(p.isNotNull(), _member("profileDesc", profile)),
        F.when(e.isNotNull(), _member("encodingDesc", _object(F.when(F.size(e["annotationSystem"]) > 0, _member("annotationSystem", systems))))),
        F.when(r.isNotNull(), _member("revisionDesc", _object(F.when(F.size(r["change"]) > 0, _member("change", changes))))),
    )


def inline_json(tokens: Column) -> Column:
    def one(t: Column, i: Column) -> Column:
        before, after = F.get(tokens, i - 1), F.coalesce(F.get(tokens, i + 1)["depth"], F.lit(0))
        first = (i == 0) | ((before["kind"] == "hi") & (before["depth"] < t["depth"]))
        opened = t["depth"] + F.when(t["kind"] == "hi", 1).otherwise(0)
        rend = F.coalesce(F.concat(F.lit('"rend":'), quoted(t["rend"]), F.lit(",")), F.lit(""))
        own = (
            F.when(t["kind"] == "text", quoted(t["text"]))
            .when(t["kind"] == "pause", _object(_member("@dur", quoted(t["dur"])), _member("@type", quoted(t["type"]))))
            .otherwise(F.concat(F.lit("{"), rend, F.lit('"$value":[')))
        )
        return F.concat(F.when(first, "").otherwise(","), own, F.repeat(F.lit("]}"), opened - after))

    return F.concat(F.lit("["), F.array_join(F.transform(tokens, one), ""), F.lit("]"))


def block_json(b: Column) -> Column:
    who = F.when(b["kind"] == "u", _member("@who", quoted(b["who"])))
    return F.concat(F.lit('{"'), b["kind"], F.lit('":'), _object(_member("@xml:id", quoted(b["id"])), who, _member("$value", inline_json(b["inline"]))), F.lit("}"))


def document_json(header: Column, blocks: Column) -> Column:
    return _object(_member("teiHeader", header_json(header)), _member("text", _object(_member("body", _object(_member("$value", _list(blocks, block_json)))))))
