"""One document at a time, for scripts: each call is a plan over one row."""

from __future__ import annotations

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import header, json, parse, xml
from ..functions.body import BLOCKS, empty_body
from ..functions.header import HEADER


def _evaluate(**columns: Column) -> Row:
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def _value(own: Column):
    row = _evaluate(own=own).own
    if row.error is not None:
        raise ValueError(row.error)
    return row.value


class Document:
    """A document with a title; blank titles raise ValueError."""

    def __init__(self, title: str):
        _value(header.document_title(F.lit(title)))
        self._row = _evaluate(header=header.header(header.file_desc(header.document_title(F.lit(title))["value"])), blocks=empty_body())

    @classmethod
    def _of(cls, row: Row) -> Document:
        own = cls.__new__(cls)
        own._row = row
        return own

    def _literal(self) -> tuple[Column, Column]:
        """The parts as constants of a plan, carried as JSON text."""
        import json as text

        as_json = [F.from_json(F.lit(text.dumps({"x": _plain(v)})), f"x {t}")["x"] for v, t in ((self._row.header, HEADER), (self._row.blocks, BLOCKS))]
        return as_json[0], as_json[1]

    @property
    def title(self) -> str:
        return self._row.header.fileDesc.title

    @property
    def header(self) -> Row:
        return self._row.header

    @property
    def blocks(self) -> list[Row]:
        return self._row.blocks

    def emit_title_markup(self) -> str:
        return emit_title_markup(self.title)

    def to_json(self) -> str:
        return _evaluate(j=json.document_json(*self._literal())).j

    def to_dict(self) -> dict:
        import json as text

        return text.loads(self.to_json())

    @classmethod
    def from_json(cls, payload: str) -> Document:
        return cls._parsed(parse.guarded(parse.read_json, payload))

    def to_msgpack(self) -> bytes:
        from ..functions.msgpack import pack

        return pack(self.to_dict())

    @classmethod
    def from_msgpack(cls, payload: bytes) -> Document:
        return cls._parsed(parse.guarded(parse.read_msgpack, payload))

    @classmethod
    def from_dict(cls, value: dict) -> Document:
        import json as text

        return cls.from_json(text.dumps(value))

    @classmethod
    def _parsed(cls, got: dict) -> Document:
        if got["error"] is not None:
            raise ValueError(got["error"])
        return cls._of(_row({"header": got["header"], "blocks": got["blocks"]}))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Document) and _plain(self._row) == _plain(other._row)

    __hash__ = None


def _plain(value):
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _row(value):
    if isinstance(value, dict):
        return Row(**{k: _row(v) for k, v in value.items()})
    return [_row(v) for v in value] if isinstance(value, list) else value


def emit_title_markup(raw_title: str) -> str:
    return _value(xml.title_markup(F.lit(raw_title)))


def parse_xml(text: str) -> Document:
    return Document._parsed(parse.guarded(parse.read_xml, text))


def emit_xml(document: Document) -> str:
    return _value(xml.emit_xml(*document._literal()))


def register(spark: SparkSession, replace: bool = False) -> None:
    """SQL functions: escape_xml_text, title_markup, title_error, first_forbidden_xml_char,
    parse_document (a struct of header, blocks and error), emit_document(header, blocks)
    (canonical XML, null where it has forbidden characters) and emit_error(header, blocks) (why it
    is null).  All but the parser are SQL expressions, so the optimizer sees through them.
    Functions of these names that the session has already stay, but for ``replace``."""
    from ..functions.errors import FORBIDDEN as MESSAGE
    from ..functions.errors import TITLE, XML
    from ..functions.text import BLANKS, ENTITIES, FORBIDDEN_FAST, IN_ATTRIBUTE, IN_TEXT, REFERENCES

    sql = lambda s: "r'" + s.replace("'", "\\'") + "'" if "'" not in s else '"' + s + '"'
    escaped = "s"
    for c, entity in ENTITIES.items():
        escaped = f"replace({escaped}, {sql(c) if c != chr(34) else chr(39) + chr(34) + chr(39)}, '{entity}')"
    trimmed = f"nullif(btrim(s, '{BLANKS}'), '')"
    functions = {
        "escape_xml_text(s STRING)": escaped,
        "title_error(s STRING)": f"CASE WHEN {trimmed} IS NULL THEN '{TITLE}' END",
        "title_markup(s STRING)": f"concat('<title>', {escaped.replace('(s,', f'({trimmed},', 1)}, '</title>')",
        "first_forbidden_xml_char(s STRING)": f"nullif(regexp_extract(s, {sql(FORBIDDEN_FAST)}, 0), '')",
    }

    def create(signature: str, out: str) -> None:
        if replace or not spark.catalog.functionExists(signature.partition("(")[0]):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING RETURN {out}")

    for name, out in functions.items():
        create(name, out)
    if replace or not spark.catalog.functionExists("parse_document"):
        spark.udf.register("parse_document", parse._udf(parse.read_xml))

    def text(value: str, which: str = IN_TEXT) -> str:
        for c, entity in (ENTITIES | REFERENCES).items():
            if c in which:
                value = f"replace({value}, chr({ord(c)}), '{entity}')"
        return value

    def attribute(name: str, value: str) -> str:
        return f"coalesce(concat(' {name}=\"', {text(value, IN_ATTRIBUTE)}, '\"'), '')"

    def leaf(name: str, value: str) -> str:
        return f"CASE WHEN {value} IS NULL THEN '' WHEN {value} = '' THEN '<{name}/>' ELSE concat('<{name}>', {text(value)}, '</{name}>') END"

    def section(name: str, field: str, content: str, empty: str) -> str:
        return f"CASE WHEN header.{field} IS NULL THEN '' WHEN {empty} THEN '<{name}/>' ELSE concat('<{name}>', {content}, '</{name}>') END"

    def each(items: str, one: str) -> str:
        return f"array_join(transform({items}, x -> {one}), '')"

    profile, systems, changes = "header.profileDesc", "header.encodingDesc.annotationSystem", "header.revisionDesc.change"
    file = "concat('<fileDesc>', " + ", ".join(leaf(n, f"header.fileDesc.{n}") for n in ("title", "series", "synopsis")) + ", '</fileDesc>')"
    parts = [
        section("profileDesc", "profileDesc", f"concat({leaf('synopsis', profile + '.synopsis')}, {each(profile + '.speaker', leaf('speaker', 'x'))}, {each(profile + '.lang', leaf('lang', 'x'))})", f"{profile}.synopsis IS NULL AND size({profile}.speaker) = 0 AND size({profile}.lang) = 0"),
        section("encodingDesc", "encodingDesc", each(systems, f"concat('<annotationSystem', {attribute('xml:id', 'x.id')}, CASE WHEN x.desc IS NULL THEN '/>' ELSE concat('>', {leaf('desc', 'x.desc')}, '</annotationSystem>') END)"), f"size({systems}) = 0"),
        section("revisionDesc", "revisionDesc", each(changes, f"concat('<change>', {text('x.description')}, {leaf('resp', 'x.resp')}, '</change>')"), f"size({changes}) = 0"),
    ]
    follows = "coalesce(get(b.inline, i + 1).depth, 0)"
    hollow = f"(t.kind = 'hi' AND {follows} <= t.depth)"
    token = f"CASE t.kind WHEN 'text' THEN {text('t.text')} WHEN 'pause' THEN concat('<pause', {attribute('dur', 't.dur')}, {attribute('type', 't.type')}, '/>') ELSE concat('<hi', {attribute('rend', 't.rend')}, CASE WHEN {hollow} THEN '/>' ELSE '>' END) END"
    inline = f"array_join(transform(b.inline, (t, i) -> concat({token}, repeat('</hi>', t.depth + CASE WHEN t.kind = 'hi' AND NOT {hollow} THEN 1 ELSE 0 END - {follows}))), '')"
    start = f"concat('<', b.kind, {attribute('xml:id', 'b.id')}, CASE WHEN b.kind = 'u' THEN {attribute('who', 'b.who')} ELSE '' END)"
    block = f"CASE WHEN exists(b.inline, t -> t.kind <> 'text' OR t.text <> '') THEN concat({start}, '>', {inline}, '</', b.kind, '>') ELSE concat({start}, '/>') END"
    body = f"CASE WHEN size(blocks) = 0 THEN '<body/>' ELSE concat('<body>', array_join(transform(blocks, b -> {block}), ''), '</body>') END"
    whole = f"concat('<TEI><teiHeader>', {file}, {', '.join(parts)}, '</teiHeader><text>', {body}, '</text></TEI>')"
    # The markup is a lambda's argument, so that it is made once however often its name stands there.
    arguments = f"(header {HEADER}, blocks {BLOCKS})"
    create(f"emit_document{arguments}", f"transform(array({whole}), x -> CASE WHEN NOT x RLIKE {sql(FORBIDDEN_FAST)} THEN x END)[0]")
    create(f"emit_error{arguments}", f"transform(array(regexp_extract({whole}, {sql(FORBIDDEN_FAST)}, 0)), c -> CASE WHEN c <> '' THEN concat('{XML}{MESSAGE}', format_string('U+%04X', ascii(c))) END)[0]")
