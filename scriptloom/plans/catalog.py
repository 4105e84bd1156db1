"""All queries of the engine and their SQL twins, by name.

The tables have no blank, padded or forbidden text, so faults are put in by key, by the same
SQL on both sides (``HOSTILE``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import body, header, json, xml
from ..functions.errors import CONTAINER_ID_EMPTY, CONTAINER_ID_SPACE, CONTENT, FIELD, FORBIDDEN as FORBIDDEN_ERROR, LANGUAGE, NOTE, RESPONSIBLE, REVISION, SEGMENT, SPEAKER, SPEAKER_NAME, SYSTEM, TITLE, XML
from ..functions.text import EDGES, ENTITIES, FORBIDDEN, SPACES, code_point, escape, first_forbidden, optional
from ..operators import documents as docs_
from ..operators import pieces, standoff, validate
from ..sources import datasource
from ..sources.files import shared_folder
from ..sources.tables import conversation_blocks, conversation_documents, conversation_title, table, text_documents, turn_block
from ..streaming import pull

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# SQL that Spark and DuckDB read alike -----------------------------------------------------


def hostile(text: str, key: str) -> str:
    """A column with faults by key."""
    cases = {0: "'   '", 1: f"'  ' || {text} || '\u0085'", 2: f"{text} || '\x01'", 3: f"'\x1c' || {text}", 4: f"{text} || '﷐'", 5: f"'<' || {text} || '>&\"'"}
    return f"CASE {key} % 8 " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + f" ELSE {text} END"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '{EDGES}', '', 'g')"


def blank_null(x: str) -> str:
    return f"nullif({trimmed(x)}, '')"


def escaped(x: str, which: str = "".join(ENTITIES)) -> str:
    for c, e in ENTITIES.items():
        if c in which:
            x = f"replace({x}, '{c * (2 if c == chr(39) else 1)}', '{e}')"
    return x


def forbidden(x: str) -> str:
    return f"nullif(regexp_extract({x}, '{FORBIDDEN}', 0), '')"


def point(x: str) -> str:
    return f"printf('U+%04X', ord({x}))"


TITLED = f"SELECT doc_id, {hostile('text', 'doc_id')} AS raw FROM documents"


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as titles, with faults."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{hostile('text', 'doc_id')} AS raw")


# Text ---------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {blank_null('raw')} AS title FROM ({TITLED})")
def normalise_titles(spark, sf_dir):
    return titled(spark, sf_dir).select("doc_id", optional(F.col("raw")).alias("title"))


@query(f"SELECT doc_id, CASE WHEN {blank_null('raw')} IS NULL THEN NULL ELSE '<title>' || {escaped(trimmed('raw'))} || '</title>' END AS markup, CASE WHEN {blank_null('raw')} IS NULL THEN '{TITLE}' END AS error FROM ({TITLED})")
def title_markup(spark, sf_dir):
    return titled(spark, sf_dir).select("doc_id", xml.title_markup(F.col("raw")).alias("m")).select("doc_id", F.col("m.value").alias("markup"), "m.error")


@query(f"SELECT '{TITLE}' AS error, count(*)::BIGINT AS n FROM ({TITLED}) WHERE {blank_null('raw')} IS NULL")
def title_errors(spark, sf_dir):
    own = titled(spark, sf_dir).select(header.document_title(F.col("raw"))["error"].alias("error"))
    return own.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS key, '<title>' || " + escaped(trimmed("p_name")) + " || '</title>' AS markup FROM part")
def bulk_title_markup(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), xml.title_markup(F.col("p_name"))["value"].alias("markup"))


@query(f"SELECT page_id, {escaped('html')} AS escaped FROM pages")
def escape_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", escape(F.col("html")).alias("escaped"))


@query(f"SELECT doc_id, {point('c')} AS first_forbidden, ({FORBIDDEN_ERROR!r} || {point('c')}) AS error FROM (SELECT doc_id, {forbidden('raw')} AS c FROM ({TITLED})) WHERE c IS NOT NULL")
def forbidden_chars(spark, sf_dir):
    own = titled(spark, sf_dir).select("doc_id", first_forbidden(F.col("raw")).alias("c")).where("c is not null")
    return own.select("doc_id", code_point(F.col("c")).alias("first_forbidden"), F.concat(F.lit(FORBIDDEN_ERROR), code_point(F.col("c"))).alias("error"))


# Identifiers and speakers -------------------------------------------------------------------

_ID = "CASE (conv_id + turn) % 5 WHEN 0 THEN '  c' || conv_id || '-t' || turn || ' ' WHEN 1 THEN 'c ' || turn WHEN 2 THEN '  ' ELSE 'c' || conv_id || '-t' || turn END AS raw"
_IDS = f"SELECT conv_id, turn, {_ID} FROM conversations"


@query(f"""SELECT conv_id, turn, CASE WHEN error IS NULL THEN v END AS id, error FROM (
  SELECT conv_id, turn, v, CASE WHEN v = '' THEN '{CONTAINER_ID_EMPTY.format("utterance")}' WHEN regexp_matches(v, '[{SPACES}]') THEN '{CONTAINER_ID_SPACE.format("utterance")}' END AS error
  FROM (SELECT conv_id, turn, {trimmed('raw')} AS v FROM ({_IDS})))""")
def xml_id_validation(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", _ID).select("conv_id", "turn", header.xml_id(F.col("raw"), body.UTTERANCE).alias("i"))
    return own.select("conv_id", "turn", F.col("i.value").alias("id"), "i.error")


_ROLE = "CASE conv_id % 4 WHEN 0 THEN '  ' || role || ' ' WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE role END AS raw"
_WHO = f"SELECT conv_id, turn, {_ROLE} FROM conversations"


@query(f"SELECT conv_id, turn, {blank_null('raw')} AS who, CASE WHEN raw IS NOT NULL AND {blank_null('raw')} IS NULL THEN '{SPEAKER}' END AS error FROM ({_WHO})")
def speaker_validation(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", _ROLE).select("conv_id", "turn", header.optional_speaker(F.col("raw")).alias("s"))
    return own.select("conv_id", "turn", F.col("s.value").alias("who"), "s.error")


# Headers ------------------------------------------------------------------------------------


@query("SELECT conv_id::VARCHAR AS doc_key, string_agg(DISTINCT role, ',' ORDER BY role) AS speakers FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def profile_cast(spark, sf_dir):
    own = conversation_documents(table(spark, sf_dir, "conversations"))
    return own.where("size(header.profileDesc.speaker) > 0").select("doc_key", F.array_join("header.profileDesc.speaker", ",").alias("speakers"))


@query("SELECT conv_id::VARCHAR AS doc_key, count(DISTINCT role) FILTER (WHERE role <> 'system')::BIGINT AS speakers, 0::BIGINT AS languages, count(DISTINCT role) FILTER (WHERE role <> 'system') = 0 AS is_empty FROM conversations GROUP BY conv_id")
def profile_counts(spark, sf_dir):
    p = F.col("header.profileDesc")
    return conversation_documents(table(spark, sf_dir, "conversations")).select("doc_key", header.count_speakers(p).alias("speakers"), header.count_languages(p).alias("languages"), header.profile_is_empty(p).alias("is_empty"))


@query("""SELECT doc_id::VARCHAR AS doc_key, k.key, l.doc_id IS NOT NULL AND k.key IN ('quality', 'toxic') AS found,
  CASE k.key WHEN 'quality' THEN l.quality::VARCHAR WHEN 'toxic' THEN l.toxic::VARCHAR END AS "desc"
FROM documents LEFT JOIN labels l USING (doc_id) CROSS JOIN (VALUES ('quality'), ('toxic'), ('Quality'), ('other')) k(key)""")
def annotation_lookup(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    systems = F.array(*(F.struct(F.lit(n).alias("id"), F.col(n).cast("string").alias("desc")) for n in ("quality", "toxic", "toxic")))
    head = header.header(header.file_desc(F.lit("x")), encoding=header.encoding_desc(systems))
    labelled = labels.select(F.col("doc_id").cast("string").alias("doc_key"), head.alias("header"))
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), F.explode(F.array(*(F.lit(k) for k in ("quality", "toxic", "Quality", "other")))).alias("key"))
    return validate.find_annotation_systems(labelled, keys).select("doc_key", "key", "found", "desc")


@query("SELECT user_id, count(*)::BIGINT AS changes, string_agg(event_type || '/' || user_id, ',' ORDER BY ts, event_id) AS log FROM events GROUP BY user_id")
def revision_log(spark, sf_dir):
    change = header.revision_change(F.col("event_type"), F.col("user_id").cast("string"))["value"]
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", change.alias("change")))).alias("s"))
    own = rows.select("user_id", header.revision_desc(F.col("s.change")).alias("r"))
    return own.select("user_id", F.size("r.change").cast("bigint").alias("changes"), F.array_join(F.transform("r.change", lambda c: F.concat_ws("/", c["description"], c["resp"])), ",").alias("log"))


@query(f"""SELECT doc_id, '<teiHeader><fileDesc><title>' || {escaped("'Document ' || doc_id", '&<>')} || '</title><series>' || {escaped('source', '&<>')} || '</series></fileDesc>'
  || '<profileDesc><lang>' || lang || '</lang></profileDesc>' || CASE WHEN doc_id % 2 = 0 THEN '<encodingDesc><annotationSystem xml:id="lang' || doc_id || '"/></encodingDesc>' ELSE '' END
  || '<revisionDesc><change>Read from ' || source || '<resp>' || lang || '</resp></change></revisionDesc></teiHeader>' AS xml FROM documents""")
def header_assembly(spark, sf_dir):
    system = header.annotation_system(F.concat(F.lit(" lang"), F.col("doc_id").cast("string")), F.lit("  "))["value"]
    systems = F.when(F.col("doc_id") % 2 == 0, F.array(system))
    change = header.revision_change(F.concat(F.lit("Read from "), F.col("source"), F.lit(" ")), F.col("lang"))["value"]
    head = header.assembled(
        header.file_desc(F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.col("source"), F.lit(" ")),
        header.profile_desc(languages=F.array("lang")),
        header.encoding_desc(systems),
        header.revision_desc(F.array(change)),
    )
    return table(spark, sf_dir, "documents").select("doc_id", xml.header_xml(head).alias("xml"))


# Bodies -------------------------------------------------------------------------------------

_BLOCKS = "SELECT conv_id::VARCHAR AS doc_key, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS block_pos, CASE WHEN role = 'system' THEN 'p' ELSE 'u' END AS kind, 'c' || conv_id || '-t' || turn AS id, CASE WHEN role <> 'system' THEN role END AS who, text FROM conversations"


def long_blocks(spark, sf_dir) -> DataFrame:
    own = docs_.blocks_long(conversation_documents(table(spark, sf_dir, "conversations")))
    return own.select("doc_key", "block_pos", "kind", "id", "who", body.flat_text(F.col("inline")).alias("text"))


@query(_BLOCKS)
def blocks_long(spark, sf_dir):
    return long_blocks(spark, sf_dir)


@query(f"SELECT * FROM ({_BLOCKS}) WHERE kind = 'p'")
def paragraphs_only(spark, sf_dir):
    return long_blocks(spark, sf_dir).where("kind = 'p'")


@query(f"SELECT * FROM ({_BLOCKS}) WHERE kind = 'u'")
def utterances_only(spark, sf_dir):
    return long_blocks(spark, sf_dir).where("kind = 'u'")


@query("SELECT conv_id::VARCHAR AS doc_key, count(*)::BIGINT AS blocks, count(*) FILTER (WHERE role = 'system')::BIGINT AS paragraphs, count(*) FILTER (WHERE role <> 'system')::BIGINT AS utterances, false AS is_empty FROM conversations GROUP BY conv_id")
def block_counts(spark, sf_dir):
    b = F.col("blocks")
    own = conversation_documents(table(spark, sf_dir, "conversations"))
    return own.select("doc_key", body.count_blocks(b).alias("blocks"), body.count_blocks(body.paragraphs(b)).alias("paragraphs"), body.count_blocks(body.utterances(b)).alias("utterances"), body.body_is_empty(b).alias("is_empty"))


@query("SELECT d.doc_id::VARCHAR AS doc_key FROM documents d WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = d.doc_id)")
def empty_bodies(spark, sf_dir):
    heads = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_key"), header.header(header.file_desc(F.lit("x"))).alias("header"))
    own = docs_.compose(heads, docs_.from_blocks(conversation_blocks(table(spark, sf_dir, "conversations"))))
    return own.where(body.body_is_empty(F.col("blocks"))).select("doc_key")


@query(f"""WITH b AS (SELECT doc_key, block_pos, id FROM ({_BLOCKS})), n AS (SELECT doc_key, count(*) AS n FROM b GROUP BY doc_key)
SELECT doc_key, block_pos, id FROM b UNION ALL SELECT doc_key, (block_pos + n)::BIGINT, id FROM b JOIN n USING (doc_key) WHERE block_pos < 2""")
def extend_bodies(spark, sf_dir):
    b = long_blocks(spark, sf_dir).select("doc_key", "block_pos", "id")
    return docs_.extend_bodies(b, b.where("block_pos < 2"))


_LINES = f"SELECT doc_id, string_split({hostile('text', 'doc_id')}, chr(10)) AS lines FROM documents"


@query(f"""SELECT doc_id, len(lines)::BIGINT AS segments, CASE WHEN len(list_filter(lines, lambda x: {trimmed('x')} = '')) > 0 THEN '{SEGMENT.format("paragraph")}' END AS error FROM ({_LINES})""")
def segment_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"split({hostile('text', 'doc_id')}, '\n', -1) AS lines")
    return rows.select("doc_id", F.size("lines").cast("bigint").alias("segments"), body.paragraph_of(F.col("lines"))["error"].alias("error"))


@query("SELECT doc_id, replace(text, chr(10), '') AS text FROM documents")
def inline_flatten(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    return table(spark, sf_dir, "documents").select("doc_id", body.flat_text(body.segments(lines)).alias("text"))


# Mixed inline content: text, an emphasis around text, a pause and an emphasis, text.
def _mixed():
    lang, src = F.col("lang"), F.col("source")
    inner = body.joined(body.text(src), body.pause(F.lit("PT1S"), lang), body.hi(body.text(lang)))
    return body.joined(body.text(F.lit("a<b ")), body.hi(inner, F.lit('st"ress')), body.text(F.lit(" end")))


@query("""SELECT doc_id, '<p>a&lt;b <hi rend="st&quot;ress">' || source || '<pause dur="PT1S" type="' || lang || '"/><hi>' || lang || '</hi></hi> end</p>' AS xml,
  '["a<b ",{"rend":"st\\"ress","$value":["' || source || '",{"@dur":"PT1S","@type":"' || lang || '"},{"$value":["' || lang || '"]}]}," end"]' AS json, 7::BIGINT AS tokens FROM documents""")
def mixed_inline(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", body.paragraph(_mixed())["value"].alias("b"))
    return rows.select("doc_id", xml.block_xml(F.col("b")).alias("xml"), json.inline_json(F.col("b.inline")).alias("json"), F.size("b.inline").cast("bigint").alias("tokens"))


# Documents ----------------------------------------------------------------------------------


def conversation_xml(text: str = "text") -> str:
    one = f"CASE WHEN role = 'system' THEN '<p xml:id=\"c' || conv_id || '-t' || turn || '\">' || {escaped(text, '&<>')} || '</p>' ELSE '<u xml:id=\"c' || conv_id || '-t' || turn || '\" who=\"' || role || '\">' || {escaped(text, '&<>')} || '</u>' END"
    return f"""SELECT conv_id::VARCHAR AS doc_key, '<TEI><teiHeader><fileDesc><title>Conversation ' || conv_id || '</title></fileDesc></teiHeader><text><body>' || string_agg({one}, '' ORDER BY turn) || '</body></text></TEI>' AS xml FROM conversations GROUP BY conv_id"""


def conversation_markup(conversations: DataFrame) -> DataFrame:
    """Canonical XML straight from the table: markup is made before its one shuffle."""
    rows = conversations.select("conv_id", "turn", xml.block_xml(turn_block()).alias("markup"))
    rows = rows.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", "markup")))["markup"], "").alias("markup"))
    head = header.header(header.file_desc(conversation_title()))
    return docs_.emitted(rows.select(F.col("conv_id").cast("string").alias("doc_key"), xml.document_xml(head, F.col("markup"), F.col("markup") == "").alias("xml")))


@query(f"SELECT doc_key, CASE WHEN {forbidden('xml')} IS NULL THEN xml END AS xml FROM ({conversation_xml()})")
def emit_documents(spark, sf_dir):
    return conversation_markup(table(spark, sf_dir, "conversations")).select("doc_key", "xml")


_TITLE_XML = f"'<TEI><teiHeader><fileDesc><title>' || {escaped(trimmed('raw'), '&<>')} || '</title></fileDesc></teiHeader><text><body/></text></TEI>'"


@query(f"""SELECT doc_key, CASE WHEN c IS NULL THEN xml END AS xml, '{XML}{FORBIDDEN_ERROR}' || {point('c')} AS error
FROM (SELECT doc_id::VARCHAR AS doc_key, {_TITLE_XML} AS xml, {forbidden('raw')} AS c FROM ({TITLED}) WHERE {blank_null('raw')} IS NOT NULL)""")
def emit_errors(spark, sf_dir):
    own = docs_.from_titles(titled(spark, sf_dir), F.col("doc_id"), F.col("raw"))
    return docs_.emit(own.where("error is null"))


@query(_BLOCKS)
def round_trip_conversations(spark, sf_dir):
    own = docs_.parse(conversation_markup(table(spark, sf_dir, "conversations")), "doc_key", "xml")
    return docs_.blocks_long(own).select("doc_key", "block_pos", "kind", "id", "who", body.flat_text(F.col("inline")).alias("text"))


@query("SELECT doc_id::VARCHAR AS doc_key, true AS same FROM documents")
def round_trip_idempotent(spark, sf_dir):
    first = docs_.emit(text_documents(table(spark, sf_dir, "documents")))
    again = docs_.parse(first, "doc_key", "xml", keep=("xml",)).select("doc_key", "xml", xml.blocks_document(F.col("header"), F.col("blocks")).alias("again"))
    return again.select("doc_key", F.col("xml").eqNullSafe(F.col("again")).alias("same"))


_HTML = "replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_HEADED = "'<TEI><teiHeader><fileDesc><title> Page ' || page_id || ' </title></fileDesc></teiHeader><text><body>'"
# Each page's whole source within a document that has a fault, by key.
_BROKEN = f"""CASE page_id % 6
 WHEN 0 THEN '<TEI><text><body><p>' || {_HTML} || '</p></body></text></TEI>'
 WHEN 1 THEN {_HEADED} || '<p>' || {_HTML} || '</p>'
 WHEN 2 THEN '<TEI><teiHeader><fileDesc><title>   </title><synopsis>' || {_HTML} || '</synopsis></fileDesc></teiHeader><text><body/></text></TEI>'
 WHEN 3 THEN {_HEADED} || '<div>' || {_HTML} || '</div></body></text></TEI>'
 WHEN 4 THEN {_HEADED} || '<p>' || {_HTML} || '<b/></p></body></text></TEI>'
 ELSE {_HEADED} || ' <p>' || {_HTML} || '</p> </body></text></TEI>' END AS raw"""


@query(f"""SELECT page_id::VARCHAR AS doc_key, CASE WHEN page_id % 6 = 5 THEN 'Page ' || page_id END AS title, CASE WHEN page_id % 6 = 5 THEN html END AS text, '{XML}' || CASE page_id % 6 WHEN 0 THEN 'missing field `teiHeader`' WHEN 1 THEN 'start tag not closed'
 WHEN 2 THEN '{TITLE}' WHEN 3 THEN 'unknown variant `div`, expected `p` or `u`' WHEN 4 THEN 'data did not match any variant of untagged enum Inline' END AS error FROM pages""")
def parse_errors(spark, sf_dir):
    own = docs_.parse(table(spark, sf_dir, "pages").selectExpr("page_id", _BROKEN), "page_id", "raw")
    return own.select("doc_key", F.col("header.fileDesc.title").alias("title"), body.flat_text(F.flatten(F.transform("blocks", lambda b: b["inline"]))).alias("text"), "error")


@query("SELECT page_id::VARCHAR AS doc_key, true AS rejected FROM pages")
def parse_pages(spark, sf_dir):
    """Web pages are no documents: each gives an error, none fails the job."""
    own = docs_.parse(table(spark, sf_dir, "pages"), "page_id", "html")
    return own.select("doc_key", F.col("error").isNotNull().alias("rejected"))


@query(f"""SELECT doc_key, '{{"teiHeader":{{"fileDesc":{{"title":"Conversation ' || doc_key || '"}}}},"text":{{"body":{{"$value":[' || string_agg(CASE WHEN kind = 'p' THEN '{{"p":{{"@xml:id":"' || id || '","$value":["' || t || '"]}}}}' ELSE '{{"u":{{"@xml:id":"' || id || '","@who":"' || who || '","$value":["' || t || '"]}}}}' END, ',' ORDER BY block_pos) || ']}}}}}}' AS json
FROM (SELECT *, replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') AS t FROM ({_BLOCKS})) GROUP BY doc_key""")
def document_json(spark, sf_dir):
    own = conversation_documents(table(spark, sf_dir, "conversations"))
    head = header.header(header.file_desc(F.col("header.fileDesc.title")))
    return own.select("doc_key", json.document_json(head, F.col("blocks")).alias("json"))


@query("SELECT conv_id::VARCHAR AS doc_key, true AS same FROM conversations GROUP BY conv_id")
def round_trip_json(spark, sf_dir):
    own = conversation_documents(table(spark, sf_dir, "conversations")).withColumn("own", F.struct("header", "blocks"))
    written = own.select("doc_key", json.document_json(F.col("header"), F.col("blocks")).alias("json"), "own")
    again = docs_.parse_json(written, "doc_key", "json", keep=("own",))
    return again.select("doc_key", F.col("own").eqNullSafe(F.struct("header", "blocks")).alias("same"))


@query("SELECT conv_id::VARCHAR AS doc_key, true AS same FROM conversations GROUP BY conv_id")
def round_trip_msgpack(spark, sf_dir):
    own = conversation_documents(table(spark, sf_dir, "conversations")).withColumn("own", F.struct("header", "blocks"))
    again = docs_.parse(docs_.to_msgpack(own, ("own",)), "doc_key", "packed", "msgpack", keep=("own",))
    return again.select("doc_key", F.col("own").eqNullSafe(F.struct("header", "blocks")).alias("same"))


# Extensions ---------------------------------------------------------------------------------


@query("SELECT doc_key, id, count(*)::BIGINT AS uses FROM (SELECT conv_id::VARCHAR AS doc_key, 'r-' || role AS id FROM conversations) GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    own = conversation_documents(table(spark, sf_dir, "conversations"))
    by_role = F.transform("blocks", lambda b: b.withField("id", F.concat(F.lit("r-"), F.coalesce(b["who"], F.lit("system")))))
    return validate.duplicate_ids(own.withColumn("blocks", by_role))


@query("SELECT DISTINCT conv_id::VARCHAR AS doc_key, role AS who FROM conversations WHERE role NOT IN ('system', 'user')")
def dangling_speakers(spark, sf_dir):
    own = conversation_documents(table(spark, sf_dir, "conversations"))
    head = header.header(header.file_desc(F.lit("x")), header.profile_desc(speakers=F.array(F.lit("user"))))
    return validate.dangling_speakers(own.withColumn("header", head))


@query(f"SELECT doc_key, block_pos, coalesce(who, 'Narrator') AS speaker, text FROM (SELECT doc_key, block_pos, CASE WHEN block_pos % 3 = 0 THEN NULL ELSE who END AS who, kind, text FROM ({_BLOCKS})) WHERE kind = 'u'")
def utterance_list(spark, sf_dir):
    own = conversation_documents(table(spark, sf_dir, "conversations"))
    some = F.transform("blocks", lambda b, i: b.withField("who", F.when(i % 3 != 0, b["who"])))
    return validate.utterance_list(own.withColumn("blocks", some))


@query(f"""WITH b AS ({_BLOCKS}), a AS (SELECT doc_key, block_pos, text FROM b), c AS (SELECT doc_key, block_pos, CASE WHEN block_pos = 1 THEN text || '!' ELSE text END AS text FROM b WHERE block_pos < 4)
SELECT doc_key, block_pos, CASE WHEN c.doc_key IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a LEFT JOIN c USING (doc_key, block_pos) WHERE c.text IS DISTINCT FROM a.text""")
def semantic_diff(spark, sf_dir):
    own = conversation_documents(table(spark, sf_dir, "conversations"))
    louder = F.transform(F.slice("blocks", 1, 4), lambda b, i: F.when(i == 1, b.withField("inline", F.transform(b["inline"], lambda t: t.withField("text", F.concat(t["text"], F.lit("!")))))).otherwise(b))
    return validate.differences(own, own.withColumn("blocks", louder))


@query(f"""WITH b AS (SELECT doc_key, block_pos, id, count(*) OVER (PARTITION BY doc_key) AS n FROM ({_BLOCKS}))
SELECT doc_key, 'added' AS change, -1::BIGINT AS left_pos, 0::BIGINT AS right_pos, 'new' AS id FROM b WHERE block_pos = 0
UNION ALL SELECT doc_key, 'changed', 1, 2, id FROM b WHERE block_pos = 1
UNION ALL SELECT doc_key, 'moved', 2, n - 1, id FROM b WHERE block_pos = 2 AND n > 5
UNION ALL SELECT doc_key, 'removed', 3, -1, id FROM b WHERE block_pos = 3 AND n > 4""")
def aligned_diff(spark, sf_dir):
    """A block put in front, the second one louder, the third at the end, the fourth taken out."""
    own = conversation_documents(table(spark, sf_dir, "conversations"))
    new = F.array(F.struct(F.lit("p").alias("kind"), F.lit("new").alias("id"), F.lit(None).cast("string").alias("who"), body.text(F.lit("x")).alias("inline")).cast(body.BLOCK))
    louder = F.transform("blocks", lambda b, i: F.when(i == 1, b.withField("inline", F.transform(b["inline"], lambda t: t.withField("text", F.concat(t["text"], F.lit("!")))))).otherwise(b))
    moved = F.size("blocks") > 5
    kept = F.filter(louder, lambda b, i: ~(moved & (i == 2)) & ~((F.size("blocks") > 4) & (i == 3)))
    later = own.withColumn("blocks", F.concat(new, kept, F.when(moved, F.slice(louder, 3, 1)).otherwise(body.empty_body())))
    none = F.lit(-1).cast("bigint")
    return validate.aligned_differences(own, later).select("doc_key", "change", F.coalesce("left_pos", none).alias("left_pos"), F.coalesce("right_pos", none).alias("right_pos"), "id")


_BLOCK_XML = f"CASE WHEN kind = 'p' THEN '<p xml:id=\"' || id || '\">' || {escaped('text', '&<>')} || '</p>' ELSE '<u xml:id=\"' || id || '\" who=\"' || who || '\">' || {escaped('text', '&<>')} || '</u>' END"


@query(f"""WITH b AS (SELECT doc_key, block_pos, sha256({_BLOCK_XML}) AS d FROM ({_BLOCKS})),
s AS (SELECT doc_key, block_pos // 64 AS section, sha256(string_agg(d, '' ORDER BY block_pos)) AS d FROM b GROUP BY ALL)
SELECT doc_key, sha256(sha256('<teiHeader><fileDesc><title>Conversation ' || doc_key || '</title></fileDesc></teiHeader>') || string_agg(d, '' ORDER BY section)) AS document, count(*)::BIGINT AS sections FROM s GROUP BY doc_key""")
def digest_trees(spark, sf_dir):
    own = conversation_documents(table(spark, sf_dir, "conversations"))
    own = own.withColumn("header", header.header(header.file_desc(F.col("header.fileDesc.title"))))
    return validate.digests(own).select("doc_key", "document", F.size("sections").cast("bigint").alias("sections"))


@query(f"""WITH l AS (SELECT doc_id::VARCHAR AS doc_key, len(list_filter(string_split(text, chr(10)), lambda x: {trimmed('x')} <> '')) AS n FROM documents)
SELECT doc_key, ((n // 2) // 64)::BIGINT AS section, (n // 2)::BIGINT AS block_pos FROM l WHERE n > 0
UNION ALL SELECT doc_key, (n // 64)::BIGINT, n::BIGINT FROM l""")
def changed_blocks(spark, sf_dir):
    """The middle line of each document changed, and one put at the end: two paths of the tree."""
    own = text_documents(table(spark, sf_dir, "documents"))
    line = lambda t: F.struct(F.lit("p").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("who"), body.text(t).alias("inline")).cast(body.BLOCK)
    middle = F.floor(F.size("blocks") / 2).cast("int")
    later = F.transform("blocks", lambda b, i: F.when(i == middle, line(F.concat(body.flat_text(b["inline"]), F.lit("!")))).otherwise(b))
    return validate.changed_sections(validate.digests(own), validate.digests(own.withColumn("blocks", F.concat(later, F.array(line(F.lit("end")))))))


# Stand-off spans, each from the middle of a turn to the middle of the next one.
_OFF = ("CAST(conv_id AS STRING) AS doc_key", "CASE turn % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS type", "'#tool' AS resp", "'s' || turn AS span_id", "'#c' || conv_id || '-t' || turn || ':' || CAST(length(text) DIV 2 AS STRING) AS `from`", "'#c' || conv_id || '-t' || (turn + 1) || ':3' AS `to`", "CASE WHEN turn % 3 = 0 THEN NULL ELSE 'a&' || role END AS ana")
_OFF_ROWS = "SELECT conv_id::VARCHAR AS doc_key, CASE turn % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS type, '#tool' AS resp, 's' || turn AS span_id, '#c' || conv_id || '-t' || turn || ':' || (length(text) // 2) AS \"from\", '#c' || conv_id || '-t' || (turn + 1) || ':3' AS \"to\", CASE WHEN turn % 3 = 0 THEN NULL ELSE 'a&' || role END AS ana"


@query(f"{_OFF_ROWS}, NULL::VARCHAR AS error FROM conversations")
def standoff_round_trip(spark, sf_dir):
    """Spans behind the documents' texts in XML, and read from there again."""
    c = table(spark, sf_dir, "conversations")
    whole = standoff.with_standoff(conversation_markup(c).select("doc_key", "xml"), c.selectExpr(*_OFF))
    return standoff.parse_standoff(whole, "doc_key", "xml")


@query(f"""WITH b AS (SELECT doc_key, block_pos, id, text, lead(text) OVER (PARTITION BY doc_key ORDER BY block_pos) AS after, lead(id) OVER (PARTITION BY doc_key ORDER BY block_pos) AS next_id FROM ({_BLOCKS})),
s AS (SELECT doc_key, 's' || split_part(id, '-t', 2) AS span_id, text, after, next_id = 'c' || doc_key || '-t' || (split_part(id, '-t', 2)::INT + 1) AS known FROM b)
SELECT doc_key, span_id, CASE WHEN known AND length(after) >= 3 THEN substr(text, length(text) // 2 + 1) || left(after, 3) END AS text, CASE WHEN known IS NOT TRUE THEN 'unknown block' WHEN length(after) < 3 THEN 'outside the block' END AS error FROM s""")
def standoff_texts(spark, sf_dir):
    """The texts of spans that cross blocks, and the errors of those without an end."""
    c = table(spark, sf_dir, "conversations")
    docs = conversation_documents(c)
    spans = standoff.resolved(c.selectExpr(*_OFF), docs)
    return spans.select("doc_key", "span_id", "error").join(standoff.texts(spans, docs), ["doc_key", "span_id"], "left").select("doc_key", "span_id", "text", "error")


# Two spans of each turn that cross, by thirds of its text, and one around a sixth within the first.
_CROSS = "inline(array(named_struct('span_id', 'a', 'lo', 0, 'hi', 2 * (length(text) DIV 3)), named_struct('span_id', 'b', 'lo', length(text) DIV 3, 'hi', length(text)), named_struct('span_id', 'c', 'lo', 0, 'hi', length(text) DIV 6)))"


def _crossing(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations")
    rows = c.selectExpr("conv_id", "turn", _CROSS).selectExpr("CAST(conv_id AS STRING) AS doc_key", "'t' || turn || span_id AS span_id", "'#c' || conv_id || '-t' || turn || ':' || lo AS `from`", "'#c' || conv_id || '-t' || turn || ':' || hi AS `to`")
    docs = conversation_documents(c)
    return standoff.resolved(rows, docs), docs


_PART = lambda a, b: escaped(f"substr(text, {a} + 1, {b} - {a})", "&<>")


@query(f"""SELECT doc_key, block_pos, '<hi rend="#' || t || 'a"><hi rend="#' || t || 'c">' || {_PART('0', 'n // 6')} || '</hi>' || {_PART('n // 6', 'n // 3')} || '<hi rend="#' || t || 'b">' || {_PART('n // 3', '2 * (n // 3)')}
  || '</hi></hi><hi rend="#' || t || 'b">' || {_PART('2 * (n // 3)', 'n')} || '</hi>' AS xml, 4::BIGINT AS pieces, text
FROM (SELECT doc_key, block_pos, text, length(text) AS n, 't' || split_part(id, '-t', 2) AS t FROM ({_BLOCKS})) WHERE n >= 6""")
def woven_spans(spark, sf_dir):
    """Crossing spans as nested emphases: the one that crosses falls into two."""
    rows = standoff.weave(*_crossing(spark, sf_dir)).where(F.length(body.flat_text(F.col("inline"))) >= 6)
    return rows.select("doc_key", "block_pos", xml.inline_xml(F.col("inline")).alias("xml"), F.size(F.filter("inline", lambda t: t["kind"] == "hi")).cast("bigint").alias("pieces"), body.flat_text(F.col("inline")).alias("text"))


@query(f"""WITH b AS (SELECT doc_key, block_pos, length(text) AS n, '#t' || split_part(id, '-t', 2) AS t FROM ({_BLOCKS})),
s AS (SELECT doc_key, block_pos, unnest([t || 'a', t || 'b', t || 'c']) AS rend, unnest([0, n // 3, 0]) AS start, unnest([2 * (n // 3), n, n // 6]) AS stop FROM b)
SELECT doc_key, block_pos, rend, start::BIGINT AS start, stop::BIGINT AS stop FROM s WHERE start < stop""")
def unwoven_spans(spark, sf_dir):
    """Emphases taken out again are the spans that were woven in."""
    rows = standoff.unweave(standoff.weave(*_crossing(spark, sf_dir)))
    return rows.select("doc_key", "block_pos", F.explode("marks").alias("m")).select("doc_key", "block_pos", "m.rend", "m.start", "m.stop")


@query(f"SELECT doc_key, length(xml)::BIGINT AS length, sha256(xml) AS hash FROM ({conversation_xml()})")
def piecewise_emission(spark, sf_dir):
    """Markup made token by token and joined only to show that it is the canonical one."""
    own = conversation_documents(table(spark, sf_dir, "conversations"))
    heads = own.select("doc_key", header.header(header.file_desc(F.col("header.fileDesc.title"))).alias("header"))
    made = pieces.markup_pieces(pieces.markup_rows(heads, docs_.blocks_long(own).drop("inline"), docs_.tokens_long(own)))
    whole = made.groupBy("doc_key").agg(F.array_sort(F.collect_list(F.struct("piece_pos", "piece"))).alias("s"))
    markup = whole.select("doc_key", F.array_join(F.transform("s", lambda x: F.concat(x["piece"], F.lit(">"))), "").alias("xml"))
    return markup.select("doc_key", F.length("xml").cast("bigint").alias("length"), validate.content_hash(F.col("xml")).alias("hash"))


@query(f"SELECT doc_key, sha256(xml) AS hash FROM ({conversation_xml()})")
def content_hash(spark, sf_dir):
    return conversation_markup(table(spark, sf_dir, "conversations")).select("doc_key", validate.content_hash(F.col("xml")).alias("hash"))


@query("SELECT conv_id::VARCHAR AS doc_key, count(*)::BIGINT AS blocks, count(*)::BIGINT AS segments, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::BIGINT AS words FROM conversations GROUP BY conv_id")
def word_counts(spark, sf_dir):
    return validate.word_counts(conversation_documents(table(spark, sf_dir, "conversations")))


_SPAN = ("CAST(conv_id AS STRING) AS doc_key", "turn AS span_id", "'c' || conv_id || '-t' || (turn + CASE WHEN turn % 7 = 6 THEN 1000 ELSE 0 END) AS block_id", "CAST(turn % 3 AS INT) AS start", "CASE WHEN turn % 5 = 4 THEN 0 WHEN turn % 11 = 1 THEN NULL ELSE 100 END AS stop")
_SPANS = f"SELECT {', '.join(_SPAN)} FROM conversations"


@query(f"""SELECT s.doc_key, s.span_id, CASE WHEN b.text IS NULL THEN 'unknown block' WHEN s.stop IS NULL THEN 'span without start or end' WHEN s.start >= s.stop THEN 'empty span' ELSE 'outside the block' END AS error
FROM ({_SPANS}) s LEFT JOIN ({_BLOCKS}) b ON b.doc_key = s.doc_key AND b.id = s.block_id WHERE b.text IS NULL OR s.stop IS NULL OR s.start >= s.stop OR s.stop > length(b.text)""")
def span_errors(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return validate.span_errors(c.selectExpr(*_SPAN), conversation_documents(c))


@query(f"SELECT s.doc_key, s.span_id, substr(b.text, s.start + 1, 20) AS text FROM (SELECT *, start + 20 AS other FROM ({_SPANS})) s JOIN ({_BLOCKS}) b ON b.doc_key = s.doc_key AND b.id = s.block_id")
def span_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    spans = c.selectExpr(*_SPAN).withColumn("stop", F.col("start") + 20)
    return validate.span_texts(spans, conversation_documents(c))


@query(f"SELECT doc_id, {blank_null('raw')} AS value, CASE WHEN {blank_null('raw')} IS NULL THEN '{FIELD.format(LANGUAGE)}' END AS error FROM (SELECT doc_id, {hostile('lang', 'doc_id')} AS raw FROM documents)")
def language_errors(spark, sf_dir):
    own = table(spark, sf_dir, "documents").selectExpr("doc_id", f"{hostile('lang', 'doc_id')} AS raw")
    return own.select("doc_id", header.language_tag(F.col("raw")).alias("l")).select("doc_id", "l.value", "l.error")


# Setters and pushes: a rejected change leaves the old value ---------------------------------


def _turns(spark, sf_dir, *more: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "role", "text", f"{hostile('role', 'turn')} AS raw", *more)


_RAW = f"SELECT conv_id, turn, role, text, {hostile('role', 'turn')} AS raw FROM conversations"


def _checked(name: str, message: str, validator) -> None:
    """A query of a validator over hostile roles: value and error."""

    @query(f"SELECT conv_id, turn, {blank_null('raw')} AS value, CASE WHEN {blank_null('raw')} IS NULL THEN '{message}' END AS error FROM ({_RAW})")
    def run(spark, sf_dir):
        return _turns(spark, sf_dir).select("conv_id", "turn", validator(F.col("raw")).alias("v")).select("conv_id", "turn", "v.value", "v.error")

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


_checked("speaker_names", FIELD.format(SPEAKER_NAME), header.speaker_name)
_checked("responsible_parties", FIELD.format(RESPONSIBLE), header.responsible_party)
_checked("speaker_references", SPEAKER, header.speaker)


@query(f"SELECT doc_id, {blank_null('raw')} AS series, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'kept' END AS synopsis FROM ({TITLED})")
def file_setters(spark, sf_dir):
    first = header.file_desc(F.lit("x"), F.lit("old"), F.lit(" kept "))
    own = header.with_text(first, "series", F.col("raw"))
    rows = titled(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, header.with_text(own, "synopsis", F.lit(" "))).otherwise(own).alias("f"))
    return rows.select("doc_id", "f.series", "f.synopsis")


@query(f"""SELECT conv_id, turn, CASE WHEN v IS NULL THEN 'first' ELSE 'first,' || v || ',' || v END AS speakers, CASE WHEN v IS NULL THEN '{FIELD.format(SPEAKER_NAME)}' END AS error,
  CASE WHEN v IS NULL THEN 'en' ELSE 'en,' || v END AS languages FROM (SELECT conv_id, turn, {blank_null('raw')} AS v FROM ({_RAW}))""")
def profile_growth(spark, sf_dir):
    """Repeated names stay; a blank one changes nothing."""
    raw = F.col("raw")
    once = header.add_speaker(header.profile_desc(speakers=F.array(F.lit("first")), languages=F.array(F.lit("en"))), raw)
    rows = _turns(spark, sf_dir).select("conv_id", "turn", "raw", once["error"].alias("error"), header.add_speaker(once["value"], raw)["value"].alias("p"))
    rows = rows.withColumn("p", header.add_language(F.col("p"), raw)["value"])
    return rows.select("conv_id", "turn", F.array_join("p.speaker", ",").alias("speakers"), "error", F.array_join("p.lang", ",").alias("languages"))


@query("""SELECT doc_id, 'lang,source,lang' AS ids, lang AS first_lang, source AS first_source, NULL::VARCHAR AS other_case, false AS is_empty FROM documents""")
def encoding_growth(spark, sf_dir):
    """Identifiers may repeat; the first of them is found."""
    e = header.encoding_desc()
    for name, value in (("lang", F.col("lang")), (" source ", F.col("source")), ("lang", F.lit("later"))):
        e = header.add_annotation_system(e, header.annotation_system(F.lit(name), value))["value"]
    rows = table(spark, sf_dir, "documents").select("doc_id", e.alias("e"))
    first = lambda k: header.find_annotation_system(F.col("e"), F.lit(k))["desc"]
    return rows.select("doc_id", F.array_join(F.transform("e.annotationSystem", lambda s: s["id"]), ",").alias("ids"), first("lang").alias("first_lang"), first("source").alias("first_source"), first("Lang").alias("other_case"), header.encoding_is_empty(F.col("e")).alias("is_empty"))


@query(f"""SELECT conv_id, turn, 'made' || coalesce(',' || v || '/' || role, '') AS log, CASE WHEN v IS NULL THEN 1 ELSE 2 END::BIGINT AS changes, CASE WHEN v IS NULL THEN '{FIELD.format(REVISION)}' END AS error
FROM (SELECT conv_id, turn, role, {blank_null('raw')} AS v FROM ({_RAW}))""")
def revision_growth(spark, sf_dir):
    """A blank note appends nothing."""
    change = header.revision_change(F.col("raw"), F.concat(F.lit(" "), F.col("role")))
    first = header.revision_desc(F.array(header.revision_change(F.lit("made"), F.lit(" "))["value"]))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", header.add_change(first, change).alias("r")).select("conv_id", "turn", "r.error", F.col("r.value.change").alias("c"))
    return rows.select("conv_id", "turn", F.array_join(F.transform("c", lambda c: F.concat_ws("/", c["description"], c["resp"])), ",").alias("log"), F.size("c").cast("bigint").alias("changes"), "error")


@query(f"""SELECT conv_id, turn, 'first' || coalesce(',' || v, '') AS ids, CASE WHEN v IS NULL THEN '{FIELD.format(SYSTEM)}' END AS error, CASE WHEN v IS NOT NULL THEN text END AS found
FROM (SELECT conv_id, turn, text, {blank_null('raw')} AS v FROM ({_RAW}))""")
def rejected_systems(spark, sf_dir):
    """A system without identifier appends nothing; one with it is found."""
    first = header.add_annotation_system(header.encoding_desc(), header.annotation_system(F.lit("first"), F.lit(None).cast("string")))["value"]
    rows = _turns(spark, sf_dir).select("conv_id", "turn", "raw", header.add_annotation_system(first, header.annotation_system(F.col("raw"), F.col("text"))).alias("e"))
    own = header.find_annotation_system(F.col("e.value"), header.annotation_system_id(F.col("raw"))["value"])
    return rows.select("conv_id", "turn", F.array_join(F.transform("e.value.annotationSystem", lambda s: s["id"]), ",").alias("ids"), "e.error", own["desc"].alias("found"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '<teiHeader><fileDesc><title>x</title></fileDesc><profileDesc><lang>' || lang || '</lang></profileDesc></teiHeader>'
  WHEN 1 THEN '<teiHeader><fileDesc><title>x</title></fileDesc><encodingDesc/></teiHeader>' ELSE '<teiHeader><fileDesc><title>x</title></fileDesc><revisionDesc/></teiHeader>' END AS xml FROM documents""")
def section_setters(spark, sf_dir):
    """The section that is set last stays, empty or not."""
    bare = header.header(header.file_desc(F.lit("x")))
    old = header.with_section(bare, "profileDesc", header.profile_desc(F.lit("old")).cast(header.PROFILE))
    new = header.with_section(old, "profileDesc", header.profile_desc(languages=F.array("lang")).cast(header.PROFILE))
    encoding = header.with_section(bare, "encodingDesc", header.encoding_desc().cast(header.ENCODING))
    revision = header.with_section(bare, "revisionDesc", header.revision_desc().cast(header.REVISION))
    head = F.when(F.col("doc_id") % 3 == 0, new).when(F.col("doc_id") % 3 == 1, encoding).otherwise(revision)
    return table(spark, sf_dir, "documents").select("doc_id", head.alias("h")).select("doc_id", xml.header_xml(F.col("h")).alias("xml"))


@query("SELECT conv_id, turn, 'p:' || text || '|u:' || role || ':' || text || '|p:end' AS body, 3::BIGINT AS blocks FROM conversations")
def pushed_blocks(spark, sf_dir):
    text = F.array("text")
    blocks = body.empty_body()
    for block in (body.paragraph_of(text), body.utterance_of(F.col("role"), text), body.paragraph_of(F.array(F.lit("end")))):
        blocks = body.push_block(blocks, block["value"])
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", blocks.alias("b"))
    shown = F.transform("b", lambda b: F.concat_ws(":", b["kind"], b["who"], body.flat_text(b["inline"])))
    return rows.select("conv_id", "turn", F.array_join(shown, "|").alias("body"), body.count_blocks(F.col("b")).alias("blocks"))


@query(f"""SELECT conv_id, turn, {blank_null('raw')} AS who, CASE WHEN {blank_null('raw')} IS NULL THEN '{SPEAKER}' END AS error, true AS same FROM ({_RAW})""")
def deprecated_builders(spark, sf_dir):
    """The old names give what the new ones give."""
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        p, u = body.new_paragraph(F.array("text")), body.new_utterance(F.col("raw"), F.array("text"))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", u.alias("u"), (p.eqNullSafe(body.paragraph_of(F.array("text"))) & u.eqNullSafe(body.utterance_of(F.col("raw"), F.array("text")))).alias("same"))
    return rows.select("conv_id", "turn", "u.value.who", "u.error", "same")


_CONTAINER = "CASE WHEN role = 'system' THEN 'paragraph' ELSE 'utterance' END"


@query(f"""SELECT conv_id, turn, CASE WHEN error IS NULL THEN v ELSE 'old' END AS id, error, NULL::VARCHAR AS cleared FROM (
  SELECT conv_id, turn, v, CASE WHEN v = '' THEN {_CONTAINER} || '{CONTAINER_ID_EMPTY.format("")}' WHEN regexp_matches(v, '[{SPACES}]') THEN {_CONTAINER} || '{CONTAINER_ID_SPACE.format("")}' END AS error
  FROM (SELECT conv_id, turn, role, {trimmed('raw')} AS v FROM (SELECT conv_id, turn, role, {_ID} FROM conversations)))""")
def block_identifiers(spark, sf_dir):
    block = body.set_id(turn_block(), F.lit(" old "))["value"]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_ID), block.alias("b")).select("conv_id", "turn", body.set_id(F.col("b"), F.col("raw")).alias("s"))
    return rows.select("conv_id", "turn", "s.value.id", "s.error", body.clear_id(F.col("s.value"))["id"].alias("cleared"))


@query(f"SELECT conv_id, turn, coalesce({blank_null('raw')}, 'old') AS who, CASE WHEN {blank_null('raw')} IS NULL THEN '{SPEAKER}' END AS error, NULL::VARCHAR AS cleared FROM ({_RAW})")
def block_speakers(spark, sf_dir):
    block = body.set_speaker(body.utterance_of(None, F.array("text"))["value"], F.lit(" old "))["value"]
    rows = _turns(spark, sf_dir).select("conv_id", "turn", "raw", block.alias("b")).select("conv_id", "turn", body.set_speaker(F.col("b"), F.col("raw")).alias("s"))
    return rows.select("conv_id", "turn", "s.value.who", "s.error", body.clear_speaker(F.col("s.value"))["who"].alias("cleared"))


_BLANK = f"{blank_null('raw')} IS NULL"


@query(f"""SELECT conv_id, turn, text || CASE WHEN {_BLANK} THEN '' ELSE raw END || 'last' AS text, CASE WHEN {_BLANK} THEN {_CONTAINER} || '{SEGMENT.format("")}' END AS error,
  {_CONTAINER} || '{CONTENT.format("")}' AS inline_error FROM ({_RAW})""")
def pushed_content(spark, sf_dir):
    """A blank segment or an empty emphasis isn't appended."""
    rows = _turns(spark, sf_dir).select("conv_id", "turn", "raw", body.push_segment(turn_block(), F.col("raw")).alias("s"))
    rows = rows.select("conv_id", "turn", "s.error", body.push_inline(F.col("s.value"), body.hi(body.empty_tokens())).alias("i"))
    more = body.push_inline(F.col("i.value"), body.joined(body.pause(), body.hi(body.text(F.lit("last")))))["value"]
    return rows.select("conv_id", "turn", body.flat_text(more["inline"]).alias("text"), "error", F.col("i.error").alias("inline_error"))


@query(f"""SELECT conv_id, turn, CASE WHEN error IS NULL THEN {blank_null('raw')} END AS who, error, CASE WHEN {_BLANK} THEN '{SPEAKER}' WHEN turn % 3 = 0 THEN '{CONTENT.format("utterance")}' END AS inline_error FROM (
  SELECT *, CASE WHEN {_BLANK} THEN '{SPEAKER}' WHEN turn % 3 = 0 THEN '{SEGMENT.format("utterance")}' END AS error FROM ({_RAW}))""")
def validated_utterances(spark, sf_dir):
    """A wrong speaker is reported before wrong content."""
    third = F.col("turn") % 3 == 0
    by_text = body.utterance_of(F.col("raw"), F.array("text", F.when(third, " ").otherwise("x")))
    by_inline = body.utterance(F.col("raw"), F.when(third, body.hi(body.empty_tokens())).otherwise(body.text(F.col("text"))))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", by_text.alias("t"), by_inline["error"].alias("inline_error"))
    return rows.select("conv_id", "turn", "t.value.who", "t.error", "inline_error")


@query(f"""SELECT conv_id, turn, CASE WHEN NOT ({_BLANK}) THEN '<p><hi rend=" r ">' || {escaped('raw', '&<>')} || '</hi></p>' END AS xml, CASE WHEN {_BLANK} THEN '{SEGMENT.format("hi")}' END AS error,
  CASE WHEN {_BLANK} THEN '<p><hi>a</hi></p>' ELSE '<p><hi rend="' || turn || '">a' || {escaped('raw', '&<>')} || '</hi></p>' END AS pushed, '{CONTENT.format("hi")}' AS empty FROM ({_RAW})""")
def emphases(spark, sf_dir):
    """Checked emphases; their attribute set and cleared; content pushed into them."""
    raw, a = F.col("raw"), body.hi(body.text(F.lit("a")), F.lit("first"))
    pushed = body.push_into_hi(a, body.text(raw))
    rend = F.when(pushed["error"].isNull(), F.col("turn").cast("string"))
    marked = F.transform(pushed["value"], lambda t: F.when(t["kind"] == "hi", body.with_attribute(body.with_attribute(t, "rend", None), "rend", rend)).otherwise(t))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", body.checked_hi(body.text(raw), F.lit(" r ")).alias("h"), body.paragraph(marked)["value"].alias("p"), body.checked_hi(body.empty_tokens())["error"].alias("empty"))
    return rows.select("conv_id", "turn", F.when(F.col("h.error").isNull(), xml.block_xml(body.paragraph(F.col("h.value"))["value"])).alias("xml"), "h.error", xml.block_xml(F.col("p")).alias("pushed"), "empty")


@query("SELECT conv_id, turn, '<p><pause' || CASE WHEN turn % 2 = 0 THEN ' dur=\"PT' || turn || 'S\"' ELSE '' END || ' type=\"' || role || '\"/></p>' AS xml FROM conversations")
def pause_attributes(spark, sf_dir):
    duration = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("PT"), F.col("turn").cast("string"), F.lit("S")))
    first = body.pause(F.lit("PT9S"), F.lit("old"))
    own = F.transform(first, lambda t: body.with_attribute(body.with_attribute(body.with_attribute(t, "dur", None), "dur", duration), "type", F.col("role")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", body.paragraph(own)["value"].alias("p")).select("conv_id", "turn", xml.block_xml(F.col("p")).alias("xml"))


_BLANK_LINES = f"len(list_filter(lines, lambda x: {trimmed('x')} = '')) > 0"


@query(f"""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CASE WHEN {_BLANK_LINES} THEN '{SEGMENT.format("paragraph")}' END WHEN 1 THEN CASE WHEN {_BLANK_LINES} THEN '{SEGMENT.format("utterance")}' ELSE '{CONTENT.format("utterance")}' END
  WHEN 2 THEN '{CONTENT.format("paragraph")}' WHEN 3 THEN CASE WHEN {_BLANK_LINES} THEN '{SEGMENT.format("hi")}' END WHEN 4 THEN CASE WHEN {_BLANK_LINES} THEN '{SEGMENT.format("utterance")}' END END AS error FROM ({_LINES})""")
def content_errors(spark, sf_dir):
    """Lines of whole texts as content, empty and nested content beside them: the first offence,
    under the outer container's name."""
    lines, nothing = body.segments(F.col("lines")), body.empty_tokens()
    cases = [(lines, body.PARAGRAPH), (body.joined(lines, body.hi(body.hi(nothing))), body.UTTERANCE), (body.joined(body.hi(nothing), lines), body.PARAGRAPH), (lines, body.EMPHASIS), (body.joined(body.pause(), body.hi(lines)), body.UTTERANCE)]
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", f"split({hostile('text', 'doc_id')}, '\n', -1) AS lines")
    error = F.lit(None).cast("string")
    for k, (tokens, container) in enumerate(cases):
        error = F.when(F.col("doc_id") % 6 == k, body.content_error(tokens, container)).otherwise(error)
    return rows.select("doc_id", error.alias("error"))


@query(f"""SELECT conv_id, turn, CASE WHEN {_BLANK} THEN 'speaker' END AS kind, CASE WHEN {_BLANK} THEN '{SPEAKER}' END AS message FROM ({_RAW})""")
def error_values(spark, sf_dir):
    """Errors of any operator in one form."""
    rows = _turns(spark, sf_dir).select("conv_id", "turn", docs_.error_of("speaker", header.speaker(F.col("raw"))["error"]).alias("e"))
    return rows.select("conv_id", "turn", "e.kind", "e.message")


# Parser, versions, references, spans, values, streams, SQL ----------------------------------


_NOTES = f"'<TEI><teiHeader><fileDesc><title>T</title></fileDesc><revisionDesc><change>' || CASE WHEN conv_id % 3 = 0 THEN ' ' ELSE {escaped('text', '&<>')} END || '<resp>' || role || '</resp></change></revisionDesc></teiHeader><text><body/></text></TEI>' AS raw"


@query(f"""SELECT conv_id || '/' || turn AS doc_key, CASE WHEN v <> '' THEN v END AS note, CASE WHEN v <> '' THEN role END AS resp, CASE WHEN v = '' THEN '{XML}{NOTE}' END AS error
FROM (SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 THEN '' ELSE {trimmed('text')} END AS v FROM conversations)""")
def parsed_notes(spark, sf_dir):
    """Turns as revision notes, some of them blank."""
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id || '/' || turn AS key", _NOTES)
    change = F.col("header.revisionDesc.change")[0]
    return docs_.parse(rows, "key", "raw").select("doc_key", change["description"].alias("note"), change["resp"].alias("resp"), "error")


# Members of wrong types and nested texts, by key, around each row's whole text (as JSON): JSON
# documents that are none.
_TEXT = "'\"' || replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '\"'"
_JSON = f"""CASE doc_id % 8
 WHEN 0 THEN '{{"teiHeader":{{"fileDesc":{{"title":"D' || doc_id || '","series":5,"synopsis":' || {_TEXT} || '}}}},"text":{{"body":{{"$value":[]}}}}}}'
 WHEN 1 THEN '{{"teiHeader":{{"fileDesc":{{"title":"D' || doc_id || '"}}}},"text":{{"body":{{"$value":[{{"p":{{"$value":[' || {_TEXT} || ']}}}},{{}}]}}}}}}'
 WHEN 2 THEN '{{"teiHeader":{{"fileDesc":{{"title":[' || {_TEXT} || ']}}}},"text":{{"body":{{"$value":[]}}}}}}'
 WHEN 3 THEN '{{"teiHeader":[' || {_TEXT} || '],"text":{{"body":{{"$value":[]}}}}}}'
 WHEN 4 THEN '{{"teiHeader":{{"fileDesc":{{"title":"D"}},"profileDesc":{{"speaker":' || {_TEXT} || '}}}},"text":{{"body":{{"$value":[]}}}}}}'
 WHEN 5 THEN '{{"teiHeader":{{"fileDesc":{{"title":"D"}}}},"text":{{"body":{{"$value":[{{"p":{{"$value":[{{"rend":1,"$value":[' || {_TEXT} || ']}}]}}}}]}}}}}}'
 WHEN 6 THEN '{{"teiHeader":{{"fileDesc":{{"title":"D"}}}},"text":{{"body":{{"$value":[{{"p":{{"@xml:id":7,"$value":[' || {_TEXT} || ']}}}}]}}}}}}'
 ELSE '{{"teiHeader":{{"fileDesc":{{"title":"D' || doc_id || '"}}}},"text":{{"body":{{"$value":[{{"u":{{"@who":"' || lang || '","$value":[' || {_TEXT} || ']}}}}]}}}}}}' END AS raw"""


@query("""SELECT doc_id::VARCHAR AS doc_key, CASE WHEN doc_id % 8 = 7 THEN 'D' || doc_id END AS title, CASE WHEN doc_id % 8 = 7 THEN lang END AS who, CASE WHEN doc_id % 8 = 7 THEN text END AS text, CASE doc_id % 8
 WHEN 0 THEN 'invalid type for `series`: expected a string' WHEN 1 THEN 'a block has one member, `p` or `u`' WHEN 2 THEN 'invalid type for `title`: expected a string' WHEN 3 THEN 'invalid type for `teiHeader`: expected a map'
 WHEN 4 THEN 'invalid type for `speaker`: expected a sequence' WHEN 5 THEN 'invalid type for `rend`: expected a string' WHEN 6 THEN 'invalid type for `@xml:id`: expected a string' END AS error FROM documents""")
def parse_json_errors(spark, sf_dir):
    own = docs_.parse_json(table(spark, sf_dir, "documents").selectExpr("doc_id", _JSON), "doc_id", "raw")
    first = F.get("blocks", 0)
    return own.select("doc_key", F.col("header.fileDesc.title").alias("title"), first["who"].alias("who"), body.flat_text(first["inline"]).alias("text"), "error")


@query("""SELECT conv_id::VARCHAR AS doc_key, conv_id % 4 AS stated, CASE WHEN conv_id % 4 = 3 THEN 3 ELSE 2 END AS model_version, CASE WHEN conv_id % 4 = 3 THEN ' ' END AS series,
  CASE WHEN conv_id % 4 = 3 THEN 'model version 3 is not known; this is version 2' END AS version_error FROM conversations GROUP BY conv_id""")
def model_versions(spark, sf_dir):
    own = conversation_documents(table(spark, sf_dir, "conversations")).withColumn("stated", F.col("doc_key").cast("long") % 4)
    old = own.withColumn("header", F.col("header").withField("fileDesc", F.col("header.fileDesc").withField("series", F.when(F.col("stated") != 2, " "))))
    got = validate.versioned(old.withColumn("model_version", F.when(F.col("stated") != 1, F.col("stated"))))
    return got.select("doc_key", "stated", "model_version", "header.fileDesc.series", "version_error")


@query("""SELECT conv_id::VARCHAR AS doc_key, 'to' AS attribute, 'c' || conv_id || '-t' || (turn + 1) AS target FROM conversations c
WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)""")
def dangling_references(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    pointers = c.selectExpr("CAST(conv_id AS STRING) AS doc_key", "'#c' || conv_id || '-t' || turn AS `from`", "'c' || conv_id || '-t' || (turn + 1) AS `to`")
    return validate.dangling_references(pointers, conversation_documents(c))


_OVER = ("CAST(conv_id AS STRING) AS doc_key", "'b' || turn % 2 AS block_id", "turn AS span_id", "CAST(turn * 10 AS INT) AS start", "CAST(turn * 10 + CASE WHEN turn % 3 = 0 THEN 45 ELSE 5 END AS INT) AS stop")


@query(f"""WITH s AS (SELECT {', '.join(_OVER)} FROM conversations)
SELECT doc_key, block_id, span_id FROM s WHERE EXISTS (SELECT 1 FROM s t WHERE t.doc_key = s.doc_key AND t.block_id = s.block_id AND t.start < s.start AND t.stop > s.start)""")
def overlapping_spans(spark, sf_dir):
    return validate.overlapping_spans(table(spark, sf_dir, "conversations").selectExpr(*_OVER))


@query("SELECT conv_id, turn, role FROM conversations WHERE role NOT IN ('system', 'user')")
def outside_values(spark, sf_dir):
    return validate.outside_values(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "role", ["system", "user"])


@query(f"""SELECT doc_key, block_pos, kind, id, who, text, NULL::VARCHAR AS error FROM ({_BLOCKS})
UNION ALL SELECT 'page ' || page_id, -1, NULL, NULL, NULL, NULL, '{XML}missing field `teiHeader`' FROM pages""")
def streamed_blocks(spark, sf_dir):
    """The pull parser over a batch: blocks of good documents, an error of each bad one."""
    good = conversation_markup(table(spark, sf_dir, "conversations")).select("doc_key", "xml")
    bad = table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("doc_key"), F.concat(F.lit("<TEI><text>"), escape(F.col("html")), F.lit("</text></TEI>")).alias("xml"))
    own = pull.iter_blocks(good.unionByName(bad), "doc_key", "xml")
    return own.select("doc_key", F.coalesce("block_pos", F.lit(-1).cast("bigint")).alias("block_pos"), "kind", "id", "who", body.flat_text(F.col("inline")).alias("text"), "error")


_SPOKEN = f"SELECT doc_key, block_pos, kind, id, who, text, NULL::VARCHAR AS error FROM ({_BLOCKS})"


@query(f"""{_SPOKEN} UNION ALL SELECT conv_id::VARCHAR, -1, NULL, NULL, NULL, NULL, '{XML}unknown variant `div`, expected `p` or `u`' FROM conversations GROUP BY conv_id""")
def blocks_before_fault(spark, sf_dir):
    """Each document has a fault behind its last block: its blocks come out before the error."""
    own = conversation_markup(table(spark, sf_dir, "conversations")).select("doc_key", F.replace("xml", F.lit("</body>"), F.lit("<div/></body>")).alias("xml"))
    return _flat(pull.iter_blocks(own, "doc_key", "xml"))


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("doc_key", F.coalesce("block_pos", F.lit(-1).cast("bigint")).alias("block_pos"), "kind", "id", "who", body.flat_text(F.col("inline")).alias("text"), "error")


@query(_SPOKEN)
def lateral_blocks(spark, sf_dir):
    """The pull parser behind SQL's LATERAL."""
    pull.register_tables(spark)
    conversation_markup(table(spark, sf_dir, "conversations")).createOrReplaceTempView("scriptloom_spoken")
    return _flat(spark.sql("SELECT doc_key, b.* FROM scriptloom_spoken, LATERAL parse_blocks(xml) b"))


@query(_SPOKEN)
def table_blocks(spark, sf_dir):
    """The pull parser over a table, in SQL."""
    pull.register_tables(spark)
    conversation_markup(table(spark, sf_dir, "conversations")).createOrReplaceTempView("scriptloom_spoken")
    return _flat(spark.sql("SELECT * FROM document_blocks(TABLE(SELECT doc_key, xml FROM scriptloom_spoken))"))


@query(f"""SELECT doc_id::VARCHAR AS doc_key, (pos - 1)::BIGINT AS block_pos, line AS text, NULL::VARCHAR AS error FROM (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: {trimmed('x')} <> '') AS lines FROM documents))""")
def piece_blocks(spark, sf_dir):
    """Documents of whole texts, cut in pieces of a thousand characters and read through."""
    whole = docs_.emit(text_documents(table(spark, sf_dir, "documents")))
    cut = whole.selectExpr("doc_key", "posexplode(regexp_extract_all(xml, '(?s).{1,1000}', 0)) AS (piece_pos, piece)")
    return pull.iter_pieces(cut).select("doc_key", "block_pos", body.flat_text(F.col("inline")).alias("text"), "error")


@query(f"SELECT doc_key, block_pos, kind, id, who, text FROM ({_BLOCKS})")
def source_round_trip(spark, sf_dir):
    """Documents written and read again by the data source."""
    datasource.register(spark)
    path = f"{shared_folder(spark)}/scripts-{uuid.uuid4().hex}"
    conversation_markup(table(spark, sf_dir, "conversations")).select("doc_key", "xml").write.format(datasource.NAME).mode("append").save(path)
    return docs_.blocks_long(spark.read.format(datasource.NAME).load(path)).select("doc_key", "block_pos", "kind", "id", "who", body.flat_text(F.col("inline")).alias("text"))


@query(f"""SELECT doc_key, CASE WHEN c IS NULL THEN xml END AS xml, '{XML}{FORBIDDEN_ERROR}' || {point('c')} AS error, '<title>' || {escaped(trimmed('raw'))} || '</title>' AS title
FROM (SELECT doc_id::VARCHAR AS doc_key, raw, {_TITLE_XML} AS xml, {forbidden('raw')} AS c FROM ({TITLED}) WHERE {blank_null('raw')} IS NOT NULL)""")
def sql_emission(spark, sf_dir):
    """Titles of whole texts, some with faults, through the SQL functions alone: markup of titles,
    documents, and the errors of those that can't be written."""
    from ..operators import facade

    facade.register(spark)
    own = docs_.from_titles(titled(spark, sf_dir), F.col("doc_id"), F.col("raw")).where("error is null")
    return own.selectExpr("doc_key", "emit_document(header, blocks) AS xml", "emit_error(header, blocks) AS error", "title_markup(header.fileDesc.title) AS title")


@query(f"""SELECT d.doc_key, {escaped('d.xml')} AS escaped, '<title>Conversation ' || d.doc_key || '</title>' AS title, d.xml AS xml, NULL::VARCHAR AS title_error FROM ({conversation_xml()}) d""")
def sql_functions(spark, sf_dir):
    """The registered SQL functions: parser, writer, titles, escaping."""
    from ..operators import facade

    facade.register(spark)
    own = conversation_markup(table(spark, sf_dir, "conversations")).select("doc_key", "xml")
    parsed = own.selectExpr("doc_key", "xml", "parse_document(xml) AS d")
    return parsed.selectExpr("doc_key", "escape_xml_text(xml) AS escaped", "title_markup('  ' || d.header.fileDesc.title) AS title", "emit_document(d.header, d.blocks) AS xml", "title_error(d.header.fileDesc.title) AS title_error")
