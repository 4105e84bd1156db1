import pytest
from pyspark.sql import functions as F

from scriptloom import __py_runtime__, __version__
from scriptloom.functions import body as body_
from scriptloom.functions import header
from scriptloom.functions import parse as P
from scriptloom.functions import xml
from scriptloom.operators import documents as D
from scriptloom.operators import facade, validate
from scriptloom.sources import files
from scriptloom.sources.tables import conversation_documents, text_documents
from scriptloom.streaming import pull

MINIMAL = "<TEI><teiHeader><fileDesc><title>Tide Tables</title></fileDesc></teiHeader><text><body/></text></TEI>"
PRETTY = """<TEI>
  <teiHeader>
    <fileDesc>
      <title>  Tide Tables  </title>
    </fileDesc>
  </teiHeader>
  <text>
    <body></body>
  </text>
</TEI>"""
SPOKEN = MINIMAL.replace("<body/>", '<body><u xml:id="u1" who="host">Hello</u></body>')
# Assumed forms: the parts that no example shows in XML.
FULL = (
    "<TEI><teiHeader><fileDesc><title>T</title><series>S &amp; co</series><synopsis>Y</synopsis></fileDesc>"
    "<profileDesc><synopsis>P</synopsis><speaker>A</speaker><speaker>B</speaker><lang>en</lang></profileDesc>"
    '<encodingDesc><annotationSystem xml:id="tok"><desc>D</desc></annotationSystem><annotationSystem xml:id="x"/></encodingDesc>'
    "<revisionDesc><change>Initial<resp>qa</resp></change><change>Second</change></revisionDesc></teiHeader>"
    '<text><body><p xml:id="p1">We <hi rend="a&quot;b">are <hi>so</hi></hi><pause dur="PT1S" type="breath"/> &lt;live&gt;</p><u who="host"><pause/></u></body></text></TEI>'
)


def body(inner):
    return MINIMAL.replace("<body/>", f"<body>{inner}</body>")


def round_trip(spark, *documents):
    rows = spark.createDataFrame(list(enumerate(documents)), "k long, x string")
    parsed = D.parse(rows, "k", "x")
    return {int(r.doc_key): r for r in parsed.withColumn("again", xml.emit_xml(F.col("header"), F.col("blocks"))).collect()}


def test_round_trips(spark):
    got = round_trip(spark, MINIMAL, PRETTY, SPOKEN, FULL, FULL.replace('xml:id="p1"', 'id="p1"'), '<?xml version="1.0"?><!-- c -->' + MINIMAL.replace("<TEI>", '<TEI xmlns="http://www.tei-c.org/ns/1.0">'))
    assert [got[i].error for i in range(6)] == [None] * 6
    assert [got[i].again.value for i in range(6)] == [MINIMAL, MINIMAL, SPOKEN, FULL, FULL, MINIMAL]
    assert got[2].blocks[0].id == "u1"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("<TEI><text><body/></text></TEI>", "teiHeader"),
        ("<TEI><teiHeader><fileDesc><title>Cut off</title></fileDesc>", "start tag not closed"),
        (MINIMAL.replace("Tide Tables", "   "), "document title may not be empty"),
        (MINIMAL.replace("<title>Tide Tables</title>", ""), "missing field `title`"),
        (MINIMAL.replace("<text><body/></text>", ""), "missing field `text`"),
        (MINIMAL.replace("<body/>", ""), "missing field `body`"),
        (body("<div/>"), "unknown variant `div`"),
        (body("text"), "unknown variant `$text`"),
        (body("<p>a<b/></p>"), "did not match any variant of untagged enum Inline"),
        (body("<p><hi></hi></p>"), "did not match any variant of untagged enum Inline"),
        (body("<p><hi x='1'>a</hi></p>"), "did not match any variant"),
        (body("<p><pause x='1'/></p>"), "did not match any variant"),
        (body("<p xml:id='a b'>x</p>"), "identifiers must not contain whitespace"),
        (body("<u who=' '>x</u>"), "speaker references must not be empty"),
        (MINIMAL.replace("</fileDesc>", "</fileDesc><revisionDesc><change> </change></revisionDesc>"), "empty revision note"),
        (MINIMAL.replace("</fileDesc>", "</fileDesc><revisionDesc><change>a<resp> </resp></change></revisionDesc>"), "revision responsibility may not be empty"),
        (MINIMAL.replace("</fileDesc>", "</fileDesc><profileDesc><speaker/></profileDesc>"), "speaker may not be empty"),
        (MINIMAL.replace("</fileDesc>", "</fileDesc><encodingDesc><annotationSystem/></encodingDesc>"), "missing field `@xml:id`"),
        ("", "XML processing error"),
        (MINIMAL.replace("Tide", "&#1;"), "XML processing error"),
    ],
)
def test_rejected_xml(raw, want):
    got = P.guarded(P.read_xml, raw)
    assert got["header"] is None and got["error"].startswith("XML processing error: ") and want in got["error"]


def test_what_only_the_parser_accepts():
    assert P.read_xml(body("<p/>"))["blocks"] == [{"kind": "p", "id": None, "who": None, "inline": []}]
    assert P.read_xml(MINIMAL.replace("</title>", "</title><series> </series><other/>"))["header"]["fileDesc"]["series"] == " "
    assert [t["text"] for t in P.read_xml(body("<p> a <![CDATA[<b>]]> <pause/> </p>"))["blocks"][0]["inline"]] == [" a <b> ", None]


def test_null_documents_are_errors(spark):
    got = D.parse(spark.createDataFrame([(1, None)], "k long, x string"), "k", "x").first()
    assert got.header is None and got.error


@pytest.mark.parametrize(("payload", "want"), [("42", "did not match any variant of untagged enum Inline"), ('{"$value":[]}', "did not match any variant of untagged enum Inline"), ('"x"', None), ("{}", None), ('{"rend":"r","$value":["a",{"@dur":"1"}]}', None), ("nope", "invalid JSON")])
def test_inline_json(spark, payload, want):
    got = spark.range(1).select(P.check_inline(F.lit(payload)).alias("e")).first().e
    assert got is None if want is None else want in got


def test_forbidden_characters_fail_on_emission_alone(spark):
    rows = spark.createDataFrame([(1, "\0"), (2, "ok")], "k long, t string")
    docs = D.from_titles(rows, F.col("k"), F.col("t"))
    got = {r.doc_key: r for r in D.emit(docs).collect()}
    assert docs.where("error is not null").count() == 0
    assert got["1"].xml is None and got["1"].error == "XML processing error: document contains XML 1.0 forbidden character U+0000"
    assert got["2"].xml == MINIMAL.replace("Tide Tables", "ok")


def test_long_forms_and_back(spark):
    docs = D.parse(spark.createDataFrame([(1, FULL)], "k long, x string"), "k", "x")
    long = D.blocks_long(docs)
    assert [(r.block_pos, r.kind) for r in long.orderBy("block_pos").collect()] == [(0, "p"), (1, "u")]
    assert D.tokens_long(docs).count() == 8
    back = D.from_blocks(long.select("doc_key", "block_pos", F.struct("kind", "id", "who", "inline").alias("block")))
    assert D.compose(docs.select("doc_key", "header"), back).first().blocks == docs.first().blocks
    markup = long.select("doc_key", "block_pos", xml.block_xml(F.struct("kind", "id", "who", "inline")).alias("markup"))
    assert D.emit_long(markup, docs.select("doc_key", "header")).first().xml == FULL


def test_emission_is_native_with_one_exchange(spark):
    from scriptloom.plans.catalog import emit_documents

    plan = emit_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


def test_parsing_is_one_python_node_without_exchange(spark):
    plan = D.parse(spark.createDataFrame([(1, "x")], "k long, x string"), "k", "x")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_facade(spark):
    d = facade.Document("  Tide Tables ")
    assert d.title == "Tide Tables" and d.emit_title_markup() == "<title>Tide Tables</title>"
    assert facade.emit_xml(d) == MINIMAL and facade.parse_xml(MINIMAL) == d
    assert facade.emit_title_markup("It's late") == "<title>It&apos;s late</title>"
    with pytest.raises(ValueError, match="document title may not be empty"):
        facade.Document("   ")
    with pytest.raises(ValueError, match="document title may not be empty"):
        facade.emit_title_markup("")
    with pytest.raises(ValueError, match="teiHeader"):
        facade.parse_xml("<TEI/>")
    full = facade.parse_xml(FULL)
    assert facade.Document.from_json(full.to_json()) == full and facade.emit_xml(facade.Document.from_dict(full.to_dict())) == FULL
    assert __version__ and __py_runtime__.startswith("3.")


def test_sql_functions(spark):
    facade.register(spark)
    got = spark.sql("SELECT escape_xml_text('a<b>&\"''') AS e, title_markup('  A&B ') AS m, title_markup(' ') AS n, title_error(' ') AS t, first_forbidden_xml_char('a\u0001') AS c").first()
    assert tuple(got) == ("a&lt;b&gt;&amp;&quot;&apos;", "<title>A&amp;B</title>", None, "document title may not be empty", "\x01")
    assert spark.sql(f"SELECT parse_document('{MINIMAL}').header.fileDesc.title AS t").first().t == "Tide Tables"


def test_checks_across_parts(spark):
    raw = body('<u xml:id="a" who="host">abc</u><u xml:id="a" who="guest">d</u><p xml:id="b">x y</p>').replace("</fileDesc>", "</fileDesc><profileDesc><speaker>host</speaker></profileDesc>")
    docs = D.parse(spark.createDataFrame([(1, raw)], "k long, x string"), "k", "x")
    assert [tuple(r) for r in validate.duplicate_ids(docs).collect()] == [("1", "a", 2)]
    assert docs.select(validate.has_duplicate_ids(F.col("blocks")).alias("x")).first().x
    assert [tuple(r) for r in validate.dangling_speakers(docs).collect()] == [("1", "guest")]
    pointers = spark.createDataFrame([("1", "#a", "#zz"), ("1", "#b", None)], "doc_key string, `from` string, `to` string")
    assert [tuple(r) for r in validate.dangling_references(pointers, docs).collect()] == [("1", "to", "zz")]
    spans = spark.createDataFrame([("1", 1, "b", 0, 2), ("1", 2, "b", 1, 3), ("1", 3, "b", 2, 9), ("1", 4, "q", 0, 1)], "doc_key string, span_id long, block_id string, start int, stop int")
    assert {r.span_id: r.error for r in validate.span_errors(spans, docs).collect()} == {3: "outside the block", 4: "unknown block"}
    assert {r.span_id for r in validate.overlapping_spans(spans).collect()} == {2, 3}
    assert {r.span_id: r.text for r in validate.span_texts(spans.where("span_id < 3"), docs).collect()} == {1: "x ", 2: " y"}
    assert validate.outside_values(spans, "block_id", ["b"]).count() == 1
    assert {(r.speaker, r.text) for r in validate.utterance_list(docs).collect()} == {("host", "abc"), ("guest", "d")}
    assert validate.differences(docs, docs).count() == 0
    assert {r.span_id: r.error for r in validate.span_errors(spans.withColumn("stop", F.when(F.col("span_id") != 1, F.col("stop"))), docs).collect()}[1] == "span without start or end"


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_text(SPOKEN)
    (tmp_path / "in/b.xml").write_text("<TEI>")
    read = {r.doc_key.rpartition("/")[2]: r for r in files.read_xml(spark, str(tmp_path / "in")).collect()}
    assert read["a.xml"].blocks[0].who == "host" and "start tag not closed" in read["b.xml"].error
    query = pull.stream_files(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("blocks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    rows = spark.table("blocks").collect()
    assert len(rows) == 2 and {(r.kind, r.who) for r in rows} == {("u", "host"), (None, None)}
    docs = files.read_xml(spark, str(tmp_path / "in")).where("error is null")
    assert files.write_xml(docs, str(tmp_path / "out")) == 0
    assert files.read_xml_lines(spark, str(tmp_path / "out")).first().blocks == read["a.xml"].blocks
    files.write_documents(docs, str(tmp_path / "parquet"))
    assert spark.read.parquet(str(tmp_path / "parquet")).select("header.fileDesc.title").first().title == "Tide Tables"


def test_table_adapters(spark):
    c = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q\nr")], "conv_id long, turn long, role string, text string")
    got = conversation_documents(c).first()
    assert [(b.kind, b.id, b.who) for b in got.blocks] == [("p", "c1-t0", None), ("u", "c1-t1", "user")] and got.header.profileDesc.speaker == ["user"]
    d = spark.createDataFrame([(1, "a\n \nb", "en", "src"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    one, two = text_documents(d).orderBy("doc_key").collect()
    assert [b.inline[0].text for b in one.blocks] == ["a", "b"] and one.header.fileDesc.series == "src"
    assert two.blocks == [] and two.header.profileDesc.lang == []


def test_msgpack(spark):
    from scriptloom.functions import msgpack as M

    for value in (None, True, 0, 127, 128, -5, "", "é" * 40, "x" * 70000, [1] * 20, {"a": [{}], "b": {"c": None}}, {str(i): i for i in range(20)}):
        assert M.unpack(M.pack(value)) == value
    assert M.pack({"a": "b"}) == b"\x81\xa1a\xa1b" and M.unpack(b"\xff") == -1
    for broken in (b"", b"\xa5ab", b"\x91", b"\xc1", b"\xc0\xc0"):
        with pytest.raises(P.Rejected):
            M.unpack(broken)
    full = facade.parse_xml(FULL)
    assert facade.Document.from_msgpack(full.to_msgpack()) == full
    with pytest.raises(ValueError, match="teiHeader"):
        facade.Document.from_msgpack(M.pack({}))
    docs = D.parse(spark.createDataFrame([(1, FULL)], "k long, x string"), "k", "x")
    packed = D.to_msgpack(docs)
    assert bytes(packed.first().packed) == full.to_msgpack()
    again = D.parse(packed, "doc_key", "packed", "msgpack").first()
    assert (again.header, again.blocks, again.error) == (docs.first().header, docs.first().blocks, None)


def test_line_ends_survive(spark, tmp_path):
    text = "one\rtwo\r\nthree\nfour\tfive"
    rows = spark.createDataFrame([("a\tb", text), ("a\tb", text), (None, text), ("bad", "\x01")], "k string, t string")
    docs = rows.select(F.col("k").alias("doc_key"), header.header(header.file_desc(F.lit("T"))).alias("header"), F.array(body_.utterance_of(F.lit("w"), F.array("t"))["value"].withField("inline", body_.joined(body_.text(F.col("t")), body_.pause(F.col("t"), F.lit("x"))))).alias("blocks"))
    back = D.parse(D.emit(docs).where("error is null"), "doc_key", "xml").collect()
    assert {(r.blocks[0].inline[0].text, r.blocks[0].inline[1].dur) for r in back} == {(text, text)}
    assert files.write_xml(docs, str(tmp_path / "lines")) == 1
    again = files.read_xml_lines(spark, str(tmp_path / "lines")).collect()
    assert sorted((r.doc_key or "", r.blocks[0].inline[0].text, r.error) for r in again) == [("", text, None), ("a\tb", text, None), ("a\tb", text, None)]
    (rejected,) = spark.read.parquet(str(tmp_path / "lines" / files.REJECTED)).collect()
    assert rejected.doc_key == "bad" and "U+0001" in rejected.error


def test_a_declared_encoding_is_not_heeded():
    for name in ("ISO-8859-1", "UTF-16", "utf-8"):
        assert P.read_xml(f'<?xml version="1.0" encoding="{name}"?>' + MINIMAL.replace("Tide", "é"))["header"]["fileDesc"]["title"] == "é Tables"


BAD_JSON = ['{"teiHeader":{"fileDesc":{"title":"D"}},"text":{"body":{"$value":[{}]}}}', '{"teiHeader":{"fileDesc":{"title":"D","series":5}},"text":{"body":{"$value":[]}}}', "[" * 100_000, '"\\ud800"', '{"teiHeader":{"fileDesc":{"title":"\\ud800"}},"text":{"body":{"$value":[]}}}', "null", "7" * 5000, "{", "", None]


def test_wrong_members_are_errors_of_their_rows(spark):
    got = D.parse(spark.createDataFrame(list(enumerate([*BAD_JSON, MINIMAL])), "k long, x string"), "k", "x", "json", keep=("x",)).collect()
    assert len(got) == len(BAD_JSON) + 1 and all(r.error and r.header is None and r.blocks is None for r in got)
    assert [r.x for r in got] == [*BAD_JSON, MINIMAL]
    packed = spark.createDataFrame([(1, bytearray(b"\xa1\xff")), (2, bytearray(b"\x81\x90\xc0")), (3, None)], "k long, x binary")
    assert all(r.error for r in D.parse(packed, "k", "x", "msgpack").collect())


def test_every_mutated_document_gives_a_document_or_an_error(spark):
    import json
    import random

    from scriptloom.functions import msgpack as M

    rng = random.Random(11)
    whole = facade.parse_xml(FULL).to_dict()

    def mutated(value):
        if rng.random() < 0.06:
            return rng.choice([None, 5, -1.5, True, "", " ", "x", [], {}, [[]], {"p": 1}, "\ud800", "\0"])
        if isinstance(value, dict):
            return {(k if rng.random() > 0.02 else "?"): mutated(v) for k, v in value.items()}
        return [mutated(v) for v in value] if isinstance(value, list) else value

    trees = [mutated(whole) for _ in range(300)]
    cut = lambda x: x[: rng.randrange(len(x))] + rng.choice(["", "<", "&", "]]>", "\0", "</p>", "é"]) + x[rng.randrange(len(x)) :]
    pack = M.pack(whole)
    binary = [bytearray(pack[: (i := rng.randrange(len(pack)))] + bytes([rng.randrange(256)]) + pack[i + 1 :]) for _ in range(300)]
    for form, rows, kind in (("json", [json.dumps(t) for t in trees], "string"), ("json", [cut(json.dumps(whole)) for _ in range(100)], "string"), ("xml", [cut(FULL) for _ in range(300)], "string"), ("msgpack", binary, "binary")):
        got = D.parse(spark.createDataFrame(list(enumerate(rows)), f"k long, x {kind}"), "k", "x", form).collect()
        assert len(got) == len(rows) and all((r.error is None) == (r.header is not None and r.blocks is not None) for r in got)
        assert any(r.error is None for r in got) or form == "xml"


def test_versions(spark):
    docs = D.parse(spark.createDataFrame([(1, FULL)], "k long, x string"), "k", "x")
    got = validate.versioned(docs).first()
    assert (got.model_version, got.version_error, got.blocks) == (validate.MODEL_VERSION, None, docs.first().blocks)
    newer = validate.versioned(docs.withColumn("model_version", F.lit(7))).first()
    assert newer.model_version == 7 and "7" in newer.version_error
    oldest = docs.withColumn("blocks", F.lit(None).cast(body_.BLOCKS)).withColumn("header", F.col("header").withField("profileDesc", F.col("header.profileDesc").withField("speaker", F.lit(None).cast("array<string>"))))
    got = validate.versioned(oldest.withColumn("model_version", F.lit(0))).first()
    assert (got.model_version, got.blocks, got.header.profileDesc.speaker) == (validate.MODEL_VERSION, [], [])


def test_documents_are_written_in_sql(spark):
    facade.register(spark)
    rows = spark.createDataFrame([(1, FULL), (2, MINIMAL), (3, body("<p/><p>a&#13;<hi rend='&#10;'>b</hi></p>"))], "k long, x string")
    parsed = D.parse(rows, "k", "x", keep=("k",))
    assert all(r.a == r.b for r in parsed.select(F.expr("emit_document(header, blocks)").alias("a"), xml.emit_xml(F.col("header"), F.col("blocks"))["value"].alias("b")).collect())
    assert D.from_titles(spark.createDataFrame([(1, "\1")], "k long, t string"), F.col("k"), F.col("t")).selectExpr("emit_document(header, blocks) AS x").first().x is None


def test_msgpack_by_expressions_is_that_of_plain_values(spark):
    import json as text

    from scriptloom.functions import json as J
    from scriptloom.functions import msgpack as M

    deep = HEAD_ALL + "".join(f"<p xml:id='i{k}'>" + "<hi rend='r'>a<pause/>" * k + "é" * n + "</hi>" * k + "<hi><hi>b</hi>c</hi></p>" for k, n in ((0, 31), (1, 255), (3, 256), (2, 70_000))) + "".join(f"<u who='w{i}'>x</u>" for i in range(20)) + "</body></text></TEI>"
    bare = "<TEI><teiHeader><fileDesc><title>T</title></fileDesc><profileDesc/><encodingDesc/><revisionDesc/></teiHeader><text><body><p/></body></text></TEI>"
    docs = D.parse(spark.createDataFrame([("a", deep), ("b", bare), ("c", "<TEI>")], "k string, xml string"), "k", "xml")
    packed = D.to_msgpack(docs, ("header", "blocks"))
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the parser's
    rows = {r.doc_key: r for r in packed.select("doc_key", "packed", J.document_json(F.col("header"), F.col("blocks")).alias("json")).collect()}
    for key in "ab":
        assert bytes(rows[key].packed) == M.pack(text.loads(rows[key].json))
    assert rows["c"].packed is None
    back = D.parse(packed.where("packed is not null"), "doc_key", "packed", "msgpack", keep=())
    both = back.select("doc_key", F.col("blocks").alias("again")).join(docs, "doc_key")
    assert both.where(F.col("again").eqNullSafe(F.col("blocks"))).count() == 2


HEAD_ALL = "<TEI><teiHeader><fileDesc><title>T</title><series>s</series></fileDesc><profileDesc><speaker>a</speaker><lang>en</lang></profileDesc><encodingDesc><annotationSystem xml:id='k'><desc>d</desc></annotationSystem></encodingDesc><revisionDesc><change>n<resp>r</resp></change></revisionDesc></teiHeader><text><body>"


def test_sql_functions_of_a_caller_stay(spark):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION title_error(s STRING) RETURNS STRING RETURN 'own'")
    facade.register(spark)
    assert spark.sql("SELECT title_error('x') AS e").first().e == "own"
    facade.register(spark, replace=True)
    assert spark.sql("SELECT title_error('x') AS e").first().e is None


def test_markup_is_made_once_by_each_sql_function(spark):
    facade.register(spark, replace=True)
    docs = D.from_titles(spark.createDataFrame([(1, "a \1"), (2, " b ")], "k long, t string"), F.col("k"), F.col("t"))
    for name, want in (("emit_document", {"1": None, "2": MINIMAL.replace("Tide Tables", "b")}), ("emit_error", {"1": "XML processing error: document contains XML 1.0 forbidden character U+0001", "2": None})):
        own = docs.selectExpr("doc_key", f"{name}(header, blocks) AS x")
        assert {r.doc_key: r.x for r in own.collect()} == want
        assert own._jdf.queryExecution().optimizedPlan().toString().count("<TEI>") == 1
