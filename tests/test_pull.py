"""Blocks that leave as they close, from texts, pieces and files, and in SQL."""

import tracemalloc

import pytest
from pyspark.sql import functions as F

from scriptloom.functions import parse as P
from scriptloom.functions import xml as X
from scriptloom.functions.pull import PullParser, pieces_of
from scriptloom.streaming import pull

HEAD = "<TEI><teiHeader><fileDesc><title>T</title></fileDesc></teiHeader><text><body>"
TAIL = "</body></text></TEI>"
GOOD = [
    HEAD + TAIL,
    HEAD.replace("<body>", "<body/>") + "</text></TEI>",
    HEAD + "<p>a<hi rend='r'>b<hi>c</hi></hi> &amp; d</p> \n<u who=' x ' xml:id='q'>e<pause dur='1'/><!-- note -->f<![CDATA[<g>]]></u><p/>" + TAIL,
    f"<TEI><text><body><p>{'é' * 5000}</p></body></text><teiHeader><fileDesc><title>T</title></fileDesc></teiHeader></TEI>\n",
    HEAD + "<p>" + "<hi>" * 3000 + "x" + "</hi>" * 3000 + "</p>" + TAIL,
]
BAD = {
    "": (0, "start tag not closed"),
    HEAD + "<p>a</p>": (1, "start tag not closed"),
    HEAD + "<p>a</p><p>b": (1, "start tag not closed"),
    HEAD + "<p>a</p><div/>" + TAIL: (1, "unknown variant `div`, expected `p` or `u`"),
    HEAD + "<p>a</p>loose" + TAIL: (1, "unknown variant `$text`, expected `p` or `u`"),
    HEAD + "<p>a</p><p>b<seg/></p>" + TAIL: (1, P.errors.INLINE),
    HEAD + "<p>b<pause>x</pause></p>" + TAIL: (0, P.errors.INLINE),
    HEAD + "<p>b<pause><hi/></pause></p>" + TAIL: (0, P.errors.INLINE),
    HEAD + "<p>b<hi> </hi></p>" + TAIL: (0, P.errors.INLINE),
    HEAD + "<u who=' '>b</u>" + TAIL: (0, P.errors.SPEAKER),
    HEAD + "<u xml:id='a b'>b</u>" + TAIL: (0, P.errors.ID_SPACE),
    HEAD + "<p>a</p></body><body/></text></TEI>": (1, "duplicate field `body`"),
    HEAD.replace(">T<", "> <") + "<p>a</p>" + TAIL: (0, P.errors.TITLE),
    "<TEI><text><body><p>a</p></body></text></TEI>": (1, "missing field `teiHeader`"),
    HEAD.removesuffix("<body>") + "</text></TEI>": (0, "missing field `body`"),
    "<html/>": (0, "missing field `teiHeader`"),
    HEAD + "<p>a</p>" + TAIL + "<x/>": (1, "junk after document element at line 1"),
}


def pulled(text, size):
    parser, data = PullParser(), text.encode()
    for at in range(0, len(data), size):
        parser.feed(data[at : at + size])
    parser.close()
    return parser.blocks, parser.error


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_blocks_of_good_documents_are_those_of_a_whole_parse(size):
    for text in GOOD:
        blocks, error = pulled(text, size)
        assert error is None and blocks == P.read_xml(text)["blocks"]


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_blocks_before_a_fault_leave_and_its_error_ends_the_document(size):
    for text, (blocks, error) in BAD.items():
        found, why = pulled(text, size)
        assert (len(found), why) == (blocks, P.errors.XML + error), text
        assert P.guarded(P.read_xml, text)["error"] is not None


def test_memory_is_that_of_a_block():
    parser, seen = PullParser(), 0
    block = ("<u who='x'>" + "said " * 200 + "<hi>again</hi></u>").encode()
    parser.feed(HEAD.encode())
    tracemalloc.start()
    for _ in range(30_000):  # 31 MB
        parser.feed(block)
        seen += len(parser.blocks)
        parser.blocks.clear()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    parser.feed(TAIL.encode(), True)
    assert parser.error is None and seen == 30_000 and peak < 1_000_000


def test_pieces_of_a_text_are_its_bytes(monkeypatch):
    monkeypatch.setattr("scriptloom.functions.pull.PIECE", 3)
    assert b"".join(pieces_of("aé漢😀" * 5)) == ("aé漢😀" * 5).encode() and list(pieces_of(None)) == []


def rows(df):
    return sorted((str(r.doc_key), -1 if r.block_pos is None else r.block_pos, r.kind, r.who, str(r.inline), r.error) for r in df.collect())


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate([*GOOD, *BAD, None])], "k string, xml string")


def test_rows_from_texts_pieces_and_sql(spark, docs):
    want = rows(pull.iter_blocks(docs, "k", "xml"))
    assert len({r[0] for r in want}) == len(GOOD) - 2 + len(BAD) + 1
    # In pieces of unlike size, and out of order.
    cut = "posexplode(coalesce(nullif(regexp_extract_all(xml, '(?s).{1,9000}', 0), array()), array(''))) AS (piece_pos, piece)"
    pieces = docs.selectExpr("k AS doc_key", cut).repartition(5, "piece_pos")
    assert rows(pull.iter_pieces(pieces)) == want
    pull.register_tables(spark)
    docs.createOrReplaceTempView("texts")
    assert rows(spark.sql("SELECT k AS doc_key, b.* FROM texts, LATERAL parse_blocks(xml) b")) == want
    assert rows(spark.sql("SELECT * FROM document_blocks(TABLE(SELECT k, xml FROM texts))")) == want


@pytest.mark.parametrize("split", ["64m", "2k"])
def test_files_are_cut_in_the_reader(spark, tmp_path, split):
    ends = {"a": "", "b": "\n", "c": " >"}
    many = HEAD + "".join(f"<p>w{i} é</p>\n" for i in range(3000)) + TAIL
    for name, end in ends.items():
        (tmp_path / f"{name}.xml").write_text(many + end)
    (tmp_path / "d.xml").write_text(many[:-1])
    (tmp_path / "e.xml").write_bytes(HEAD.encode() + b"<p>a</p><p>\xff</p>" + TAIL.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = pull.file_blocks(spark, str(tmp_path)).groupBy("doc_key").agg(F.count("block_pos").alias("n"), F.max("error").alias("error"), F.max(F.when(F.col("block_pos") == 2999, F.col("inline")[0]["text"])).alias("last")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {r.doc_key.rpartition("/")[2][0]: (r.n, r.error and r.error.removeprefix(P.errors.XML), r.last) for r in found}
    assert got.pop("c")[:2] == (3000, "junk after document element at line 3001")
    assert got == {"a": (3000, None, "w2999 é"), "b": (3000, None, "w2999 é"), "d": (3000, "start tag not closed", "w2999 é"), "e": (1, "not well-formed (invalid token) at line 1", None)}


def test_depth_has_no_limit(spark):
    deep = HEAD + "<p>" + "<hi>" * 100_000 + "x" + "</hi>" * 100_000 + "</p>" + TAIL
    back = spark.createDataFrame([(deep,)], "xml string").select("xml", P.parse_xml(F.col("xml")).alias("d"))
    assert back.select((X.blocks_document(F.col("d.header"), F.col("d.blocks")) == F.col("xml")).alias("same")).first().same
    assert P.inline_error("[" * 100_000) == "invalid JSON: nested too deeply"
    assert P.guarded(P.read_json, '{"a":' * 100_000)["error"] == "invalid JSON: nested too deeply"
