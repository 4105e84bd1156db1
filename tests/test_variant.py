"""JSON documents decoded by expressions, and those that are left to the parser."""

from pyspark.sql import functions as F

from scriptloom.functions import json as J
from scriptloom.functions import variant as V
from scriptloom.operators import documents as D

ALL = "<TEI><teiHeader><fileDesc><title>T \"x\"</title><series>s</series><synopsis> y </synopsis></fileDesc><profileDesc><synopsis>p</synopsis><speaker>a</speaker><speaker>b</speaker><lang>en</lang></profileDesc><encodingDesc><annotationSystem xml:id='k'><desc>d</desc></annotationSystem><annotationSystem xml:id='l'/></encodingDesc><revisionDesc><change>n<resp>r</resp></change><change>m</change></revisionDesc></teiHeader><text><body>"
BODY = "<p xml:id='i'>a&lt;<hi rend='r'>b<hi><pause dur='1'/>c</hi></hi><pause/></p><u who='w'>é 漢 😀\n\t</u><p/></body></text></TEI>"
BARE = "<TEI><teiHeader><fileDesc><title>T</title></fileDesc><profileDesc/><encodingDesc/><revisionDesc/></teiHeader><text><body/></text></TEI>"
DEEP = BARE.replace("<body/>", "<body><p>" + "<hi>" * 9 + "x" + "</hi>" * 9 + "</p></body>")
HEAD = '{"teiHeader":{"fileDesc":{"title":"T"}},"text":{"body":{"$value":[%s]}}}'
#: Read by the parser alone: good but written otherwise, or bad.
OTHERS = [
    HEAD % '{"p":{"$value":["a"]}} ',
    HEAD % '{"p":{"$value":["a"],"@xml:id":"i"}}',
    HEAD.replace('"T"', '" T "') % "",
    HEAD.replace('"T"', "5") % "",
    HEAD.replace('"T"', '" "') % "",
    HEAD % "{}",
    HEAD % '{"p":{"$value":[5]}}',
    HEAD % '{"p":{"$value":[{"$value":[" "]}]}}',
    HEAD % '{"p":{"$value":[{"$value":[]}]}}',
    HEAD % '{"p":{"@xml:id":"a b","$value":[]}}',
    HEAD % '{"u":{"@who":" ","$value":[]}}',
    HEAD % '{"p":{"@who":"w","$value":["a"]}}',
    HEAD % '{"p":{"$value":["a"]},"u":{"$value":["b"]}}',
    HEAD % '{"q":{"$value":["a"]}}',
    HEAD % "null",
    "[]",
    "{",
    "",
    None,
]


def test_what_the_library_writes_is_decoded_without_python(spark):
    docs = D.parse(spark.createDataFrame([("a", ALL + BODY), ("b", BARE), ("c", ALL + "</body></text></TEI>")], "k string, xml string"), "k", "xml")
    rows = docs.select("doc_key", "header", "blocks", J.document_json(F.col("header"), F.col("blocks")).alias("json"))
    own = rows.withColumn("d", F.explode(F.array(V.parsed(F.col("json"))))).withColumn("own", V.is_own(F.col("d.header"), F.col("d.blocks"), F.col("json")))
    assert own.where("own").where(F.col("d").eqNullSafe(F.struct("header", "blocks"))).count() == 3


def test_all_documents_are_those_of_the_parser(spark):
    docs = D.parse(spark.createDataFrame([("a", ALL + BODY), ("b", BARE), ("d", DEEP)], "k string, xml string"), "k", "xml")
    rows = docs.select(F.col("doc_key").alias("k"), J.document_json(F.col("header"), F.col("blocks")).alias("j")).unionByName(spark.createDataFrame([(str(i), x) for i, x in enumerate(OTHERS)], "k string, j string"))
    key = lambda df: sorted(map(str, df.collect()))
    found = D.parse_json(rows.withColumn("more", F.lit(7)), "k", "j", keep=("more",))
    assert key(found) == key(D.parse(rows.withColumn("more", F.lit(7)), "k", "j", "json", keep=("more",)))
    marked = rows.withColumn("d", F.explode(F.array(V.parsed(F.col("j"))))).withColumn("own", V.is_own(F.col("d.header"), F.col("d.blocks"), F.col("j")))
    assert {r.k for r in marked.where("own").collect()} == {"a", "b"}
