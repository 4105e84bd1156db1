"""Markup from long tokens equals that from arrays, and is written piece by piece."""

import os

from pyspark.sql import functions as F

from scriptloom.functions import body as B
from scriptloom.operators import documents as D
from scriptloom.operators import pieces as P
from scriptloom.streaming import pull

HEAD = "<TEI><teiHeader><fileDesc><title>T</title></fileDesc></teiHeader><text><body>"
TAIL = "</body></text></TEI>"
DOCS = {
    "a": HEAD + '<p xml:id="q">a &gt; b<hi rend="x">c<hi>y</hi>d<pause dur="1"/></hi>e</p><u who="w">f\n<hi>g<hi>h</hi></hi></u><p/>' + TAIL,
    "b": HEAD.replace("<body>", "<body/>") + "</text></TEI>",
    "c": HEAD + "<p><hi>x</hi></p>" + TAIL,
    "d": HEAD + "".join(f"<p>w{i}<pause/></p>" for i in range(3000)) + TAIL,
}


def long_forms(docs):
    return docs.select("doc_key", "header"), D.blocks_long(docs).drop("inline"), D.tokens_long(docs)


def test_pieces_are_the_markup_of_arrays(spark):
    docs = D.parse(spark.createDataFrame(list(DOCS.items()), "doc_key string, xml string"), "doc_key", "xml")
    # Texts that stand beside each other, an empty text and emphases around nothing, which no parser gives.
    text = lambda t: B.text(F.lit(t))
    odd = F.array(*(F.struct(F.lit("p").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit("no").alias("who"), i.alias("inline")).cast(B.BLOCK) for i in (B.joined(text("x"), text("y>"), B.hi(B.empty_tokens()), text("z")), text(""), B.empty_tokens(), B.joined(text(""), B.hi(B.hi(B.empty_tokens()))))))
    docs = docs.unionByName(docs.where("doc_key = 'c'").withColumns({"doc_key": F.lit("e"), "blocks": odd}))
    want = {r.doc_key: r.xml for r in D.emit(docs).collect()}
    pieces = P.markup_pieces(P.markup_rows(*long_forms(docs)))
    got = {}
    for r in sorted(pieces.collect()):
        assert not r.piece.endswith("/>") and r.piece.startswith(("<", "x", "z", "y")) or r.doc_key in DOCS
        got[r.doc_key] = got.get(r.doc_key, "") + r.piece + ">"
    assert got == want and {k: want[k] for k in DOCS} == DOCS
    assert max(len(r.piece) for r in pieces.where("doc_key = 'd'").collect()) < 100


def test_files_of_pieces_are_read_again(spark, tmp_path):
    docs = D.parse(spark.createDataFrame(list(DOCS.items()), "doc_key string, xml string"), "doc_key", "xml")
    path = str(tmp_path / "out")
    P.write_pieces(P.markup_pieces(P.markup_rows(*long_forms(docs))), path)
    for key, text in DOCS.items():
        (name,) = (f for f in os.listdir(f"{path}/doc_key={key}") if f.endswith(".txt"))
        with open(f"{path}/doc_key={key}/{name}") as file:
            assert file.read() == text
    back = pull.file_blocks(spark, f"{path}/*")
    assert back.where("error is not null").count() == 0 and back.count() == 3 + 0 + 1 + 3000


def test_blocks_and_tokens_without_their_owners_are_left_out(spark):
    docs = D.parse(spark.createDataFrame([("c", DOCS["c"])], "doc_key string, xml string"), "doc_key", "xml")
    headers, blocks, tokens = long_forms(docs)
    none = P.markup_rows(headers.where("false"), blocks, tokens)
    assert P.markup_pieces(none).count() == 0
    bare = P.markup_pieces(P.markup_rows(headers, blocks.where("false"), tokens.where("false"))).orderBy("piece_pos").collect()
    assert "".join(r.piece + ">" for r in bare) == DOCS["b"]
