"""Spans: stand-off in XML, resolved over blocks, woven into content and out of it; aligned differences."""

import random

from pyspark.sql import functions as F

from scriptloom.functions import body as B
from scriptloom.functions import xml as X
from scriptloom.functions.align import changes, matched
from scriptloom.functions.parse import read_xml
from scriptloom.functions.spans import unwoven, woven
from scriptloom.operators import documents as D
from scriptloom.operators import standoff as S
from scriptloom.operators import validate as V

HEAD = "<TEI><teiHeader><fileDesc><title>T</title></fileDesc></teiHeader><text><body>"
TAIL = "</body></text></TEI>"


def tokens(markup):
    return read_xml(f"{HEAD}<p>{markup}</p>{TAIL}")["blocks"][0]["inline"]


def flat(inline):
    return "".join(t["text"] for t in inline if t["kind"] == "text")


def marks_of(inline):
    """The emphases around each character of the text, and around each pause."""
    out, around = [], []
    for t in inline:
        del around[t["depth"] :]
        assert len(around) == t["depth"]
        if t["kind"] == "hi":
            around.append(t["rend"])
        else:
            out += [(c, tuple(sorted(map(str, around)))) for c in (t["text"] if t["kind"] == "text" else ["|"])]
    return out


def shape(inline):
    return [(t["depth"], t["kind"], t["text"] or t["rend"]) for t in inline]


def test_a_crossing_span_falls_into_two():
    got = woven(tokens("abcdef"), [(0, 4, "x"), (2, 6, "y")])
    assert shape(got) == [(0, "hi", "x"), (1, "text", "ab"), (1, "hi", "y"), (2, "text", "cd"), (0, "hi", "y"), (1, "text", "ef")]
    plain, spans = unwoven(got)
    assert plain == tokens("abcdef") and spans == [(0, 4, "x"), (2, 6, "y")]


def test_spans_and_emphases_that_are_there():
    own = tokens("ab<hi rend='r'>cd<pause dur='1'/>ef</hi>gh")
    assert shape(woven(own, [(0, 8, "all"), (4, 6, "ef")])) == [(0, "hi", "all"), (1, "text", "ab"), (1, "hi", "r"), (2, "text", "cd"), (2, "pause", None), (2, "hi", "ef"), (3, "text", "ef"), (1, "text", "gh")]
    assert woven(own, [(5, 5, "x"), (9, 12, "x"), (-3, 0, "x")]) == own == woven(own, [])
    assert woven([], [(0, 3, "x")]) == [] and unwoven([]) == ([], [])
    assert shape(woven(own, [(6, 99, "x")]))[-2:] == [(0, "hi", "x"), (1, "text", "gh")]


def test_weaving_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        content = "".join(rng.choice(["ab", "c", "<pause/>", "<hi rend='o'>de<hi>f</hi></hi>", "g"]) for _ in range(rng.randint(1, 5)))
        own = tokens(content)
        text = flat(own)
        spans = [tuple(sorted((rng.randint(0, len(text)), rng.randint(0, len(text))))) + (f"s{k}",) for k in range(rng.randint(0, 5))]
        got = woven(own, spans)
        assert flat(got) == text
        want, at = [], 0
        for c, around in marks_of(own):
            inside = [r for a, b, r in spans if (a < at < b if c == "|" else a <= at < b)]
            want.append((c, tuple(sorted([*around, *inside]))))
            at += c != "|"
        assert marks_of(got) == want
        plain, back = unwoven(got)
        assert flat(plain) == text and not any(t["kind"] == "hi" for t in plain)
        assert {s for s in back if s[2] and s[2][0] == "s"} == {s for s in spans if s[0] < s[1]}


def documents(spark):
    own = [("d", HEAD + "<p xml:id='a'>0123</p><p>45</p><u xml:id='b'>6<hi>7</hi>89</u>" + TAIL), ("e", HEAD + "<p xml:id='a'>xyz</p>" + TAIL), ("f", HEAD + TAIL)]
    xml = spark.createDataFrame(own, "doc_key string, xml string")
    return xml, D.parse(xml, "doc_key", "xml")


def spans(spark, rows):
    return spark.createDataFrame([(d, "t", "#r", s, a, b, "x<y") for d, s, a, b in rows], S.SPANS)


def test_anchors_are_resolved_over_blocks(spark):
    _, docs = documents(spark)
    rows = [("d", "1", "#a:2", "#b:2"), ("d", "2", "a", "#a"), ("d", "3", "#a:3", "#a:3"), ("d", "4", "#a:5", "#b"), ("d", "5", "#z", "#b"), ("d", "6", None, "#b"), ("e", "7", "#a:1", "#a:2"), ("f", "8", "#a", "#a"), ("d", "9", "#b", "#a:1")]
    got = S.resolved(spans(spark, rows), docs)
    found = {r.span_id: (r.start, r.stop, r.error) for r in got.collect()}
    assert {k: v[2] for k, v in found.items()} == {"1": None, "2": None, "3": "empty span", "4": "outside the block", "5": "unknown block", "6": "span without start or end", "7": None, "8": "unknown block", "9": "empty span"}
    assert found["1"][:2] == (2, 8) and found["2"][:2] == (0, 4) and found["7"][:2] == (1, 2)
    assert {r.span_id: r.text for r in S.texts(got, docs).collect()} == {"1": "234567", "2": "0123", "7": "y"}
    blocks = S.weave(got, docs)
    shown = {(r.doc_key, r.block_pos): r.x for r in blocks.select("doc_key", "block_pos", X.inline_xml(F.col("inline")).alias("x")).collect()}
    assert shown[("d", 0)] == '<hi rend="#2">01<hi rend="#1">23</hi></hi>' and shown[("d", 1)] == '<hi rend="#1">45</hi>' and shown[("d", 2)] == '<hi rend="#1">6<hi>7</hi></hi>89'
    checked = blocks.select(B.content_error(F.col("inline"), B.PARAGRAPH).alias("e")).where("e is not null").count()
    assert checked == 0 and S.unweave(blocks).columns == ["doc_key", "block_pos", "kind", "id", "who", "inline", "marks"]


def test_spans_behind_the_text(spark):
    xml, docs = documents(spark)
    rows = spans(spark, [("d", "s2", "#a", "#b:1"), ("d", "s1", "#a:1", "#b"), ("e", 's"3', "#a", None)])
    whole = S.with_standoff(D.emit(docs).select("doc_key", "xml"), rows)
    got = {r.doc_key: r.xml for r in whole.collect()}
    assert got["d"].endswith('</text><standOff><spanGrp type="t" resp="#r"><span xml:id="s1" from="#a:1" to="#b" ana="x&lt;y"/><span xml:id="s2" from="#a" to="#b:1" ana="x&lt;y"/></spanGrp></standOff></TEI>')
    assert "standOff" not in got["f"]
    back = S.parse_standoff(whole, "doc_key", "xml")
    assert back.where("error is null").drop("error").exceptAll(rows).count() == 0 == rows.exceptAll(back.drop("error")).count()
    assert D.parse(whole, "doc_key", "xml").where("error is null").count() == 3
    bad = S.parse_standoff(spark.createDataFrame([("x", "<TEI><standOff><spanGrp><span/>"), ("y", None)], "k string, xml string"), "k", "xml").collect()
    assert [(r.doc_key, r.error is None) for r in bad] == [("x", True), ("x", False), ("y", False)]


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignments_are_longest():
    rng = random.Random(2)
    for _ in range(500):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = matched(a, b)
        assert len(got) == lcs(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
        names = [[None] * len(x) for x in (a, b)]
        left = changes(a, b, *names)
        assert len(a) - len(b) == sum((c == "removed") - (c == "added") for c, *_ in left)


def test_names_tell_moved_and_changed_blocks():
    assert changes([1, 2, 3], [9, 1, 2, 3], ["a", "b", "c"], ["n", "a", "b", "c"]) == [("added", None, 0)]
    assert changes([1, 2, 3, 4], [2, 3, 4, 1], list("abcd"), list("bcda")) == [("moved", 0, 3)]
    assert changes([1, 2, 3], [1, 7, 3], list("abc"), list("abc")) == [("changed", 1, 1)]
    assert changes([1, 2], [], [None] * 2, []) == [("removed", 0, None), ("removed", 1, None)]


def test_differences_of_documents_on_one_side(spark):
    _, docs = documents(spark)
    assert V.aligned_differences(docs, docs).count() == 0
    got = V.aligned_differences(docs, docs.where("doc_key <> 'd'")).collect()
    assert [(r.doc_key, r.change, r.left_pos, r.id) for r in got] == [("d", "removed", 0, "a"), ("d", "removed", 1, None), ("d", "removed", 2, "b")]
    tree = V.digests(docs)
    assert V.changed_sections(tree, tree).count() == 0
    assert {(r.doc_key, r.block_pos) for r in V.changed_sections(tree, tree.where("doc_key <> 'e'")).collect()} == {("e", 0)}


def test_an_appended_block_changes_one_path(spark):
    def tree(n):
        xml = HEAD + "".join(f"<p>b{i}</p>" for i in range(n)) + TAIL
        return V.digests(D.parse(spark.createDataFrame([("k", xml)], "k string, xml string"), "k", "xml")).first()

    a, b = tree(200), tree(201)
    assert len(a.sections) == 4 and a.sections[:3] == b.sections[:3] and a.sections[3] != b.sections[3] and a.blocks == b.blocks[:-1] and a.header == b.header and a.document != b.document
