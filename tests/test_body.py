import pytest
from pyspark.sql import functions as F

from scriptloom.functions import body as B
from scriptloom.functions import xml


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def texts(*values):
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def markup(spark, own):
    got = one(spark, F.struct(own["error"].alias("e"), xml.block_xml(own["value"]).alias("x")))
    assert got.e is None
    return got.x


def test_paragraph_then_utterance_keep_their_order(spark):
    blocks = B.push_block(B.push_block(B.empty_body(), B.paragraph_of(texts("Welcome to the show"))["value"]), B.utterance_of(F.lit("host"), texts("Hello listeners"))["value"])
    got = one(spark, blocks)
    assert [(b.kind, b.who, b.inline[0].text) for b in got] == [("p", None, "Welcome to the show"), ("u", "host", "Hello listeners")]
    counts = one(spark, F.struct(B.count_blocks(blocks).alias("n"), B.count_blocks(B.paragraphs(blocks)).alias("p"), B.count_blocks(B.utterances(blocks)).alias("u"), B.body_is_empty(blocks).alias("e")))
    assert tuple(counts) == (2, 1, 1, False)
    assert len(one(spark, B.extend(blocks, blocks))) == 4


def test_emphasis(spark):
    assert markup(spark, B.paragraph(B.hi(B.text(F.lit("Critical"))))) == "<p><hi>Critical</hi></p>"


def test_pause(spark):
    own = B.utterance(F.lit("host"), B.joined(B.text(F.lit("Wait")), B.pause(), B.text(F.lit(" go"))))
    assert markup(spark, own) == '<u who="host">Wait<pause/> go</u>'


def test_pause_attributes(spark):
    own = B.utterance(F.lit("host"), B.joined(B.text(F.lit("We are")), B.pause(F.lit("PT1S"), F.lit("breath")), B.text(F.lit(" live"))))
    assert markup(spark, own) == '<u who="host">We are<pause dur="PT1S" type="breath"/> live</u>'


def test_mixed_content(spark):
    own = B.paragraph(B.joined(B.text(F.lit("Welcome")), B.hi(B.text(F.lit("back")), F.lit("stress")), B.text(F.lit("!"))))
    assert len(one(spark, own).value.inline) == 4
    assert markup(spark, own) == '<p>Welcome<hi rend="stress">back</hi>!</p>'


def test_nested_emphasis(spark):
    inner = B.joined(B.text(F.lit("are ")), B.hi(B.text(F.lit("so"))))
    own = B.paragraph(B.joined(B.text(F.lit("We ")), B.hi(inner), B.pause(), B.hi(B.text(F.lit("live")))))
    assert markup(spark, own) == "<p>We <hi>are <hi>so</hi></hi><pause/><hi>live</hi></p>"


def test_a_pause_alone_is_content(spark):
    assert markup(spark, B.utterance(None, B.pause())) == "<u><pause/></u>"


NONE = F.array
CASES = [
    (lambda: B.utterance_of(F.lit("guest"), texts("   ")), "utterance segments may not be empty"),
    (lambda: B.paragraph_of(texts("   ")), "paragraph segments may not be empty"),
    (lambda: B.paragraph(B.hi(B.text(F.lit("   ")))), "paragraph segments may not be empty"),
    (lambda: B.paragraph_of(texts()), "paragraph content must include at least one non-empty segment"),
    (lambda: B.utterance_of(None, texts()), "utterance content must include at least one non-empty segment"),
    (lambda: B.checked_hi(B.empty_tokens()), "hi content must include at least one non-empty segment"),
    (lambda: B.push_into_hi(B.hi(B.text(F.lit("x"))), B.text(F.lit("   "))), "hi segments may not be empty"),
    (lambda: B.paragraph(B.joined(B.text(F.lit("x")), B.hi(B.empty_tokens()))), "paragraph content must include at least one non-empty segment"),
    (lambda: B.paragraph(B.joined(B.hi(B.empty_tokens()), B.text(F.lit(" ")))), "paragraph content must include at least one non-empty segment"),
    (lambda: B.paragraph(B.joined(B.text(F.lit(" ")), B.hi(B.empty_tokens()))), "paragraph segments may not be empty"),
    (lambda: B.utterance_of(F.lit("   "), texts("Hello")), "speaker references must not be empty"),
    (lambda: B.utterance_of(F.lit("   "), texts()), "speaker references must not be empty"),
    (lambda: B.set_id(B.paragraph_of(texts("x"))["value"], F.lit("identifier with space")), "paragraph identifiers must not contain whitespace"),
    (lambda: B.set_id(B.utterance_of(None, texts("x"))["value"], F.lit("identifier with space")), "utterance identifiers must not contain whitespace"),
    (lambda: B.set_id(B.utterance_of(None, texts("x"))["value"], F.lit(" ")), "utterance identifiers must not be empty"),
    (lambda: B.set_speaker(B.utterance_of(None, texts("x"))["value"], F.lit(" ")), "speaker references must not be empty"),
    (lambda: B.push_segment(B.paragraph_of(texts("x"))["value"], F.lit(" ")), "paragraph segments may not be empty"),
]


@pytest.mark.parametrize(("own", "want"), CASES, ids=range(len(CASES)))
def test_rejected(spark, own, want):
    assert one(spark, own()).error == want


def test_a_rejected_change_leaves_the_block(spark):
    block = B.set_id(B.paragraph_of(texts("x"))["value"], F.lit(" intro "))["value"]
    got = one(spark, F.struct(B.set_id(block, F.lit("a b")).alias("i"), B.push_segment(block, F.lit(" ")).alias("s"), B.push_segment(block, F.lit("y")).alias("ok"), B.clear_id(block).alias("c")))
    assert got.i.value.id == "intro" and len(got.s.value.inline) == 1 and got.c.id is None
    assert [t.text for t in got.ok.value.inline] == ["x", "y"] and got.ok.error is None


def test_speakers_can_be_set_and_cleared(spark):
    u = B.utterance_of(None, texts("x"))["value"]
    got = one(spark, F.struct(B.set_speaker(u, F.lit(" host "))["value"].alias("a"), B.clear_speaker(B.set_speaker(u, F.lit("h"))["value"]).alias("b")))
    assert got.a.who == "host" and got.b.who is None


def test_text_is_kept_untrimmed_and_flattened(spark):
    own = B.paragraph(B.joined(B.text(F.lit(" a ")), B.hi(B.text(F.lit("b"))), B.pause(), B.text(F.lit("c "))))
    assert one(spark, B.flat_text(own["value"]["inline"])) == " a bc "
    assert [one(spark, B.as_text(B.text(F.lit("t"))[0])), one(spark, B.as_text(B.pause()[0]))] == ["t", None]


def test_attributes_are_free_texts(spark):
    t = B.with_attribute(B.with_attribute(B.pause()[0], "dur", F.lit(" any ")), "type", F.lit("x"))
    got = one(spark, F.struct(t.alias("t"), B.with_attribute(t, "dur", None).alias("u")))
    assert (got.t.dur, got.t.type, got.u.dur) == (" any ", "x", None)


def test_deprecated_names(spark):
    with pytest.warns(DeprecationWarning):
        assert one(spark, B.new_paragraph(texts("x"))).error is None
    with pytest.warns(DeprecationWarning):
        assert one(spark, B.new_utterance(None, texts("x"))).error is None
