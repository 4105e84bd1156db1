import pytest
from pyspark.sql import functions as F

from scriptloom.functions import header as H


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_recording_header_metadata(spark):
    head = H.assembled(
        H.file_desc(F.lit("Low Water"), synopsis=F.lit(" Salt and mud ")),
        H.profile_desc(F.lit("s"), F.array(F.lit("Pilot")), F.array(F.lit("en-GB"))),
        H.encoding_desc(F.array(H.annotation_system(F.lit("tropes"), F.lit("worn phrases"))["value"])),
        H.revision_desc(F.array(H.revision_change(F.lit("Initial ingest"), F.lit(None).cast("string"))["value"])),
    )
    h = one(spark, head)
    assert (h.fileDesc.title, h.fileDesc.series, h.fileDesc.synopsis) == ("Low Water", None, "Salt and mud")
    assert (h.profileDesc.speaker, h.profileDesc.lang) == (["Pilot"], ["en-GB"])
    assert h.encodingDesc.annotationSystem[0].asDict() == {"id": "tropes", "desc": "worn phrases"}
    assert h.revisionDesc.change[0].asDict() == {"description": "Initial ingest", "resp": None}


@pytest.mark.parametrize(
    ("own", "want"),
    [
        (H.speaker_name, "speaker may not be empty"),
        (H.language_tag, "language may not be empty"),
        (H.annotation_system_id, "annotation system may not be empty"),
        (H.responsible_party, "revision responsibility may not be empty"),
        (lambda c: H.revision_change(c, c), "revision note may not be empty"),
        (lambda c: H.annotation_system(c, c), "annotation system may not be empty"),
        (H.speaker, "speaker references must not be empty"),
        (H.optional_speaker, "speaker references must not be empty"),
        (H.xml_id, "identifiers must not be empty"),
        (lambda c: H.xml_id(c, "paragraph"), "paragraph identifiers must not be empty"),
    ],
)
def test_blank_values_are_rejected(spark, own, want):
    got = one(spark, own(F.lit("  ")))
    assert (got.value, got.error) == (None, want)
    assert one(spark, own(F.lit("  ok "))).error is None


def test_identifiers_and_speakers(spark):
    assert one(spark, H.xml_id(F.lit("  intro  "))).value == "intro"
    assert one(spark, H.xml_id(F.lit("identifier with space"))).error == "identifiers must not contain whitespace"
    assert one(spark, H.xml_id(F.lit("a b"), "utterance")).error == "utterance identifiers must not contain whitespace"
    assert one(spark, H.speaker(F.lit("  host  "))).value == "host"
    assert one(spark, H.optional_speaker(F.lit(None).cast("string"))).asDict() == {"value": None, "error": None}


def test_empty_sections_are_left_out_when_assembled_but_stay_when_given(spark):
    p, e, r = H.profile_desc(F.lit(" ")), H.encoding_desc(), H.revision_desc()
    a = one(spark, H.assembled(H.file_desc(F.lit("t")), p, e, r))
    assert (a.profileDesc, a.encodingDesc, a.revisionDesc) == (None, None, None)
    b = one(spark, H.with_section(H.header(H.file_desc(F.lit("t")), p), "encodingDesc", e.cast(H.ENCODING)))
    assert b.profileDesc is not None and b.encodingDesc is not None and b.revisionDesc is None


def test_lists_keep_order_and_repeats(spark):
    p = H.profile_desc()
    for s in ("b", " a ", "b"):
        p = H.add_speaker(p, F.lit(s))["value"]
    rejected = H.add_language(p, F.lit(" "))
    got = one(spark, F.struct(p.alias("p"), rejected.alias("r"), H.count_speakers(p).alias("n"), H.profile_is_empty(p).alias("e")))
    assert got.p.speaker == ["b", "a", "b"] and got.n == 3 and got.e is False
    assert got.r.error == "language may not be empty" and got.r.value == got.p


def test_finding_annotation_systems(spark):
    e = H.encoding_desc()
    for i, d in (("timestamps", "first"), ("tok", " "), ("timestamps", "second")):
        e = H.add_annotation_system(e, H.annotation_system(F.lit(i), F.lit(d)))["value"]
    got = one(spark, F.struct(*(H.find_annotation_system(e, F.lit(k)).alias(n) for n, k in (("a", "timestamps"), ("b", "other"), ("c", "tok"), ("d", " tok"), ("e", "TOK")))))
    assert got.a.desc == "first" and got.b is None and got.c.desc is None and got.d is None and got.e is None


def test_revisions(spark):
    r = H.add_change(H.revision_desc(), H.revision_change(F.lit(" a "), F.lit(" ")))["value"]
    r = H.add_change(r, H.revision_change(F.lit("b"), F.lit(" qa ")))["value"]
    got = one(spark, r)
    assert [tuple(c) for c in got.change] == [("a", None), ("b", "qa")]
    assert one(spark, H.revision_is_empty(H.revision_desc())) and not one(spark, H.revision_is_empty(r))


def test_rejected_notes_and_systems_append_nothing(spark):
    old = H.add_change(H.revision_desc(), H.revision_change(F.lit("a"), F.lit("x")))["value"]
    note = one(spark, H.add_change(old, H.revision_change(F.lit(" "), F.lit("qa"))))
    assert note.error == "revision note may not be empty" and [tuple(c) for c in note.value.change] == [("a", "x")]
    e = H.add_annotation_system(H.encoding_desc(), H.annotation_system(F.lit("k"), F.lit("d")))["value"]
    system = one(spark, H.add_annotation_system(e, H.annotation_system(F.lit("\u00a0"), F.lit("d"))))
    assert system.error == "annotation system may not be empty" and [tuple(x) for x in system.value.annotationSystem] == [("k", "d")]


def test_texts_can_be_set_and_cleared(spark):
    f = H.with_text(H.file_desc(F.lit("t"), F.lit("s")), "synopsis", F.lit(" y "))
    assert tuple(one(spark, f)) == ("t", "s", "y")
    assert one(spark, H.with_text(f, "series", F.lit("  "))).series is None
