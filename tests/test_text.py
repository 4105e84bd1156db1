import re

import pytest
from pyspark.sql import functions as F

from scriptloom.functions import errors, header, text, xml

from .helpers import expect_markup


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [("one", "one"), ("\u2003two words\u00a0", "two words"), ("\n", None), ("\u3000 \t", None), (None, None), ("\u2028x", "x"), ("\x1cx", "\x1cx"), ("\u0085x", "x"), ("\0", "\0"), ("a\u00a0b ", "a\u00a0b")],
)
def test_titles(spark, raw, want):
    got = one(spark, header.document_title(F.lit(raw).cast("string")))
    assert (got.value, got.error) == (want, None if want is not None else errors.TITLE)


@pytest.mark.parametrize(
    ("raw", "want"),
    [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("&&x", "&amp;&amp;x"), ("\U0001f600<\U0001f600", "\U0001f600&lt;\U0001f600"), ("&lt;", "&amp;lt;"), ("", ""), ("a\r\n", "a\r\n")],
)
def test_escaping(spark, raw, want):
    assert one(spark, text.escape(F.lit(raw))) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (" tea\n", "<title>tea</title>"),
        ("<<1 & 2>>", "<title>&lt;&lt;1 &amp; 2&gt;&gt;</title>"),
        ("\"it's\" é\U0001f600", "<title>&quot;it&apos;s&quot; é\U0001f600</title>"),
    ],
)
def test_title_markup(spark, raw, want):
    assert expect_markup(one(spark, xml.title_markup(F.lit(raw)))) == want


def test_title_markup_of_a_blank_title(spark):
    assert one(spark, xml.title_markup(F.lit("   "))).error == "document title may not be empty"


def allowed(i):
    """XML 1.0's range without the non-characters, as arithmetic."""
    if i < 0x20:
        return i in (9, 10, 13)
    return not (0xD800 <= i <= 0xDFFF or 0xFDD0 <= i <= 0xFDEF or i & 0xFFFE == 0xFFFE)


def test_every_code_point_is_judged_right(spark):
    points = [i for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    chars = "".join(c for c in map(chr, points))
    found = one(spark, F.regexp_extract_all(F.lit(chars), F.lit(text.FORBIDDEN), F.lit(0)))
    assert found == [chr(i) for i in points if not allowed(i)]


def test_white_space_is_that_of_unicode(spark):
    found = one(spark, F.regexp_extract_all(F.lit("".join(chr(i) for i in range(0xD800))), F.lit(f"[{text.SPACES}]"), F.lit(0)))
    assert found == [chr(i) for i in range(0xD800) if re.match(r"\s", chr(i)) and not 0x1C <= i <= 0x1F]


@pytest.mark.parametrize(("char", "want"), [("\0", "U+0000"), ("\x01", "U+0001"), ("￾", "U+FFFE"), ("﷐", "U+FDD0"), ("\U0001fffe", "U+1FFFE"), ("\x7f", None), ("\x9f", None)])
def test_forbidden_characters(spark, char, want):
    got = one(spark, text.forbidden_error(F.lit(f"a{char}b")))
    assert got == (want and errors.FORBIDDEN + want)


def test_optional_and_blank(spark):
    r = spark.createDataFrame([(None,), ("",), ("  ",), (" a b ",)], "s string").select(text.optional(F.col("s")).alias("o"), text.is_blank(F.col("s")).alias("b"), text.has_space(F.col("s")).alias("h")).collect()
    assert [x.o for x in r] == [None, None, None, "a b"]
    assert [x.b for x in r] == [True, True, True, False]
    assert [x.h for x in r] == [None, False, True, True]


def test_every_code_point_is_trimmed_and_judged_as_by_the_slow_patterns(spark):
    points = [i for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    found = one(spark, F.regexp_extract_all(F.lit("".join(map(chr, points))), F.lit(text.FORBIDDEN_FAST), F.lit(0)))
    assert found == [chr(i) for i in points if not allowed(i)]
    rows = spark.createDataFrame([(f"{chr(i)}\n a{chr(i)}b{chr(i)}",) for i in points if i < 0x10000] + [("",), (" \u2003\n",), ("x\r\n",), ("x\u2028\u2029 ",)], "s string")
    assert rows.where(text.trim(F.col("s")) != F.regexp_replace("s", text.EDGES, "")).count() == 0


def test_long_texts_are_trimmed_at_their_edges_alone(spark):
    plan = spark.createDataFrame([("a",)], "s string").select(text.optional(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan
