import gzip
import io

import pytest
from pyspark.sql import functions as F

from scriptloom.llm import warc as W
from scriptloom.llm.common import Workspace

SCHEMA = "page_id long, url string, html string"
LONG = "<p>" + "é long page " * 9000 + "</p>"
PAGES = [(5, "http://a/ b\r\nX: y", "<p>one</p>"), (3, "http://b", "<p>one</p>"), (9, None, "<p>one</p>"), (1, "u", LONG), (2, "u", LONG), (7, "u", ""), (8, "u", None), (10, "u", "<i>alone</i>"), (None, "u", "<p>one</p>"), (3, "http://b", "<p>one</p>")]


def test_pages_come_back(spark):
    pages = spark.createDataFrame([p for p in PAGES if p[0] is not None], SCHEMA).withColumn("refers_to", F.lit("clash"))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.archive_pages(spark, pages).collect()]
    firsts = {}
    for i, _, h in PAGES:
        if i is not None:
            firsts[h or ""] = min(firsts.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        if i is not None:
            first, raw = firsts[h or ""], (h or "").encode()
            want.append((i, len(raw), W.digest(raw), "response" if first == i else "revisit", None if first == i else first))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_null_id_revisits(spark):
    got = [r for r in W.archive_pages(spark, spark.createDataFrame(PAGES, SCHEMA)).collect() if r.page_id is None]
    assert [(r.record_type, r.refers_to, r.payload_bytes) for r in got] == [("revisit", 3, 10)]


def test_pages_of_one_payload_are_spread(spark):
    pages = spark.range(3000).selectExpr("id AS page_id", "'u' AS url", "if(id % 3 = 0, '<p>same</p>', concat('<p>', id, '</p>')) AS html")
    got = {r.page_id: r.refers_to for r in W.first_pages(pages).select("page_id", "refers_to").collect()}
    assert got == {i: 0 if i % 3 == 0 and i else None for i in range(3000)}


def test_an_empty_table(spark):
    assert W.archive_pages(spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_archives_are_plain_warc(spark):
    work = Workspace(spark, "warc-test")
    manifest = W.write_archives(W.first_pages(spark.createDataFrame(PAGES[:5], SCHEMA)).coalesce(1), f"{work.path}/a").collect()
    data = gzip.open(manifest[0].path.removeprefix("file://")).read()
    records = list(W.parse_records(io.BytesIO(data)))
    assert len(records) == manifest[0].records
    kinds = [f["warc-type"] for f, _ in records]
    assert kinds.count("revisit") == 3 and kinds.count("continuation") == len(W.http_block(LONG.encode())) // W.SEGMENT_BYTES
    assert all("\n" not in f.get("warc-target-uri", "") for f, _ in records)
    last = [f for f, _ in records if "warc-segment-total-length" in f]
    assert [int(f["warc-segment-total-length"]) for f in last] == [len(W.http_block(LONG.encode()))]
    work.drop()


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 100_000])
def test_chunked_framing(n):
    payload = bytes(i % 251 for i in range(n))
    assert W.unchunked(W.chunked(payload)) == payload
    assert W.http_payload(W.http_block(payload)) == payload


@pytest.mark.parametrize("data", [b"", b"5\r\nab", b"zz\r\n", b"3\r\nabcXX0\r\n\r\n"])
def test_broken_framing(data):
    with pytest.raises(ValueError):
        W.unchunked(data)


def test_extensions_and_trailers_are_passed_over():
    assert W.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: t\r\n\r\n") == b"abc"
    assert W.http_payload(b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc") == b"abc"


def records(spark, payload=LONG.encode()):
    work = Workspace(spark, "warc-parts")
    page = spark.createDataFrame([(1, "u", payload.decode(), None)], "page_id long, url string, html string, refers_to long")
    return W.read_records(spark, work.save(W.write_archives(page, f"{work.path}/a"), "m"))


def test_reassembly_checks_numbers_and_lengths(spark):
    whole = records(spark)
    good = W.reassemble(whole).collect()
    assert [(bytes(r.payload), r.error) for r in good] == [(LONG.encode(), None)]
    assert W.reassemble(whole.where("segment is null or segment <> 2")).first().error == "segments are missing or repeated"
    assert W.reassemble(whole.unionByName(whole.where("segment = 2"))).first().error == "segments are missing or repeated"
    most = whole.agg(F.max("segment")).first()[0]
    assert "total length" in W.reassemble(whole.where(f"segment <> {most}")).first().error
    wrong = whole.withColumn("stated_digest", F.when(F.col("stated_digest").isNotNull(), "A"))
    assert W.reassemble(wrong).first().error == "payload digest differs"


def test_payloads_below_the_least_are_all_responses(spark):
    got = W.first_pages(spark.createDataFrame(PAGES, SCHEMA), least=1).where("html = '' or html is null").collect()
    assert [r.refers_to for r in got] == [None, None]
