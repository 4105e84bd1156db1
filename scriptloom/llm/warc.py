"""Web archives: deduplicating writer, reader, and reassembly of segmented records.

``write_archives`` keeps pages as records of gzip-per-record archives.  The first page of a
payload (least identifier) is a response with its HTTP head and its payload in chunked
transfer framing; later ones are revisits without payload.  A block longer than
``SEGMENT_BYTES`` is cut: the first record has segment number 1, and continuation records
name its identifier as their origin; the last one states the total length.

``read_records`` reads archives back, record by record, and ``reassemble`` groups segments by
origin, orders them by number, verifies that none is missing or repeated and that the total
length is right, undoes the chunked framing, and gives payloads with their digests.  What
fails a check is kept with its ``error`` and no payload.

Payloads are looked up by digest, with a partial aggregate, among identifiers and digests
alone; of the pages themselves only those that may be revisits are shuffled, by identifier
and digest, so a payload with very many pages is spread.  Only segments are shuffled for
reassembly, grouped by record, so a group is one page.  Writing tasks name their files
themselves; only files that Spark's committed manifest lists are read.

Null html counts as an empty payload.  Rows with a null identifier revisit a page that has
one, if its payload is the same.  Repeated rows with the identifier of the response are
responses too.  Very long pages are cut into segments; reassembly holds one page at a time.
An empty table writes no archive and gives no rows.  Columns but page_id, url and html are
not read, so their names can't clash.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Workspace, sifted, tidy, unused

SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4 * 1024
ARCHIVE_BYTES = 64 * 1024 * 1024
MIN_BYTES = 0
#: Capture time written into records: the tables have none.
DATE = "2000-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing of a payload."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """The payload in chunked framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(data) < at + size + 2 or data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk ends too early")
        out.append(data[at : at + size])
        at += size + 2


def http_block(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP head has no end")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def record(kind: str, record_id: str, block: bytes, fields: dict[str, object]) -> bytes:
    """One record as a gzip member."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": DATE, **fields, "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    data = f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def page_records(record_id: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> Iterator[bytes]:
    """A page's record, or records if its block is cut into segments."""
    own = {"Page-ID": page_id, "WARC-Target-URI": url and " ".join(url.split()), "WARC-Payload-Digest": f"sha1:{digest(payload)}"}
    if refers_to is not None:
        yield record("revisit", record_id, b"", {**own, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Refers-To-Page-ID": refers_to})
        return
    own["Content-Type"] = "application/http;msgtype=response"
    block = http_block(payload)
    if len(block) <= SEGMENT_BYTES:
        yield record("response", record_id, block, own)
        return
    parts = range(0, len(block), SEGMENT_BYTES)
    for number, at in enumerate(parts, 1):
        part = block[at : at + SEGMENT_BYTES]
        if number == 1:
            yield record("response", record_id, part, {**own, "WARC-Segment-Number": 1})
        else:
            last = {"WARC-Segment-Total-Length": len(block)} if number == len(parts) else {}
            yield record("continuation", f"{record_id}-{number}", part, {"WARC-Segment-Origin-ID": f"<{record_id}>", "WARC-Segment-Number": number, **last})


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an uncompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts here: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends within a record")
        yield fields, block


def first_pages(pages: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """Adds ``refers_to``: the first page of the same payload, if that is another one and the
    payload has ``least`` bytes."""
    pages, sha1 = pages.drop("refers_to"), F.sha1(F.coalesce("html", F.lit("")))
    keys = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= least).select("page_id", sha1.alias("__sha1"))
    # Only payloads that several pages have take part in the joins.
    firsts = keys.groupBy("__sha1").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    other = ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    work = Workspace(pages.sparkSession, "revisits")
    revisits = work.save(keys.join(firsts, "__sha1").where(other).distinct(), "revisits")
    may, no = sifted(pages, revisits.select("page_id"), "page_id")
    id_, digest = unused(may.columns, "__id", "__own")
    own = revisits.select(F.col("page_id").alias(id_), F.col("__sha1").alias(digest), "refers_to")
    met = may.join(own, F.col("page_id").eqNullSafe(F.col(id_)) & (sha1 == F.col(digest)), "left")
    return met.select(*pages.columns, "refers_to").unionByName(no.withColumn("refers_to", F.lit(None).cast("long")))


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Writes the pages (page_id, url, html, refers_to) below ``root`` (a URI).  Returns,
    lazily, a row per archive: path, records."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        out = name = None
        size = count = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"path": [f"{root}/{name}"], "records": pa.array([count], pa.int64())})

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, count = fs.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                for data in page_records(f"urn:uuid:{uuid.uuid4()}", page_id, url, (html or "").encode(), refers_to):
                    out.write(data)
                    size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    yield row()
                    out = None
        if out is not None:
            out.close()
            yield row()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long")


RECORDS = "record_id string, record_type string, page_id long, refers_to long, origin_id string, segment long, total_length long, stated_digest string, block binary"


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The records of the archives in ``manifest``."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    number = lambda v: None if v is None else int(v)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, place = pafs.FileSystem.from_uri(path)
                rows, size = [], 0
                with fs.open_input_stream(place, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for f, block in parse_records(stream):
                        strip = lambda k, f=f: f[k].strip("<>") if k in f else None
                        rows.append((strip("warc-record-id"), f["warc-type"], number(f.get("page-id")), number(f.get("refers-to-page-id")), strip("warc-segment-origin-id"), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, block))
                        size += len(block)
                        if size >= BATCH_BYTES:
                            yield packed(rows)
                            rows, size = [], 0
                if rows:
                    yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    # A task for each archive, or for each few: they are some tens of megabytes.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts, "path").mapInArrow(run, RECORDS)


def reassemble(records: DataFrame) -> DataFrame:
    """A row per response or revisit: record_id, record_type, page_id, refers_to,
    stated_digest, payload, payload_bytes, payload_digest, error."""
    own = ["record_id", "record_type", "page_id", "refers_to", "stated_digest"]
    whole = records.where("segment is null").select(*own, F.array("block").alias("blocks"), F.array().cast("array<bigint>").alias("numbers"), F.lit(None).cast("long").alias("total"))
    parts = records.where("segment is not null").withColumn("record_id", F.coalesce("origin_id", "record_id"))
    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    ordered = F.array_sort(F.collect_list(F.struct("segment", "block")))
    joined = parts.groupBy("record_id").agg(*(first(c) for c in own[1:]), ordered.alias("s"), F.max("total_length").alias("total"))
    joined = joined.select(*own, F.col("s.block").alias("blocks"), F.col("s.segment").alias("numbers"), F.coalesce("total", F.lit(-1)).alias("total"))
    schema = "record_id string, record_type string, page_id long, refers_to long, stated_digest string, payload binary, payload_bytes long, payload_digest string, error string"

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_decoded(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("record_type", "stated_digest", "blocks", "numbers", "total")), strict=True)]
            new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.string(), pa.string()), strict=True)] if rows else [pa.array([], t) for t in (pa.binary(), pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *new], names=[*own, "payload", "payload_bytes", "payload_digest", "error"])

    return whole.unionByName(joined).mapInArrow(run, schema)


def _decoded(kind: str | None, stated: str | None, blocks: list[bytes], numbers: list[int], total: int | None) -> tuple[bytes | None, int | None, str | None, str | None]:
    """Payload, its size, its digest, and what is wrong."""
    if kind == "revisit":
        return None, None, stated, None
    if numbers and numbers != list(range(1, len(numbers) + 1)):
        return None, None, None, "segments are missing or repeated"
    block = b"".join(blocks)
    if numbers and total != len(block):
        return None, None, None, f"total length is {len(block)}, stated {total}"
    try:
        payload = http_payload(block)
    except ValueError as e:
        return None, None, None, str(e)
    own = digest(payload)
    return (payload, len(payload), own, None) if stated in (None, own) else (None, None, None, "payload digest differs")


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the pages' archives into the shared folder and reads every page back."""
    work = Workspace(spark, "warc")
    manifest = work.save(write_archives(first_pages(pages), f"{work.path}/archives"), "manifest")
    read = work.save(reassemble(read_records(spark, manifest)).drop("payload"), "read")
    responses = read.where("record_type = 'response'")
    # A revisit's length is that of the response it refers to.
    sizes = responses.where("error is null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("n"))
    revisits = read.where("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"], "left")
    out = lambda df, n: df.select("page_id", F.col(n).alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "error")
    return out(responses, "payload_bytes").unionByName(out(revisits.drop("payload_bytes"), "n"))
