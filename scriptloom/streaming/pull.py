"""Documents one block at a time, from tables or from folders that files arrive in.

``iter_blocks`` takes documents as texts of a column.  ``iter_pieces`` takes documents cut in
pieces, so that one may be larger than a row or a worker can hold; ``read_pieces`` cuts files
that way in the reader, ends of tags being the ends of pieces, and ``file_blocks`` is both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.body import TOKENS
from ..functions.pull import Document, Sender, pieces_of

BLOCK_ROWS = f"doc_key string, block_pos bigint, kind string, id string, who string, inline {TOKENS}, error string"


def _schema() -> T.StructType:
    return T.StructType.fromDDL(BLOCK_ROWS)


def iter_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """BLOCK_ROWS: a row for each block, in a batch or a stream, as soon as it closes.  A document
    that can't be parsed ends in a row with its error, behind the blocks before the fault.

    Memory beyond the text itself is that of one block and one batch."""
    schema = _schema()
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(types)
        for batch in batches:
            for key_, text_ in zip(*batch.columns, strict=True):
                doc = Document(key_.as_py(), sender)
                for piece in pieces_of(text_.as_py()):
                    yield from doc.feed(piece)
                yield from doc.feed(b"", True)
        yield from sender.take(False)

    return df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def iter_pieces(pieces: DataFrame, order: list[str] = ("piece_pos",), size: Column | None = None) -> DataFrame:
    """The same from rows (doc_key, piece, and the columns that order a document's pieces), text
    or binary.  One shuffle by ``doc_key`` and a sort, which spills; then each document is read
    through, and what a worker holds is a batch of pieces, one block and one batch of rows.

    ``size``: if pieces stand for a file cut at ``>``, which is left out between them, the file's
    bytes, by which it is known whether the last one was followed by it."""
    schema, cut = _schema(), size is not None
    types = to_arrow_schema(schema)
    rows = pieces.select("doc_key", F.col("piece").cast("binary").alias("piece"), *order, (size.cast("bigint") if cut else F.lit(0).cast("bigint")).alias("__size"))
    rows = rows.repartition("doc_key").sortWithinPartitions("doc_key", *order).select("doc_key", "piece", "__size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, doc, fed, whole = Sender(types), None, 0, 0

        def ended() -> Iterator[pa.RecordBatch]:
            yield from doc.feed(b">" if cut and fed < whole else b"", True)

        for batch in batches:
            for key, piece, bytes_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc is None or key != doc.key:
                    if doc is not None:
                        yield from ended()
                    doc, fed, whole = Document(key, sender), 0, bytes_
                elif cut:
                    piece = b">" + (piece or b"")
                fed += len(piece or b"")
                yield from doc.feed(piece or b"")
        if doc is not None:
            yield from ended()
        yield from sender.take(False)

    return rows.mapInArrow(run, schema)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """doc_key (the file), piece, block_start, piece_pos, size: files cut at every ``>``, by as
    many tasks as they have splits.  An empty file has no pieces."""
    files = spark.read.option("lineSep", ">").text(path)
    return files.select(F.col("_metadata.file_path").alias("doc_key"), F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("piece_pos"), F.col("_metadata.file_size").alias("size"))


def file_blocks(spark: SparkSession, path: str) -> DataFrame:
    """BLOCK_ROWS of files of any size, one document each."""
    return iter_pieces(read_pieces(spark, path), ["block_start", "piece_pos"], F.col("size"))


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the blocks of files, one document each, as they arrive."""
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    named = files.select(F.col("_metadata.file_path").alias("doc_key"), "value")
    return iter_blocks(named, "doc_key", "value")


def emit_stream(docs: DataFrame, path: str, checkpoint: str):
    """Writes a stream's documents (doc_key, header, blocks) as XML, whatever has arrived."""
    from ..operators.documents import emit

    return emit(docs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def register_tables(spark: SparkSession) -> None:
    """Table functions for SQL: ``parse_blocks(xml)``, behind LATERAL, gives block_pos, kind, id,
    who, inline, error of each block of a document; ``document_blocks(TABLE(t))`` gives
    BLOCK_ROWS for a table of keys and documents, in Arrow batches.  Both let each block go as
    soon as it closes."""
    schema = _schema()
    types = to_arrow_schema(schema)
    names = types.names[1:]

    class ParseBlocks:
        def eval(self, xml):
            sender = Sender(types)
            doc = Document(None, sender)
            for piece in (*pieces_of(xml), None):
                for batch in (*doc.feed(piece or b"", piece is None), *sender.take(False)):
                    for row in batch.to_pylist():
                        yield tuple(row[n] for n in names)

    class DocumentBlocks:
        def eval(self, table: pa.RecordBatch):
            sender = Sender(types)
            for key, text in zip(table.column(0), table.column(1), strict=True):
                doc = Document(None if key.as_py() is None else str(key.as_py()), sender)
                for piece in pieces_of(text.as_py()):
                    yield from doc.feed(piece)
                yield from doc.feed(b"", True)
            yield from sender.take(False)

    DocumentBlocks.eval.__annotations__ = {"table": pa.RecordBatch}
    spark.udtf.register("parse_blocks", F.udtf(ParseBlocks, returnType=T.StructType(schema.fields[1:]), useArrow=True))
    spark.udtf.register("document_blocks", F.arrow_udtf(DocumentBlocks, returnType=schema))
