"""What the corpus operators share: scratch tables, batch walking, table loading."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text handled together inside a Python worker.  Bounds its memory.
CHUNK_CHARS = 1_000_000
#: Bytes of one Arrow batch that a Python worker hands back to the JVM.
BATCH_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, where every process is on one machine, gets a folder of its
    own when the setting is missing.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = f"file://{tempfile.mkdtemp(prefix='scriptloom-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: The workspace within which operators make theirs, if a caller has set one.
_within: ContextVar[Workspace | None] = ContextVar("within", default=None)


class Workspace:
    """Tables and files of one run below the shared folder.

    A saved table cuts the lineage: what is read from it survives the loss of executors,
    as Spark's committed output does not live on any of them.

    Operators read their results lazily from tables they have saved.  A caller who wants
    them gone afterwards runs the operator and saves its result within ``temporary``:

        with Workspace(spark, "mine").temporary():
            jaccard.link_documents(docs).write.parquet(path)
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        outer = _within.get()
        self.path = f"{outer.path if outer else shared_root(spark)}/{label}-{uuid.uuid4().hex}"

    @contextmanager
    def temporary(self) -> Iterator[Workspace]:
        """All workspaces made inside lie within this one, and it is removed at the end."""
        before = _within.set(self)
        try:
            yield self
        finally:
            _within.reset(before)
            self.drop()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """Names for helper columns that no column has, whatever its case; longer than given if need be."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of the map that ``sifted`` broadcasts: at most 2 ** (SIFT_BITS - 6) rows of 16 bytes.
SIFT_BITS = 26


def sifted(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` may be among those of ``wanted``, and those whose key is not.

    A bit map of the wanted keys' hashes is broadcast; its size is bounded whatever the
    tables' sizes, and where it fills up more rows are "may be".  So a join of a large table
    with few keys shuffles little of it, and the other rows go on as they are.  Null keys
    are keys like any other.  ``wanted`` is read more than once: give a saved table."""
    place = F.xxhash64(key).bitwiseAND(F.lit((1 << SIFT_BITS) - 1))
    word = F.shiftright(place, 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    own = wanted.select(F.col(key).cast(rows.schema[key].dataType).alias(key))
    words, bits = unused(rows.columns, "__word", "__bits")
    map_ = own.select(word.alias(words), bit.alias("__bit")).groupBy(words).agg(F.bit_or("__bit").alias(bits))
    marked = rows.join(F.broadcast(map_), word == F.col(words), "left")
    may = F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))
    return marked.where(may).drop(words, bits), marked.where(~may).drop(words, bits)


#: The one large thing that this Python worker keeps between tasks, by its key.
_resident: dict = {}


def resident(key: tuple, make: Callable):
    """What ``make`` gives, kept by this Python worker while tasks ask for the same key.

    Spark uses workers again for other operators' tasks; whatever comes next takes the place
    of what was kept, so a worker never holds two operators' tables."""
    if key not in _resident:
        vacate()
        _resident[key] = make()
        give_back()
    return _resident[key]


def vacate() -> None:
    """Gives up what the worker keeps, and its memory back to the system."""
    if _resident:
        _resident.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Memory that is free in the worker goes back to the system where that's possible."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Rows of an Arrow batch at most, and its bytes: texts are long, and a batch stands in the JVM's
#: and in the worker's memory at once.
BATCH_ROWS, BATCH_MB = 1000, 8


def small_batches(spark: SparkSession) -> None:
    """From now on the session's jobs hand rows to Python workers in batches of BATCH_ROWS rows
    and BATCH_MB megabytes at most; smaller settings stay.  Results are read lazily, so the
    setting can't be taken back when an operator returns."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(rows, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
        spark.conf.set(size, f"{BATCH_MB}m")


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function for a worker that keeps nothing between tasks: idle workers would hold
    their memory while the executor's other tasks grow."""

    def tidied(batches: Iterator) -> Iterator:
        vacate()
        yield from run(batches)
        give_back()

    return tidied


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about ``limit`` characters each, and their texts (null: empty)."""
    texts = [x or "" for x in batch.column(text).to_pylist()]
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield batch.slice(start, i - start), texts[start:i]
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield batch.slice(start), texts[start:]
