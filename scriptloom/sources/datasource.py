"""Documents as a Spark data source: ``spark.read.format("scripts").load(folder)``.

A folder has files ``*.scripts`` of lines, as ``sources.files.write_xml`` writes them: a key as a
JSON text, a tab, canonical XML whose line ends are character references.

* Reader: a task for each file and each ``split`` bytes of it (option, 64 MB by default).  Rows
  are file, doc_key, header, blocks, error; parsing happens where the bytes are read.  Filters
  on ``file`` (``=``, ``in``, ``startswith``) drop files before they are opened.
* Stream reader: files in order of their names, which the writer makes ascend.
* Writer: takes rows doc_key, xml (what ``operators.documents.emit`` makes, its errors apart).
  Tasks write below ``_writing``; only the commit, given the names of the tasks that ended
  well, moves their files into the folder.  What a killed or repeated task has left is never
  read and goes with that folder.

Paths are those of Arrow's file systems: plain ones, and URIs such as file:, hdfs: and s3:.
A null key is ``null``; null or empty documents can't be written and fail the job.  An empty folder
gives no rows.
"""

from __future__ import annotations

import io
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.parse import as_arrow, guarded, read_xml
from ..operators.documents import SCHEMA

NAME, SUFFIX, WRITING = "scripts", ".scripts", "_writing"
SPLIT = 64 << 20
#: Lines whose documents are held at once.
TOGETHER = 100
ROWS = f"file string, {SCHEMA}, error string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def listed(folder: str) -> list[fs.FileInfo]:
    """The folder's files by name."""
    system, path = opened(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f for f in found if f.is_file and f.base_name.endswith(SUFFIX)), key=lambda f: f.base_name)


@dataclass
class Part(InputPartition):
    """The lines of a file that start within some bytes."""

    name: str
    start: int
    stop: int


def parts(files: list[fs.FileInfo], split: int) -> list[Part]:
    return [Part(f.base_name, at, min(at + split, f.size)) for f in files for at in range(0, f.size, split)]


def lines(folder: str, part: Part) -> Iterator[bytes]:
    """A line belongs to the part that its first byte is in."""
    system, path = opened(folder)
    with io.BufferedReader(system.open_input_file(f"{path}/{part.name}"), 1 << 20) as file:
        # The line that runs into the part, if one does, is the part's before.
        at = max(part.start - 1, 0)
        file.seek(at)
        if part.start:
            at += len(file.readline())
        while at < part.stop:
            line = file.readline()
            if not line:
                return
            at += len(line)
            yield line.rstrip(b"\n")


def rows_of(folder: str, part: Part, types: pa.Schema) -> Iterator[pa.RecordBatch]:
    made = pa.struct([types.field(n) for n in ("header", "blocks", "error")])

    def batch(held: list[tuple]) -> pa.RecordBatch:
        keys, docs = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array([part.name] * len(held)), pa.array(keys, pa.string()), *as_arrow(list(docs), made).flatten()], schema=types)

    held: list[tuple] = []
    for line in lines(folder, part):
        key, _, text = line.decode("utf-8", "replace").partition("\t")
        try:
            key = json.loads(key)
        except ValueError:
            key, text = None, ""  # no line of this format: its document is none either
        held.append((key if key is None else str(key), guarded(read_xml, text)))
        if len(held) == TOGETHER:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def keeps(filters: list, name: str) -> bool:
    for f in filters:
        if isinstance(f, EqualTo) and f.value != name or isinstance(f, In) and name not in f.value or isinstance(f, StringStartsWith) and not name.startswith(f.value):
            return False
    return True


class ScriptReader(DataSourceReader):
    def __init__(self, options, schema):
        self.folder, self.split, self.types = options["path"], int(options.get("split", SPLIT)), to_arrow_schema(schema)
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and tuple(f.attribute) == ("file",):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        return parts([f for f in listed(self.folder) if keeps(self.filters, f.base_name)], self.split) or [Part("", 0, 0)]

    def read(self, partition):
        if partition.name:
            yield from rows_of(self.folder, partition, self.types)


class ScriptStreamReader(DataSourceStreamReader):
    def __init__(self, options, schema):
        self.types = to_arrow_schema(schema)
        self.folder, self.split = options["path"], int(options.get("split", SPLIT))

    def initialOffset(self):
        return {"after": ""}

    def latestOffset(self):
        return {"after": max((f.base_name for f in listed(self.folder)), default="")}

    def partitions(self, start, end):
        return parts([f for f in listed(self.folder) if start["after"] < f.base_name <= end["after"]], self.split)

    def read(self, partition):
        yield from rows_of(self.folder, partition, self.types)


@dataclass
class Written(WriterCommitMessage):
    """The files of a task that has ended well."""

    names: list[str]


class ScriptWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        # Later jobs' names are greater, so that a stream meets them later.
        self.job = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, iterator):
        system, path = opened(self.folder)
        name = f"{self.job}-{uuid.uuid4().hex}{SUFFIX}"
        system.create_dir(f"{path}/{WRITING}/{self.job}", recursive=True)
        count = 0
        with system.open_output_stream(f"{path}/{WRITING}/{self.job}/{name}") as out:
            for batch in iterator:
                for key, text in zip(batch.column("doc_key").to_pylist(), batch.column("xml").to_pylist(), strict=True):
                    if not text:
                        raise ValueError(f"no document to write under the key {key!r}")
                    out.write((json.dumps(key) + "\t" + text.replace("\n", "&#10;") + "\n").encode())
                    count += 1
        return Written([name] if count else [])

    def commit(self, messages):
        system, path = opened(self.folder)
        old = listed(self.folder) if self.overwrite else []
        system.create_dir(path, recursive=True)
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{path}/{WRITING}/{self.job}/{name}", f"{path}/{name}")
        for f in old:
            system.delete_file(f.path)
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self) -> None:
        system, path = opened(self.folder)
        if system.get_file_info(f"{path}/{WRITING}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{WRITING}/{self.job}")


class ScriptSource(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return ROWS

    def reader(self, schema):
        return ScriptReader(self.options, schema)

    def streamReader(self, schema):
        return ScriptStreamReader(self.options, schema)

    def writer(self, schema, overwrite):
        if {"doc_key", "xml"} - set(schema.names):
            raise ValueError("doc_key and xml are written")
        return ScriptWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it be given filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ScriptSource)
