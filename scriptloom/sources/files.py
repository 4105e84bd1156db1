"""Documents in files: one XML document a file in, text or Parquet out."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.json import quoted
from ..operators.documents import emit, parse


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Only a local
    session gets one of its own when the setting is missing."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='scriptloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a path, parsed: doc_key is the file's name."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_key"), "value")
    return parse(files, "doc_key", "value")


#: Where ``write_xml`` puts what can't be written; readers of the folder pass over it.
REJECTED = "_rejected"


def write_xml(docs: DataFrame, path: str) -> int:
    """A line for each document that can be written: its key as a JSON text, a tab, its XML.
    Line ends in texts are character references, so a line is a whole document.  The others'
    keys and errors go to a Parquet table below ``REJECTED``; returns how many they are."""
    seen = Observation("written")
    rows = emit(docs).observe(seen, F.count("error").alias("rejected"))
    line = F.concat_ws("\t", F.coalesce(quoted(F.col("doc_key")), F.lit("null")), F.replace("xml", F.lit("\n"), F.lit("&#10;")))
    rows.where("error is null").select(line.alias("value")).write.mode("error").text(path)
    rejected = seen.get["rejected"]
    if rejected:
        emit(docs).where("error is not null").select("doc_key", "error").write.mode("error").parquet(f"{path.rstrip('/')}/{REJECTED}")
    return rejected


def read_xml_lines(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_xml`` has written, parsed again, under the same keys."""
    cut = F.split("value", "\t", 2)
    key = F.get(F.from_json(F.concat(F.lit("["), cut[0], F.lit("]")), "array<string>"), 0)
    rows = spark.read.text(path, lineSep="\n").select(key.alias("doc_key"), cut[1].alias("value"))
    return parse(rows, "doc_key", "value")


def write_documents(docs: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet with the nested model, so a reader of titles reads titles alone."""
    docs.write.mode(mode).parquet(path)
