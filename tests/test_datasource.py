"""Documents as a data source: tasks' files, filters, streams."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from scriptloom.operators import documents as D
from scriptloom.sources import datasource as S
from scriptloom.sources.tables import conversation_documents

HEAD = "<TEI><teiHeader><fileDesc><title>T</title></fileDesc></teiHeader><text><body>"


@pytest.fixture
def own(spark):
    S.register(spark)
    c = spark.createDataFrame([(i, t, "user", f"said\n{i}\té" * (i % 7 + 1)) for i in range(40) for t in range(3)], "conv_id long, turn long, role string, text string")
    return conversation_documents(c)


def write(docs, path, mode="append"):
    D.emit(docs).select("doc_key", "xml").repartition(3).write.format(S.NAME).mode(mode).save(path)


def files(path):
    return sorted(f for f in os.listdir(path) if f.endswith(S.SUFFIX))


@pytest.mark.parametrize("split", [700, 1 << 20])
def test_what_is_written_is_read_whatever_the_splits(spark, own, tmp_path, split):
    path = str(tmp_path / "docs")
    write(own, path)
    read = spark.read.format(S.NAME).option("split", split).load(path)
    assert len(files(path)) == 3 and os.listdir(f"{path}/{S.WRITING}") == []
    same = read.join(own.select("doc_key", F.struct("header", "blocks").alias("own")), "doc_key").where(F.col("own").eqNullSafe(F.struct("header", "blocks")) & F.col("error").isNull())
    assert read.count() == 40 == same.count()
    assert set(r.file for r in read.select("file").distinct().collect()) == set(files(path))


def test_a_line_is_of_the_split_it_starts_in(tmp_path):
    body = [b"1\tab", b"2\t", b"", b"3\tc" * 9, b"4"]
    for end in (b"\n", b""):
        (tmp_path / "x.scripts").write_bytes(b"\n".join(body) + end)
        (info,) = S.listed(str(tmp_path))
        for split in range(1, 60):
            assert [x for p in S.parts([info], split) for x in S.lines(str(tmp_path), p)] == body


def test_rows_that_are_no_documents(spark, own, tmp_path):
    lines = ["nothing", '"k"\t<TEI>', "null\t" + HEAD + "<p>a</p></body></text></TEI>", "7\t" + HEAD + "</body></text></TEI>", "{\t"]
    (tmp_path / "x.scripts").write_text("\n".join(lines))
    (tmp_path / "other.txt").write_text("not read")
    got = [(r.doc_key, r.error is None) for r in spark.read.format(S.NAME).load(str(tmp_path)).collect()]
    assert got == [(None, False), ("k", False), (None, True), ("7", True), (None, False)]
    assert spark.read.format(S.NAME).load(str(tmp_path / "absent")).collect() == []


def test_a_failed_job_leaves_nothing_to_read(spark, own, tmp_path):
    path = str(tmp_path / "docs")
    write(own, path)
    rows = D.emit(own).select("doc_key", F.when(F.col("doc_key") != "5", F.col("xml")).alias("xml")).repartition(3)
    with pytest.raises(Exception, match="no document to write"):
        rows.write.format(S.NAME).mode("append").save(path)
    assert spark.read.format(S.NAME).load(path).count() == 40 and os.listdir(f"{path}/{S.WRITING}") == []
    # A killed task's part of a file stays below _writing, which no reader looks into.
    os.makedirs(f"{path}/{S.WRITING}/job")
    with open(f"{path}/{S.WRITING}/job/half{S.SUFFIX}", "w") as out:
        out.write('"half"\t<TEI>')
    assert spark.read.format(S.NAME).load(path).count() == 40
    write(own.limit(4), path, "overwrite")
    assert spark.read.format(S.NAME).load(path).count() == 4


def test_filters_drop_files_before_they_are_opened(spark, own, tmp_path):
    path = str(tmp_path / "docs")
    write(own, path)
    names = files(path)
    for filters, kept in (([EqualTo(("file",), names[1])], names[1:2]), ([In(("file",), (names[0], "x"))], names[:1]), ([StringStartsWith(("file",), names[2])], names[2:]), ([EqualTo(("doc_key",), "1")], names)):
        reader = S.ScriptReader({"path": path}, spark.read.format(S.NAME).load(path).schema)
        rest = list(reader.pushFilters(filters))
        assert (rest == []) == (kept is not names) and sorted({p.name for p in reader.partitions()}) == kept
    one = spark.read.format(S.NAME).load(path).where(F.col("file") == names[0])
    assert one.rdd.getNumPartitions() == 1 and {r.file for r in one.collect()} == {names[0]}


def test_a_stream_meets_each_file_once(spark, own, tmp_path):
    path, at = str(tmp_path / "docs"), str(tmp_path / "at")

    def run():
        q = spark.readStream.format(S.NAME).load(path).select("doc_key", "error").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", at).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
        return sorted(int(r.doc_key) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    write(own.where("cast(doc_key AS int) < 20"), path)
    assert run() == list(range(20))
    write(own.where("cast(doc_key AS int) >= 20"), path)
    assert run() == list(range(40)) == run()


def test_lines_are_those_of_the_plain_writer(spark, own, tmp_path):
    from scriptloom.sources import files as plain

    write(own, str(tmp_path / "docs"))
    for f in files(tmp_path / "docs"):
        os.rename(tmp_path / "docs" / f, tmp_path / "docs" / (f + ".txt"))
    assert plain.read_xml_lines(spark, str(tmp_path / "docs")).where("error is null").count() == 40
