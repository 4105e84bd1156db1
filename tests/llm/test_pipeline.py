import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from scriptloom.llm.common import Workspace

from .test_jaccard import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage reads and returns."""
    work, docs, out = Workspace(spark, "stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in C.STAGES:
        result = work.save(stage(spark, docs, SF), name)
        out[name] = docs, result
        docs = result
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_names_and_columns(stages):
    assert [n for n, _ in C.STAGES] == list(stages) and C.ORACLE_SQL is None
    for before, after in list(stages.values())[:-1]:
        assert after.dtypes == before.dtypes


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = set(ids(after))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(t for i, t in known.items() if i in kept) <= sum(known.values()) / 2
    assert sum(1 for i, t in known.items() if not t and i in kept) >= 0.97 * sum(1 for t in known.values() if not t)
    assert after.join(before, ["doc_id", "text"], "left_anti").count() == 0


def test_one_of_each_group_stays(stages):
    before, after = stages["ngram_jaccard_join"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    classes = brute([t for _, t in rows])
    assert ids(after) == sorted({rows[c][0] for c, _ in classes})


def test_leaks_go(spark, stages):
    before, after = stages["benchmark_decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = [r.doc_id for r in before.collect() if any(x in r.text for x in items)]
    assert not set(hit) & set(ids(after)) and len(ids(before)) - len(ids(after)) <= len(hit) + 2


def test_personal_data_make_way(stages):
    before, after = stages["pii_surrogates"]
    both = before.join(after.withColumnRenamed("text", "new").drop("lang", "source"), "doc_id").collect()
    assert len(both) == before.count()
    import re

    mail = re.compile(r"[\w.]+@[\w.]+\w")
    for r in both:
        assert not set(mail.findall(r.text)) & set(mail.findall(r.new)) and len(mail.findall(r.text)) == len(mail.findall(r.new))
    assert after.where(F.col("n_chars") != F.length("text")).count() == 0


def test_ids_decode_to_the_text(stages):
    before, after = stages["byte_bpe"]
    joined = before.select("doc_id", F.sha2("text", 256).alias("h")).join(after, "doc_id")
    assert joined.count() == before.count() and joined.where("h <> decoded_sha256").count() == 0


def test_empty_and_odd_tables(spark, none, odd):
    for name, stage in C.STAGES:
        assert stage(spark, none, SF).count() == 0, name
        assert stage(spark, odd, SF).count() <= odd.count(), name


def test_columns_of_any_names_pass_through(spark):
    names = ["score", "Entities", "__bits", "__word", "__m", "__p", "__x", "__own", "__kept", "__row", "__id", "__tag", "__text", "own_score", "tag", "key"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    work = Workspace(spark, "names")
    for name, stage in C.STAGES[:-1]:
        docs = work.save(stage(spark, docs, SF), name)
        assert docs.columns[-len(names) :] == names
    rows = docs.collect()
    assert len(rows) > 20 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    last = C.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(rows)


def test_batches_are_made_smaller_but_never_larger(spark):
    from scriptloom.llm.common import BATCH_ROWS, small_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for value, want in (("10000", str(BATCH_ROWS)), ("7", "7"), ("0", str(BATCH_ROWS))):
        spark.conf.set(key, value)
        small_batches(spark)
        assert spark.conf.get(key) == want
    spark.conf.set(key, before)
