"""Checks across a document's parts.  Extensions: the model itself accepts what they report."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import body
from ..functions.text import optional
from .documents import blocks_long

NARRATOR = "Narrator"


def duplicate_ids(docs: DataFrame) -> DataFrame:
    """doc_key, id, uses of the identifiers that more than one block has."""
    return blocks_long(docs).where("id is not null").groupBy("doc_key", "id").agg(F.count("*").alias("uses")).where("uses > 1")


def has_duplicate_ids(blocks: Column) -> Column:
    """The same within a row, without a shuffle."""
    ids = F.filter(F.transform(blocks, lambda b: b["id"]), lambda i: i.isNotNull())
    return F.size(ids) != F.size(F.array_distinct(ids))


def dangling_speakers(docs: DataFrame) -> DataFrame:
    """doc_key, who: speakers of utterances that the header's cast doesn't have."""
    spoken = docs.select("doc_key", F.coalesce("header.profileDesc.speaker", F.array().cast("array<string>")).alias("cast"), F.explode("blocks").alias("b"))
    return spoken.where("b.who is not null").where(~F.array_contains("cast", F.col("b.who"))).select("doc_key", "b.who").distinct()


def dangling_references(pointers: DataFrame, docs: DataFrame, columns: tuple[str, ...] = ("from", "to")) -> DataFrame:
    """Pointers (doc_key and the columns) with a target that is no identifier of the document."""
    ids = blocks_long(docs).where("id is not null").select("doc_key", F.col("id").alias("target")).distinct()
    out = None
    for c in columns:
        own = pointers.withColumn("target", F.regexp_replace(c, "^#", "")).where("target is not null").join(ids, ["doc_key", "target"], "left_anti").select("doc_key", F.lit(c).alias("attribute"), "target")
        out = own if out is None else out.unionByName(own)
    return out


def outside_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value isn't one of a set."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed))


def span_errors(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """spans (doc_key, span_id, block_id, start, stop) that leave their block's text, end
    before they start, or name no block."""
    texts = blocks_long(docs).where("id is not null").select("doc_key", F.col("id").alias("block_id"), F.length(body.flat_text(F.col("inline"))).alias("size"))
    rows = spans.join(texts, ["doc_key", "block_id"], "left")
    open_ = F.col("start").isNull() | F.col("stop").isNull()
    error = F.when(F.col("size").isNull(), "unknown block").when(open_, "span without start or end").when(F.col("start") >= F.col("stop"), "empty span").when((F.col("start") < 0) | (F.col("stop") > F.col("size")), "outside the block")
    return rows.select("doc_key", "span_id", error.alias("error")).where("error is not null")


def span_texts(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """The text that each span marks."""
    texts = blocks_long(docs).where("id is not null").select("doc_key", F.col("id").alias("block_id"), body.flat_text(F.col("inline")).alias("text"))
    return spans.join(texts, ["doc_key", "block_id"]).select("doc_key", "span_id", F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start")).alias("text"))


def overlapping_spans(spans: DataFrame) -> DataFrame:
    """Spans that start before an earlier one of the same block has ended."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_key", "block_id").orderBy("start", "stop", "span_id").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reach", F.max("stop").over(w)).where(F.col("start") < F.col("reach")).select("doc_key", "block_id", "span_id")


def utterance_list(docs: DataFrame) -> DataFrame:
    """doc_key, block_pos, speaker, text; a speaker who isn't named is the narrator."""
    rows = blocks_long(docs).where("kind = 'u'")
    return rows.select("doc_key", "block_pos", F.coalesce("who", F.lit(NARRATOR)).alias("speaker"), body.flat_text(F.col("inline")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_key, blocks, segments, words."""
    rows = blocks_long(docs)
    words = F.size(F.filter(F.split(body.flat_text(F.col("inline")), r"\s+"), lambda w: w != "")).cast("bigint")
    return rows.groupBy("doc_key").agg(F.count("*").alias("blocks"), F.sum(F.size(F.filter("inline", lambda t: t["kind"] == "text")).cast("bigint")).alias("segments"), F.sum(words).alias("words"))


def content_hash(xml: Column) -> Column:
    return F.sha2(xml, 256)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_key, block_pos, change (added, removed, changed) between two sets of documents."""
    a, b = (blocks_long(d).select("doc_key", "block_pos", F.struct("kind", "id", "who", "inline").alias(n)) for d, n in ((left, "a"), (right, "b")))
    rows = a.join(b, ["doc_key", "block_pos"], "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return rows.select("doc_key", "block_pos", change.alias("change")).where("change is not null")


def _hashed(docs: DataFrame, side: str) -> DataFrame:
    each = F.transform("blocks", lambda b: F.xxhash64(b["kind"], b["id"], b["who"], F.to_json(b["inline"])))
    return docs.select("doc_key", each.alias(f"{side}_hashes"), F.transform("blocks", lambda b: b["id"]).alias(f"{side}_ids"))


def aligned_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_key, change (added, removed, changed, moved), left_pos, right_pos, id between two sets of
    documents, blocks being aligned by a longest common subsequence: what is put in or taken out
    changes nothing behind it.  See ``functions.align``; rows of documents on one side are added
    or removed.  Blocks are compared by 64-bit hashes; only hashes and identifiers are shuffled."""
    from ..functions.align import changes

    rows = _hashed(left, "left").join(_hashed(right, "right"), "doc_key", "full_outer")
    schema = T.StructType.fromDDL("doc_key string, change string, left_pos bigint, right_pos bigint, id string")
    types = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, a, names_a, b, names_b in zip(*(batch.column(c) for c in ("doc_key", "left_hashes", "left_ids", "right_hashes", "right_ids")), strict=True):
                own = [x.as_py() or [] for x in (a, b, names_a, names_b)]
                found = changes(*own)
                if found:
                    kinds, lefts, rights = zip(*found, strict=True)
                    ids = [own[2][i] if i is not None else own[3][j] for _, i, j in found]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([key.as_py()] * len(found), kinds, lefts, rights, ids), types, strict=True)], schema=types)

    return rows.mapInArrow(run, schema)


#: Blocks of a section of the digest tree.
SECTION = 64


def digest_tree(header: Column, blocks: Column) -> Column:
    """A struct of document, header, sections, blocks: SHA-256 of each block's canonical markup, of
    each run of SECTION blocks' digests, and of the header's markup followed by all sections'
    digests.  A block put at the end changes its own, one section's and the document's digest."""
    from ..functions.xml import block_xml, header_xml

    each = F.transform(blocks, lambda b: F.sha2(block_xml(b), 256))
    starts = F.when(F.size(blocks) > 0, F.sequence(F.lit(1), F.size(blocks), F.lit(SECTION))).otherwise(F.array().cast("array<int>"))
    return F.struct(F.sha2(header_xml(header), 256).alias("header"), each.alias("blocks"), starts.alias("starts"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_key, document, header, sections, blocks: the tree of each document, by built-in
    expressions, a projection for each level."""
    tree = digest_tree(F.col("header"), F.col("blocks"))
    rows = docs.select("doc_key", tree.alias("t")).select("doc_key", "t.header", "t.blocks", "t.starts")
    sections = F.transform("starts", lambda at: F.sha2(F.array_join(F.slice(F.col("blocks"), at, SECTION), ""), 256))
    rows = rows.select("doc_key", "header", sections.alias("sections"), "blocks")
    return rows.select("doc_key", F.sha2(F.concat("header", F.array_join("sections", "")), 256).alias("document"), "header", "sections", "blocks")


def changed_sections(left: DataFrame, right: DataFrame) -> DataFrame:
    """doc_key, section, block_pos of what differs between the trees (``digests``) of two sets of
    documents: documents of equal digest end at once, and of the others only sections of
    unlike digest are opened."""
    a, b = (d.select("doc_key", F.struct("document", "sections", "blocks").alias(n)) for d, n in ((left, "a"), (right, "b")))
    both = a.join(b, "doc_key", "full_outer").where(~F.col("a.document").eqNullSafe(F.col("b.document")))
    most = F.greatest(F.coalesce(F.size("a.sections"), F.lit(0)), F.coalesce(F.size("b.sections"), F.lit(0)))
    rows = both.where(most > 0).withColumn("section", F.explode(F.sequence(F.lit(0), most - 1)))
    rows = rows.where(~F.get("a.sections", F.col("section")).eqNullSafe(F.get("b.sections", F.col("section"))))
    rows = rows.withColumn("block_pos", F.explode(F.sequence(F.col("section") * SECTION, (F.col("section") + 1) * SECTION - 1)))
    rows = rows.where(~F.get("a.blocks", F.col("block_pos")).eqNullSafe(F.get("b.blocks", F.col("block_pos"))))
    return rows.select("doc_key", F.col("section").cast("bigint").alias("section"), F.col("block_pos").cast("bigint").alias("block_pos"))


def find_annotation_systems(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (doc_key, key) with the first system of that identifier, over whole tables."""
    rows = docs.select("doc_key", F.posexplode("header.encodingDesc.annotationSystem").alias("pos", "s"))
    first = rows.groupBy("doc_key", F.col("s.id").alias("key")).agg(F.min_by("s.desc", "pos").alias("desc"))
    return keys.join(first.withColumn("found", F.lit(True)), ["doc_key", "key"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


MODEL_VERSION = 2
#: The version of documents that state none.
UNSTATED = 1


def _empty_lists(docs: DataFrame) -> dict[str, Column]:
    """Version 0 left out what was empty: bodies, and the lists of a profile."""
    p, none = F.col("header.profileDesc"), F.array().cast("array<string>")
    lists = p.withField("speaker", F.coalesce(p["speaker"], none)).withField("lang", F.coalesce(p["lang"], none))
    return {"blocks": F.coalesce("blocks", body.empty_body()), "header": F.col("header").withField("profileDesc", F.when(p.isNotNull(), lists))}


def _blank_texts(docs: DataFrame) -> dict[str, Column]:
    """Version 1 kept optional texts that are blank; since then they are null."""
    f = F.col("header.fileDesc")
    return {"header": F.col("header").withField("fileDesc", f.withField("series", optional(f["series"])).withField("synopsis", optional(f["synopsis"])))}


#: What brings documents of a version to the next one: the columns it changes.
MIGRATIONS = {0: _empty_lists, 1: _blank_texts}


def versioned(docs: DataFrame) -> DataFrame:
    """The documents brought up to the model's version, step by step, with ``model_version``
    and ``version_error``.  One of a version that the library doesn't know, newer ones above
    all, stays as it is and has an error."""
    if "model_version" not in docs.columns:
        docs = docs.withColumn("model_version", F.lit(UNSTATED))
    out = docs.withColumn("model_version", F.coalesce(F.col("model_version").cast("int"), F.lit(UNSTATED)))
    for version, changed in sorted(MIGRATIONS.items()):
        due = F.col("model_version") == version
        out = out.withColumns({c: F.when(due, new).otherwise(F.col(c)) for c, new in changed(out).items()} | {"model_version": F.when(due, version + 1).otherwise(F.col("model_version"))})
    error = F.concat(F.lit("model version "), F.col("model_version").cast("string"), F.lit(f" is not known; this is version {MODEL_VERSION}"))
    return out.withColumn("version_error", F.when(F.col("model_version") != MODEL_VERSION, error))
