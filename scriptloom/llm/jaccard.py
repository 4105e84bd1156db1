"""Similarity join of documents by the Jaccard index of their word n-gram sets.

1. Each text gives its set of n-grams (hashes of ``N`` words, 64 bits; a text with fewer
   words is one n-gram, one with signs alone is one by itself), a key of 128 bits of the
   set, and MinHash signatures.  Copies share a key and are one set from here on.
2. Bands: ``plan_bands`` takes the number of rows that leaves the fewest chance candidates
   among those whose bands, within the budget of hashes, find a pair at the threshold with
   the wanted recall.  Sets are shuffled by band hash, not compared there: each bucket gives
   a star of edges to its least set, and components of these edges hold every candidate
   pair.
3. Components are cut into blocks of ``BLOCK`` sets.  A set is sent to those blocks alone
   in which another shares a band with it; each pair of blocks is a group of its own in
   which the pairs that share a band are verified on their full n-gram sets.  A group
   returns a row for each of its sets, with its links and its root, never pairs.
4. Components of the verified links are the classes.

``link_documents`` returns a row for each document: ``class_id``, the least identifier of
its class, and ``n_links``, the number of other documents that are as similar as the
threshold, copies included.  Cost beyond the linear part is that of verifying candidates.

Null and empty texts have no n-grams: they are linked to nothing, each a class of its own
with its identifier.  Texts of signs or white space alone are linked to their exact copies.
Rows with null identifiers are linked too; a class of such rows alone has a null class_id.
Repeated rows are copies; rows that share an identifier are documents of their own.  Very
long texts are cut into words a million characters at a time; their set is one row.  An
empty table gives no rows.  Other columns are not read, so their names can't clash;
``one_of_each`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, chunks, sifted, tidy, unused
from .graph import components
from .words import TOGETHER, mixed, windows, words

N = 5
#: The threshold as a fraction, so that comparisons are exact.
NUMERATOR, DENOMINATOR = 4, 5
RECALL, HASHES = 0.9999, 336
BLOCK = 256
#: Pairs in a block pair beyond which intersections are counted by matrices.
DENSE = 2000


def plan_bands(threshold: float = NUMERATOR / DENOMINATOR, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance candidates, with the wanted recall."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    raise ValueError("more hashes are needed")


@lru_cache
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def signature(grams: np.ndarray, n: int) -> np.ndarray:
    """n least values of the n-grams' hashes, each under another permutation of 32 bits."""
    a, b = _multipliers(n)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 1024):
        values = np.multiply.outer(a, x[lo : lo + 1024])
        values += b[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band, different for equal values in different bands."""
    out = np.arange(1, bands + 1, dtype=np.uint64)
    cut = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
    for k in range(rows):
        out = mixed(out ^ mixed(cut[:, k] + np.uint64(k + 1 << 32)))
    return out.view(np.int64)


def gram_sets(texts: list[str], n: int = N) -> list[np.ndarray]:
    """The sorted set of n-gram hashes of each text."""
    found = words(texts)
    cuts = np.searchsorted(found.text, np.arange(len(texts) + 1))
    out = []
    for text, lo, hi in zip(texts, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi > lo:
            out.append(np.unique(windows(found.hash[lo:hi], min(n, hi - lo))))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))] if text else [], np.uint64))
    return out


def set_key(grams: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None


def tag_of(doc_id: str, text: str) -> Column:
    """A digest of a row's identifier and text."""
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def sign(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, tag, key, bands of each document."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, texts in chunks(batch, "text", TOGETHER):
                sets = gram_sets(texts, n)
                keys = [set_key(s) for s in sets]
                hashed: dict = {}
                for k, s in zip(keys, sets, strict=True):
                    if k is not None and k not in hashed:
                        hashed[k] = band_hashes(signature(s, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("tag"), pa.array(keys, pa.binary()), pa.array([hashed.get(k) for k in keys], pa.list_(pa.int64()))], names=["doc_id", "tag", "key", "bands"])

    return docs.select("doc_id", "text", tag_of("doc_id", "text").alias("tag")).mapInArrow(run, "doc_id long, tag string, key binary, bands array<long>")


def with_grams(docs: DataFrame, n: int) -> DataFrame:
    """key, grams (little-endian 64-bit) of each document with words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch, "text", TOGETHER):
                sets = [s for s in gram_sets(texts, n) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "grams"])

    return docs.select("text").mapInArrow(run, "key binary, grams binary")


def intersections(left: list[np.ndarray], right: list[np.ndarray], mask: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs in ``mask``."""
    out = np.zeros(mask.shape, np.int64)
    i, j = np.nonzero(mask)
    if len(i) <= DENSE:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = (left[a], right[b]) if len(left[a]) <= len(right[b]) else (right[b], left[a])
            at = np.searchsorted(y, x)
            out[a, b] = (y[np.minimum(at, len(y) - 1)] == x).sum()
        return out
    # Columns are the n-grams that both sides have, some thousands at a time.
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))
    for lo in range(0, len(shared), 4096):
        part = shared[lo : lo + 4096]
        a, b = (_rows(side, part) for side in (left, right))
        out += np.rint(a @ b.T).astype(np.int64)
    return out


def _rows(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), np.float32)
    for k, s in enumerate(sets):
        own = s[np.searchsorted(s, columns[0]) : np.searchsorted(s, columns[-1], "right")]
        at = np.searchsorted(columns, own)
        out[k, at[columns[at] == own]] = 1
    return out


def verify(sets: list[np.ndarray], bands: np.ndarray, side: np.ndarray | None, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set, counted in documents, and the root of its group.  ``side``: None
    if all pairs count, else which block a set is of, and pairs are across."""
    lo, hi = (np.arange(len(sets)),) * 2 if side is None else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    root, links = np.arange(len(sets)), np.zeros(len(sets), np.int64)
    if not len(lo) or not len(hi):
        return links, root
    mask = np.zeros((len(lo), len(hi)), bool)
    for k in range(bands.shape[1]):
        mask |= bands[lo, k][:, None] == bands[hi, k][None]
    if side is None:
        mask &= np.triu(np.ones_like(mask), 1)
    sizes = np.array([len(s) for s in sets])
    both = intersections([sets[i] for i in lo], [sets[i] for i in hi], mask)
    union = sizes[lo][:, None] + sizes[hi][None] - both
    i, j = np.nonzero(mask & (both * DENOMINATOR >= union * NUMERATOR))
    a, b = lo[i], hi[j]
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    while len(a):  # least label of a neighbour, until nothing changes
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            break
    return links, root


def verified(members: DataFrame) -> DataFrame:
    """key, root, links: a row for each set in each pair of blocks.  ``members``: component,
    low, high (the blocks), block, key, copies, bands, grams, sorted by the first three."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def done() -> pa.RecordBatch:
            rows.sort(key=lambda r: r[1])  # by key, so that the least index is the least key
            block, keys, copies, bands, grams = zip(*rows, strict=True)
            side = None if group[1] == group[2] else (np.array(block) == group[2]).astype(int)
            links, root = verify([np.frombuffer(g, np.uint64) for g in grams], np.array(bands), side, np.array(copies))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([keys[r] for r in root], pa.binary()), pa.array(links, pa.int64())], names=["key", "root", "links"])

        for batch in batches:
            heads = zip(*(batch.column(c).to_pylist() for c in ("component", "low", "high")), strict=True)
            rest = zip(*(batch.column(c).to_pylist() for c in ("block", "key", "copies", "bands", "grams")), strict=True)
            for head, row in zip(heads, rest, strict=True):
                if head != group and rows:
                    yield done()
                    rows = []
                group = head
                rows.append(row)
        if rows:
            yield done()

    return members.mapInArrow(run, "key binary, root binary, links long")


def link_sets(docs: DataFrame, n: int = N, label: str = "jaccard") -> tuple[DataFrame, DataFrame]:
    """(doc_id, tag, key) for each document (doc_id, text), with a null key if it has no
    words; and (key, root, class_id, n_links) for each set."""
    spark = docs.sparkSession
    bands, rows = plan_bands()
    work = Workspace(spark, label)
    signed = work.save(sign(docs, n, bands, rows), "signed")
    known = signed.where("key is not null")
    sets = work.save(known.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.first("bands").alias("bands")), "sets")

    inside = sets.select("key", F.explode("bands").alias("band"))
    buckets = inside.groupBy("band").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    stars = inside.join(buckets, "band").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    found = components(stars, work, "candidates")

    parts = found.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = found.join(parts, "root").select(F.col("node").alias("key"), F.col("root").alias("component"), "blocks").join(sets, "key")
    placed = work.save(placed.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), "placed")
    # Components of one block need no look at their bands; in others, the blocks a band is in.
    banded = placed.where("blocks > 1").select("key", "block", F.explode("bands").alias("band"))
    spread = banded.groupBy("band").agg(F.collect_set("block").alias("others"))
    met = banded.join(spread, "band").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    met = met.unionByName(placed.where("blocks = 1").select("key", F.array(F.lit(0)).alias("others")))
    # One document of each candidate set gives its n-grams; those without identifier apart.
    # What can't be a candidate isn't shuffled, and candidates are never broadcast whole.
    ids = placed.where("first_id is not null").select(F.col("first_id").alias("doc_id")).distinct()
    able, _ = sifted(docs.select("doc_id", "text"), ids, "doc_id")
    texts = able.join(ids.hint("merge"), "doc_id", "left_semi").select("text").unionByName(docs.where("doc_id is null").select("text"))
    grams = with_grams(texts, n).dropDuplicates(["key"])
    cut = placed.join(met, "key").join(grams, "key").withColumn("other", F.explode("others"))
    cut = cut.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).select("component", "low", "high", "block", "key", "copies", "bands", "grams")
    checked = work.save(verified(cut.repartition("component", "low", "high").sortWithinPartitions("component", "low", "high")), "verified")
    work.drop("placed")

    classes = components(checked.select(F.col("key").alias("a"), F.col("root").alias("b")), work, "classes")
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    each = sets.select("key", "copies", "first_id").join(links, "key", "left").join(classes.withColumnRenamed("node", "key"), "key", "left")
    each = each.select("key", F.coalesce("root", "key").alias("root"), "first_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    least = each.groupBy("root").agg(F.min("first_id").alias("class_id"))
    each = work.save(each.join(least, "root").select("key", "root", "class_id", "n_links"), "result")
    return signed.select("doc_id", "tag", "key"), each


def link_documents(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, class_id, n_links for each document (doc_id, text)."""
    signed, each = link_sets(docs, n)
    out = signed.join(each, "key", "left")
    alone = F.col("key").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, n: int = N) -> DataFrame:
    """One document of each class, with all its columns: that of the least identifier, of
    those the one with the least digest, of repeated rows any.  Null and empty texts stay."""
    signed, each = link_sets(docs, n, "distinct")
    members = signed.join(each, "key").select("root", "doc_id", "tag")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "tag")
    groups = members.groupBy("root").agg(F.min(order)["tag"].alias("first"), F.count("*").alias("n")).where("n > 1")
    work = Workspace(docs.sparkSession, "distinct")
    crowd = work.save(members.join(groups, "root").select("doc_id", "tag", (F.col("tag") == F.col("first")).alias("kept")).distinct(), "crowd")
    # Only documents that may have copies are shuffled.
    able, alone = sifted(docs, crowd.select("doc_id"), "doc_id")
    own, kept, row = unused(docs.columns, "__own", "__kept", "__row")
    marks = crowd.select(F.col("tag").alias(own), F.col("kept").alias(kept))
    found = able.withColumn(own, tag_of("doc_id", F.col("text"))).join(marks, own, "left").where(F.coalesce(kept, F.lit(True)))
    # Of repeated rows that are kept one stays; those outside the crowd are all kept.
    once = found.withColumn(row, F.when(F.col(kept).isNull(), F.monotonically_increasing_id())).dropDuplicates([own, row])
    return once.select(*docs.columns).unionByName(alone)


ORACLE = f"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents
), grams AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i : i + {N - 1}], ' ') AS gram
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - {N - 2}))) AS i FROM worded WHERE len(ws) > 0)
    UNION SELECT doc_id, '|' || text FROM documents WHERE text <> '' AND len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) = 0
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
    WHERE common.n * {DENOMINATOR} >= (a.n + b.n - common.n) * {NUMERATOR}
), reached AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y
), classes AS (SELECT x AS doc_id, min(y) AS class_id FROM reached GROUP BY x),
counts AS (SELECT x AS doc_id, count(*) AS n FROM links GROUP BY x)
SELECT d.doc_id, c.class_id, coalesce(k.n, 0)::BIGINT AS n_links
FROM documents d JOIN classes c USING (doc_id) LEFT JOIN counts k USING (doc_id)
"""
