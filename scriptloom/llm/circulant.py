"""Near duplicates by circulant MinHash and exact Jaccard verification.

Words are what ASCII white space leaves, with A-Z lower-cased.  A document's set has a 64-bit
hash for each distinct run of ``N`` words; fewer words are one run.  Documents are linked where
``100 * |A & B| >= 80 * |A | B|``.

1. Signatures from two permutations of the 32-bit numbers: with s the first and p the second,
   coordinate k is the least ``p(s(x) + k)`` over the set, s's image being shifted by k places
   around the circle.  Both are fixed bijections, so nothing is drawn or stored.
2. Equal sets are one row from here on, by a 128-bit key.  Band hashes (``plan_bands``) are
   shuffled; a bucket gives a star of edges to its least key, and components of the stars
   hold every candidate pair.
3. A component within one block (``BLOCK`` sets and ``BLOCK_BYTES`` of hashes) is a group: its
   pairs that share a band are verified on their full sets.  Larger components are verified
   in two steps.  First each set against the least hub of its buckets, in groups of a hub and
   one block; so near copies by the thousand fall into few classes at a cost that grows with their
   number alone.  Then pairs of blocks in which sets of different classes share a band, and
   there only pairs of different classes; a class needs no link that it already has.
4. Components of the verified links are the result.

``near_duplicates`` returns doc_id, n_shingles, component_id (the least identifier that can be
reached), kept (whether that is the document's own).  Null texts and those without words have
no runs and are linked to nothing.  Rows without identifier are linked too; a component of them
alone has a null component_id, and none of them is kept.  Repeated rows are documents of their
own with equal sets; all that have the least identifier are kept.  Very long texts are cut into
words a part at a time; their set is one row.  An empty table gives no rows.  Other columns are
not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, chunks, sifted, tidy
from .graph import components
from .jaccard import band_hashes, intersections, plan_bands, set_key
from .words import windows

N = 4
#: The threshold as a fraction, so that comparisons are exact.
NUMERATOR, DENOMINATOR = 80, 100
RECALL, HASHES = 0.9999, 192
#: Sets of a block on average, and bytes of their hashes.
BLOCK, BLOCK_BYTES = 256, 4_000_000
#: Characters handled together, and at once of a longer text.
TOGETHER, SPAN = 250_000, 1 << 20
#: Hashes whose coordinates are made at once.
TILE = 512


def word_hashes(text: str) -> np.ndarray:
    own = text.encode("utf-8", "replace").lower()  # bytes lower only A-Z, and split at ASCII white space
    if len(own) <= SPAN:
        found = own.split()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    out, at = [], 0
    while at < len(own):
        stop = at + SPAN
        while stop < len(own) and not own[stop : stop + 1].isspace():
            stop += 1
        found = own[at:stop].split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))
        at = stop
    return np.concatenate(out)


def shingles(text: str, n: int = N) -> np.ndarray:
    """The sorted set of a text's runs of words, as hashes."""
    own = word_hashes(text)
    return np.unique(windows(own, min(n, len(own)))) if len(own) else own


def _second(x: np.ndarray) -> np.ndarray:
    """In place, a bijection of 32-bit numbers in which every bit depends on all."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def circulant_signature(grams: np.ndarray, n: int) -> np.ndarray:
    """n coordinates of a set of 64-bit hashes."""
    # The first permutation: an odd multiple and a shift of the hashes' upper halves.
    first = (grams >> np.uint64(32)).astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    shift = np.arange(n, dtype=np.uint32)[:, None]
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(first), TILE):
        np.minimum(out, _second(first[None, lo : lo + TILE] + shift).min(axis=1), out=out)
    return out


def sign(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key, size, bands of each document."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, texts in chunks(batch, "text", TOGETHER):
                sets = [shingles(t, n) for t in texts]
                keys = [set_key(s) for s in sets]
                hashed: dict = {}
                for k, s in zip(keys, sets, strict=True):
                    if k is not None and k not in hashed:
                        hashed[k] = band_hashes(circulant_signature(s, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashed.get(k) for k in keys], pa.list_(pa.int64()))], names=["doc_id", "key", "size", "bands"])

    return docs.mapInArrow(run, "doc_id long, key binary, size long, bands array<long>")


def with_sets(texts: DataFrame, n: int) -> DataFrame:
    """key, grams (little-endian 64-bit) of each text with words."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, own in chunks(batch, "text", TOGETHER):
                sets = [s for s in (shingles(t, n) for t in own) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "grams"])

    return texts.mapInArrow(run, "key binary, grams binary")


def linked(sets: list[np.ndarray], bands: np.ndarray, left: np.ndarray, right: np.ndarray, classes: list) -> np.ndarray:
    """(a, b) of the pairs across that share a band, are of different classes and similar."""
    mask = np.zeros((len(left), len(right)), bool)
    for k in range(bands.shape[1]):
        mask |= bands[left, k][:, None] == bands[right, k][None]
    if left is right:
        mask &= np.triu(np.ones_like(mask), 1)
    number: dict = {}
    of = np.array([number.setdefault(c, len(number)) for c in classes])
    mask &= of[left][:, None] != of[right][None]
    both = intersections([sets[i] for i in left], [sets[i] for i in right], mask)
    size = np.array([len(s) for s in sets])
    union = size[left][:, None] + size[right][None] - both
    i, j = np.nonzero(mask & (both * DENOMINATOR >= union * NUMERATOR))
    return np.stack([left[i], right[j]], axis=1)


def spanning(edges: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges enough to connect what the edges connect."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in edges.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


_MEMBERS = ("group", "side", "key", "class", "bands", "grams")


def verified(members: DataFrame) -> DataFrame:
    """a, b: links that connect what is similar within groups.  ``members``: _MEMBERS, where
    pairs count across sides 0 and 1, or among side 2; groups stand together."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def done() -> pa.RecordBatch:
            side, keys, classes, bands, grams = zip(*rows, strict=True)
            side = np.array(side)
            left = np.flatnonzero(side != 1)
            right = left if side[0] == 2 else np.flatnonzero(side == 1)
            found = spanning(linked([np.frombuffer(g, np.uint64) for g in grams], np.array(bands), left, right, classes), len(keys)) if len(left) and len(right) else []
            return pa.RecordBatch.from_arrays([pa.array([keys[x[end]] for x in found], pa.binary()) for end in (0, 1)], names=["a", "b"])

        for batch in batches:
            for head, *row in zip(*(batch.column(c).to_pylist() for c in _MEMBERS), strict=True):
                if head != group and rows:
                    yield done()
                    rows = []
                group = head
                rows.append(row)
        if rows:
            yield done()

    return members.mapInArrow(run, "a binary, b binary")


def _together(members: DataFrame) -> DataFrame:
    return members.repartition("group").sortWithinPartitions("group").select(*_MEMBERS)


def _blocks_of(found: DataFrame, sets: DataFrame) -> DataFrame:
    """key, first_id, component, blocks, block, bands of each candidate set.  A component has as many
    blocks as its sets or their bytes ask for; a set's block is that of its key's hash."""
    placed = found.join(sets.select("key", "first_id", "size", "bands"), found["node"] == sets["key"])
    parts = placed.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    out = placed.join(parts, "root").select("key", "first_id", F.col("root").alias("component"), "blocks", "bands")
    return out.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))


def sets_of(docs: DataFrame, wanted: DataFrame, n: int, work: Workspace, label: str) -> DataFrame:
    """key, grams of the wanted sets (key, first_id: saved), and of some others.  One document
    of each set gives its hashes; those without identifier give theirs all."""
    ids = work.save(wanted.where("first_id is not null").select(F.col("first_id").alias("doc_id")).distinct(), label)
    able, _ = sifted(docs, ids, "doc_id")
    texts = able.join(ids.hint("merge"), "doc_id", "left_semi").select("text").unionByName(docs.where("doc_id is null").select("text"))
    return with_sets(texts, n).dropDuplicates(["key"])


def small_links(placed: DataFrame, docs: DataFrame, n: int, work: Workspace) -> DataFrame:
    """a, b: links of the components that are one block."""
    own = placed.where("blocks = 1")
    group = F.struct("component", F.lit(0).alias("low"), F.lit(0).alias("high"))
    members = own.join(sets_of(docs, own, n, work, "small-ids"), "key").select(group.alias("group"), F.lit(2).alias("side"), "key", F.col("key").alias("class"), "bands", "grams")
    return work.save(verified(_together(members)), "small")


def crowd_links(placed: DataFrame, docs: DataFrame, n: int, work: Workspace) -> DataFrame:
    """a, b: links of the larger components."""
    crowd = placed.where("blocks > 1")
    grams = sets_of(docs, crowd, n, work, "crowd-ids")
    crowd = work.save(crowd.join(grams, "key").drop("first_id"), "crowd")
    # Each set against the least of the hubs of its buckets.
    banded = crowd.select("component", "key", "block", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("key").alias("hub"))
    spokes = work.save(banded.join(hubs, "band").groupBy("component", "key", "block").agg(F.min("hub").alias("hub")).where("hub <> key"), "spokes")
    heads = spokes.select("component", "hub", "block", F.col("hub").alias("key")).distinct()
    stars = spokes.withColumn("side", F.lit(1)).unionByName(heads.withColumn("side", F.lit(0)))
    group = F.struct(F.col("hub").alias("component"), F.col("block").alias("low"), F.lit(-1).alias("high"))
    stars = stars.select(group.alias("group"), "side", "key", F.col("key").alias("class")).join(crowd.select("key", "bands", "grams"), "key")
    first = work.save(verified(_together(stars)), "stars")
    classes = components(first, work, "starred")
    classed = crowd.drop("grams").join(classes.select(F.col("node").alias("key"), F.col("root").alias("class")), "key", "left").withColumn("class", F.coalesce("class", "key"))
    classed = work.save(classed, "classed")
    # Buckets in which different classes meet, and the pairs of blocks they are in.
    banded = classed.select("component", "key", "block", "class", F.explode("bands").alias("band"))
    mixed = banded.groupBy("band").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("band")
    open_ = work.save(banded.join(mixed, "band").select("component", "band", "block", "key"), "open")
    met = open_.select("component", "band", "block").distinct()
    pairs = met.alias("p").join(met.alias("q"), ["component", "band"]).where("p.block <= q.block").select("component", F.col("p.block").alias("low"), F.col("q.block").alias("high")).distinct()
    ends = pairs.select("component", "low", "high", F.col("low").alias("block"), F.when(F.col("low") == F.col("high"), 2).otherwise(0).alias("side"))
    ends = ends.unionByName(pairs.where("low < high").select("component", "low", "high", F.col("high").alias("block"), F.lit(1).alias("side")))
    rest = classed.join(open_.select("key").distinct(), "key").join(crowd.select("key", "grams"), "key").join(ends, ["component", "block"])
    rest = rest.select(F.struct("component", "low", "high").alias("group"), "side", "key", "class", "bands", "grams")
    return first.unionByName(work.save(verified(_together(rest)), "rest"))


def near_duplicates(docs: DataFrame, n: int = N, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    work = Workspace(docs.sparkSession, "circulant")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bands, rows = plan_bands(NUMERATOR / DENOMINATOR, RECALL, HASHES)
    signed = work.save(sign(docs, n, bands, rows), "signed")
    sets = work.save(signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("size").alias("size"), F.first("bands").alias("bands")), "sets")

    inside = sets.select("key", F.explode("bands").alias("band"))
    shared = work.save(inside.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band"), "shared")
    # What has its buckets to itself isn't shuffled with its key.
    inside, _ = sifted(inside, shared, "band")
    hubs = inside.groupBy("band").agg(F.min("key").alias("hub"))
    stars = inside.join(hubs, "band").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    placed = work.save(_blocks_of(components(stars, work, "candidates"), sets), "placed")

    found = small_links(placed, docs, n, work)
    if not placed.where("blocks > 1").isEmpty():
        found = found.unionByName(crowd_links(placed, docs, n, work))
    classes = components(found, work, "classes")
    each = sets.select("key", "first_id").join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = each.groupBy("root").agg(F.min("first_id").alias("component_id"))
    each = work.save(each.join(least, "root").select("key", "component_id"), "result")
    out = signed.select("doc_id", "key", F.col("size").alias("n_shingles")).join(each, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


ORACLE = f"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), runs AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i : i + {N - 1}], ' ') AS run
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - {N - 2}))) AS i FROM worded WHERE len(ws) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
    SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
    WHERE common.n * {DENOMINATOR} >= (a.n + b.n - common.n) * {NUMERATOR}
), reached AS (
    SELECT doc_id AS x, doc_id AS y FROM documents
    UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y
), least AS (SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""
