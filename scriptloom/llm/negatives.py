"""Hard negatives for contrastive training, by exact inner products in blocks.

1. Components become ``floor(scale * x)``, 64-bit integers; the rows that take part are saved
   once, in that form.  A row takes part if its identifier, label and vector are not null and
   every component is a finite number.
2. Anchors are the query set.  They are broadcast a block at a time, at most ``BLOCK_BYTES``
   of them however many there are; every task multiplies the block with its own rows, tile
   by tile, in float64.  Sums below 2^53 are exact there; a tile that might pass that is
   multiplied in Python's integers.
3. First pass: each task keeps an anchor's ``positives`` best rows of its own label; a window
   over tasks' rows merges them.  Second pass: with the positives' scores known, each task
   keeps the best rows of other labels within each positive's window of scores; merged alike.

No row of the table is shuffled: tasks send out the best few a block's anchor alone.

``hard_negatives`` returns anchor_id, positive_id, rank, negative_id, positive_score,
negative_score.  Higher scores come first, ties by smaller identifier.  Rows are taken as they
are: a repeated row is another row, so a repeated anchor's results are repeated and a repeated
row fills two places; of the anchor's own row alone it is known that it isn't another.
Vectors of unlike lengths are as if the shorter one went on with zeros; an empty vector scores
0.  Components and scores beyond 64 bits are the least or greatest 64-bit number.  An anchor without positives, or a positive without
negatives, gives no rows, and neither does an empty table.  Only the named columns are read, so
others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, tidy

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative's score times HIGH is between LOW and HIGH times the positive's.
LOW, HIGH = 80, 100
#: Bytes of the anchors that are broadcast at once.
BLOCK_BYTES = 16_000_000
#: Anchors and rows multiplied at once: the product takes 8 MB.
TILE = (512, 2048)
_EXACT = 1 << 53
_MOST = (1 << 63) - 1

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepare(rows: DataFrame, anchor: Column, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """row, vec_id, label, vec (64-bit integers), anchor of the rows that take part."""
    finite = lambda x: F.coalesce(F.abs(x.cast("double") * scale) < F.lit(float("inf")), F.lit(False))
    own = rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return own.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), whole.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor")).withColumn("row", F.monotonically_increasing_id())


class Rows:
    """Rows of a batch as arrays."""

    def __init__(self, batch):
        own = lambda name: np.array(batch.column(name).to_pylist(), object if name == "label" else np.int64)
        self.row, self.vec_id, self.label = own("row"), own("vec_id"), own("label")
        vec = batch.column("vec")
        vec = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
        sizes = vec.value_lengths().to_numpy(zero_copy_only=False) if len(vec) else np.zeros(0, np.int64)
        self.vec = np.zeros((len(vec), int(sizes.max(initial=0))), np.int64)
        self.vec[np.arange(self.vec.shape[1])[None] < sizes[:, None]] = vec.flatten().to_numpy(zero_copy_only=False)

    def __len__(self) -> int:
        return len(self.row)

    def take(self, at) -> Rows:
        out = object.__new__(Rows)
        out.row, out.vec_id, out.label, out.vec = self.row[at], self.vec_id[at], self.label[at], self.vec[at]
        return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in float64 where no sum can pass 2^53, else
    objects within 64 bits."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    largest = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if largest(a) * largest(b) * width < _EXACT:
        return a.astype(np.float64) @ b.astype(np.float64).T
    out = np.zeros((len(a), len(b)), object)
    for k in range(width):
        out += np.multiply.outer(a[:, k].astype(object), b[:, k].astype(object))
    return np.minimum(np.maximum(out, -_MOST), _MOST)


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group, by score and then by identifier."""
    order = np.lexsort((ids, -score, group))
    sorted_ = group[order]
    return order[np.arange(len(order)) - np.searchsorted(sorted_, sorted_) < k]


class Best:
    """The first k (score, identifier) of each of n groups, from any number of tiles."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.group, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        # What a row must be before to be among them: the last of a full group.
        self.least, self.last = np.full(n, -_MOST - 1), np.full(n, _MOST)

    def add(self, groups: np.ndarray, scores: np.ndarray, valid: np.ndarray, ids: np.ndarray) -> None:
        """A tile: a row for each of ``groups``, a column for each of ``ids``."""
        least = self.least[groups][:, None].astype(scores.dtype)
        valid = valid & ((scores > least) | ((scores == least) & (ids[None] < self.last[groups][:, None])))
        if scores.dtype != object and scores.shape[1] > 8 * self.k and np.count_nonzero(valid) > 8 * self.k * len(groups):
            kth = np.partition(np.where(valid, scores, -np.inf), scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            valid &= scores >= kth[:, None]
        i, j = np.nonzero(valid)
        if not len(i):
            return
        group, score, own = (np.concatenate(x) for x in ((self.group, groups[i]), (self.score, scores[i, j].astype(np.int64)), (self.ids, ids[j])))
        keep = first_of_each(group, score, own, self.k)
        self.group, self.score, self.ids = group[keep], score[keep], own[keep]
        full = np.flatnonzero(np.bincount(self.group, minlength=self.n) == self.k)
        ends = np.searchsorted(self.group, full, "right") - 1
        self.least[full], self.last[full] = self.score[ends], self.ids[ends]


def _tiles(batch, anchors: Rows) -> Iterator[tuple[np.ndarray, Rows, np.ndarray]]:
    """Numbers of some anchors, some rows, their products."""
    rows = Rows(batch)
    for lo in range(0, len(rows), TILE[1]):
        own = rows.take(slice(lo, lo + TILE[1]))
        for first in range(0, len(anchors), TILE[0]):
            some = np.arange(first, min(first + TILE[0], len(anchors)))
            yield some, own, products(anchors.vec[some], own.vec)


def best_positives(rows: DataFrame, anchors, k: int) -> DataFrame:
    """Each task's first k rows of an anchor's label.  ``anchors``: a broadcast Rows."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = anchors.value, Best(len(anchors.value), k)
        for batch in batches:
            for some, other, scores in _tiles(batch, own):
                same = own.label[some][:, None] == other.label[None]
                best.add(some, scores, same.astype(bool) & (own.row[some][:, None] != other.row[None]), other.vec_id)
        yield pa.RecordBatch.from_arrays([pa.array(own.row[best.group]), pa.array(best.ids), pa.array(best.score)], names=["anchor", "positive_id", "positive_score"])

    return rows.select("row", "vec_id", "label", "vec").mapInArrow(run, "anchor long, positive_id long, positive_score long")


def best_negatives(rows: DataFrame, anchors, k: int, low: int, high: int) -> DataFrame:
    """Each task's first k rows of other labels within each positive's window.  ``anchors``:
    a broadcast (Rows, number of the anchor for each positive, its place, its score)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of, place, score = anchors.value
        best, top = Best(len(of), k), score
        bottom = np.array([-(-low * int(s) // high) for s in score], np.int64)
        by_place = [np.flatnonzero(place == p) for p in np.unique(place)]
        for batch in batches:
            for some, other, scores in _tiles(batch, own):
                differ = (own.label[some][:, None] != other.label[None]).astype(bool)
                for each in by_place:
                    groups = each[(of[each] >= some[0]) & (of[each] <= some[-1])]
                    if len(groups):
                        at = of[groups] - some[0]
                        found = scores[at]
                        lo, hi = (x[groups][:, None].astype(found.dtype) for x in (bottom, top))
                        best.add(groups, found, differ[at] & (found >= lo) & (found <= hi), other.vec_id)
        yield pa.RecordBatch.from_arrays([pa.array(own.row[of[best.group]]), pa.array(place[best.group].astype(np.int32)), pa.array(best.ids), pa.array(best.score)], names=["anchor", "place", "negative_id", "negative_score"])

    return rows.select("row", "vec_id", "label", "vec").mapInArrow(run, "anchor long, place int, negative_id long, negative_score long")


def merged(rows: DataFrame, keys: list[str], score: str, ids: str, place: str, k: int) -> DataFrame:
    """The first k of each key over all tasks, with their places from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), ids)
    return rows.withColumn(place, F.row_number().over(order)).where(F.col(place) <= k)


def hard_negatives(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """The rows of RESULT for the rows that ``anchor`` is true of, against all rows."""
    spark = rows.sparkSession
    work = Workspace(spark, "negatives")
    known = work.save(prepare(rows, anchor, vec_id, vector, label, scale), "rows")
    queries = known.where("anchor")
    count, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    blocks = -(-count * 8 * (width + 3) // BLOCK_BYTES)
    found = []
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
        own = Rows(block.select("row", "vec_id", "label", "vec").toArrow())
        sent = spark.sparkContext.broadcast(own)
        first = work.save(merged(best_positives(known, sent, positives), ["anchor"], "positive_score", "positive_id", "place", positives), f"positives-{b}")
        sent.destroy()
        pairs = first.select("anchor", "place", "positive_score").toArrow()
        order = np.argsort(own.row)
        of = order[np.searchsorted(own.row, pairs["anchor"].to_numpy(), sorter=order)] if len(own) else np.zeros(0, np.int64)
        sent = spark.sparkContext.broadcast((own, of, pairs["place"].to_numpy(), pairs["positive_score"].to_numpy()))
        last = merged(best_negatives(known, sent, negatives, low, high), ["anchor", "place"], "negative_score", "negative_id", "rank", negatives)
        names = block.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        found.append(work.save(last.join(first, ["anchor", "place"]).join(names, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), f"negatives-{b}"))
        sent.destroy()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], RESULT)


ORACLE = f"""
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           coalesce(list_sum(list_transform(range(1, least(len(a.vec), len(b.vec)) + 1), lambda i: a.vec[i] * b.vec[i])), 0)::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= {HIGH} * score AND score <= positive_score
QUALIFY rank <= {NEGATIVES}
"""
