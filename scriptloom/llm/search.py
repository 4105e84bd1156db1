"""Ranked lexical search: a document-at-a-time merge over compressed postings.

A term is a run of letters and digits of ASCII and of all other characters; only A-Z are
lower-cased.  ``score`` of a document for a query is the sum over the query's terms, once each,
of ``weight * ((10^9 * tf) div (1000 * tf + 20 * m))`` with ``m = 50 + ((50 * n * N) div L)``
and ``weight = floor(1000 * ln((2 N + 2) / (2 df + 1)))``, in 64-bit integers.

1. ``index_documents``: each task turns its texts into segments of ``SEGMENT`` characters.  A
   segment is a row: identifiers in ascending order, lengths in terms, its terms, and for each
   term the gaps between its documents' places and its frequencies as variable-length bytes.
   No text is shuffled.
2. Queries are taken in blocks of ``QUERY_TERMS`` terms, so what is broadcast is bounded.  How
   many documents hold a block's terms is summed over segments.
3. ``search_index``: a heap of one cursor a term merges a segment's postings by document; a
   document's terms come out together, its scores are made for all queries that share them,
   and each query's heap keeps the best ``k`` by score and then identifier.  A task's heaps
   serve all its segments; a window over tasks' rows is the global merge.

Null and texts without terms are documents of no count and no rank.  Repeated rows are documents
of their own, and so are repeated queries.  Documents without identifier come after the
others of their score.  Very long texts are cut into terms a part at a time; a longer text than
``SEGMENT`` is a segment alone.  No documents or no queries: no rows.  A query without terms
has none either.  Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, tidy

TOP = 50
#: Characters of the texts in a segment.
SEGMENT = 4_000_000
#: Terms, with repeats over queries, of the queries that are searched at once.
QUERY_TERMS = 200_000
#: Characters cut into terms at once.
SPAN = 1 << 20
#: Scores made at once.
SCORED = 2_000_000

INDEX = "ids array<long>, lengths array<long>, terms array<string>, found array<long>, ends array<long>, postings binary"
# Separators become spaces, A-Z a-z; bytes over 127 belong to terms.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, a part at a time."""
    own = (text or "").encode("utf-8", "replace").translate(_TABLE)
    at = 0
    while at < len(own):
        stop = own.find(b" ", at + SPAN) if at + SPAN < len(own) else -1
        stop = len(own) if stop < 0 else stop
        yield own[at:stop].split()
        at = stop


def packed(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Seven bits a byte, the highest bit where more follow; and the bytes each value takes."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        sizes += values >= np.uint64(1 << bits)
    out, first = np.zeros(int(sizes.sum()), np.uint8), np.cumsum(sizes) - sizes
    for k in range(int(sizes.max(initial=0))):
        own = np.flatnonzero(sizes > k)
        out[first[own] + k] = ((values[own] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(sizes[own] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes(), sizes


def unpacked(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(data < 128)[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), first)


def segment(ids: list[int | None], texts: list[str | None]) -> list:
    """The values of an INDEX row."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    codes: defaultdict[bytes, int] = defaultdict(count().__next__)
    term, doc, times, lengths = [], [], [], []
    for place, i in enumerate(order):
        parts = [np.fromiter(map(codes.__getitem__, part), np.int64, len(part)) for part in terms_of(texts[i])]
        own, n = np.unique(np.concatenate(parts or [np.zeros(0, np.int64)]), return_counts=True)
        term.append(own)
        doc.append(np.full(len(own), place))
        times.append(n)
        lengths.append(int(n.sum()))
    term, doc, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (term, doc, times))
    by = np.argsort(term, kind="stable")
    term, doc, times = term[by], doc[by], times[by]
    gaps = doc.copy()
    same = np.flatnonzero(term[1:] == term[:-1]) + 1
    gaps[same] -= doc[same - 1]
    data, sizes = packed(np.stack([gaps, times], axis=1).ravel())
    found = np.bincount(term, minlength=len(codes))
    ends = np.cumsum(sizes)[2 * np.cumsum(found) - 1] if len(term) else np.zeros(0, np.int64)
    return [[ids[i] for i in order], lengths, list(codes), found, ends, data]


def index_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Segments of the documents, as rows of INDEX."""
    names = [x.split()[0] for x in INDEX.split(", ")]
    types = [pa.list_(pa.int64())] * 2 + [pa.list_(pa.string())] + [pa.list_(pa.int64())] * 2 + [pa.binary()]

    def row(ids: list, texts: list) -> pa.RecordBatch:
        made = segment(ids, texts)
        made[2] = [t.decode("utf-8", "replace") for t in made[2]]
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(made, types, strict=True)], names=names)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = x.as_py() or ""
                if ids and size + len(own) > SEGMENT:
                    yield row(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(own)
                size += len(own)
        if ids:
            yield row(ids, texts)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, INDEX)


class Queries:
    """A block of queries: names, and which of them has a term."""

    def __init__(self, names: list[int | None], texts: list[str | None]):
        self.names = names
        of: dict[bytes, list[int]] = {}
        for q, text in enumerate(texts):
            for t in dict.fromkeys(t for part in terms_of(text) for t in part):
                of.setdefault(t, []).append(q)
        self.terms = [t.decode("utf-8", "replace") for t in of]
        self.first = np.cumsum([0, *map(len, of.values())])
        self.queries = np.array([q for own in of.values() for q in own], np.int64)
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, docs: int, held: dict[int, int]) -> None:
        """From the number of documents, and how many of them hold a term by its place."""
        for t, n in held.items():
            self.weights[t] = math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1)))


def blocks(queries: DataFrame, name: str, text: str) -> Iterator[Queries]:
    """The queries, so many at a time that a block has few terms; the driver holds one."""
    names, texts, size = [], [], 0
    for r in queries.select(F.col(name).cast("long").alias("q"), F.col(text).alias("t")).toLocalIterator():
        own = len((r.t or "").split())
        if names and size + own > QUERY_TERMS:
            yield Queries(names, texts)
            names, texts, size = [], [], 0
        names.append(r.q)
        texts.append(r.t)
        size += own
    if names:
        yield Queries(names, texts)


def held(index: DataFrame, queries) -> DataFrame:
    """term (its place in the block), held: how many documents have it."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(queries.value.terms, pa.string())
        out = np.zeros(len(wanted), np.int64)
        for batch in batches:
            at = pc.index_in(batch.column("terms").flatten(), value_set=wanted)
            known = pc.is_valid(at)
            np.add.at(out, at.filter(known).to_numpy(), batch.column("found").flatten().filter(known).to_numpy())
        own = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(out[own])], names=["term", "held"])

    return index.select("terms", "found").mapInArrow(run, "term long, held long").groupBy("term").agg(F.sum("held").alias("held"))


def merge(postings: list[list[int]], terms: int) -> list[int]:
    """Cursors' values ``place * terms + term`` in ascending order: all terms of a document
    come out together.  The heap has the next value of each cursor."""
    cursors = [iter(p) for p in postings]
    heap = [next(c) for c in cursors]
    of = {head % terms: c for head, c in zip(heap, cursors, strict=True)}
    heapq.heapify(heap)
    out = []
    while heap:
        head = heap[0]
        out.append(head)
        after = next(of[head % terms], None)
        if after is None:
            heapq.heappop(heap)
        else:
            heapq.heapreplace(heap, after)
    return out


def lengths_m(lengths: np.ndarray, docs: int, total: int) -> np.ndarray:
    if 50 * int(lengths.max(initial=0)) * docs < 1 << 63:
        return 50 + 50 * lengths * docs // max(total, 1)
    return np.array([50 + 50 * int(n) * docs // max(total, 1) for n in lengths], np.int64)


class Heaps:
    """The best k of each query, by score and then by identifier."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]
        self.least = np.zeros(n)

    def offer(self, query: int, score: int, doc: int | None) -> None:
        # Of equal scores the largest identifier goes first, before it those without one.
        entry, heap = (score, doc is not None, -(doc or 0)), self.heaps[query]
        if len(heap) < self.k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.least[query] = heap[0][0]


def search_segment(row: dict, queries: Queries, docs: int, total: int, heaps: Heaps) -> None:
    """Offers a segment's documents to the heaps."""
    at = pc.index_in(row["terms"], value_set=pa.array(queries.terms, pa.string())).to_numpy(zero_copy_only=False)
    own = np.flatnonzero(~np.isnan(at))
    if not len(own):
        return
    terms, ends, found = at[own].astype(np.int64), row["ends"], row["found"][own]
    starts = np.concatenate([[0], ends[:-1]])
    data = np.frombuffer(row["postings"], np.uint8)
    values = unpacked(np.concatenate([data[starts[t] : ends[t]] for t in own])).reshape(-1, 2)
    # Gaps to places: sums that start anew with each term.
    sums, first = np.cumsum(values[:, 0]), np.cumsum(found) - found
    places = sums - np.repeat(sums[first] - values[first, 0], found)
    size, term = len(queries.terms), np.repeat(terms, found)
    keys = places * size + term
    order = np.array(merge([k.tolist() for k in np.split(keys, np.cumsum(found)[:-1])], size), np.int64)
    # Frequencies and scores in the order of the merge.
    back = np.argsort(keys, kind="stable")
    times, (place, term) = values[back, 1], np.divmod(order, size)
    m = lengths_m(row["lengths"], docs, total)[place]
    score = queries.weights[term] * (1_000_000_000 * times // (1000 * times + 20 * m))
    uses = queries.first[term + 1] - queries.first[term]
    heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    work = np.add.reduceat(uses, heads)
    lo, n = 0, len(queries.names)
    while lo < len(heads):
        # Documents whose terms' queries are few enough to be scored at once, one at least.
        hi = min(max(lo + 1, int(np.searchsorted(np.cumsum(work[lo:]), SCORED, "right")) + lo), lo + max(1, SCORED // n))
        a, b = heads[lo], heads[hi] if hi < len(heads) else len(place)
        each = np.repeat(np.arange(a, b), uses[a:b])
        inside = np.arange(len(each)) - np.repeat(np.cumsum(uses[a:b]) - uses[a:b], uses[a:b])
        which = np.repeat(np.searchsorted(heads[lo:hi], np.arange(a, b), "right") - 1, uses[a:b])
        query = queries.queries[queries.first[term[each]] + inside]
        sums = np.bincount(which * n + query, score[each], (hi - lo) * n).reshape(hi - lo, n)
        for d, q in zip(*(x.tolist() for x in np.nonzero((sums > 0) & (sums >= heaps.least[None]))), strict=True):
            heaps.offer(q, int(sums[d, q]), row["ids"][place[heads[lo + d]]])
        lo = hi


def search_index(index: DataFrame, queries, docs: int, total: int, k: int) -> DataFrame:
    """query (its place in the block), item_id, doc_id, score: each task's best k.  Scores are
    sums of integers in float64, exact as they stay below 2^53."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = queries.value
        heaps = Heaps(len(own.names), k)
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda c, i=i: batch.column(c)[i]
                row = {c: cell(c).values.to_numpy() for c in ("lengths", "found", "ends")}
                search_segment(row | {"ids": cell("ids").as_py(), "terms": cell("terms").values, "postings": cell("postings").as_buffer()}, own, docs, total, heaps)
        rows = [(q, own.names[q], -e[2] if e[1] else None, e[0]) for q, heap in enumerate(heaps.heaps) for e in heap]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "query long, item_id long, doc_id long, score long")


RESULT = "item_id long, rank int, doc_id long, score long"


def rank_documents(docs: DataFrame, queries: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", query: str = "text") -> DataFrame:
    """RESULT: the k best documents of each query, those with a score above 0."""
    spark = docs.sparkSession
    work = Workspace(spark, "search")
    index = work.save(index_documents(docs, doc_id, text), "index")
    seen = index.select(F.explode("lengths").alias("n")).where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = []
    for b, block in enumerate(blocks(queries, item_id, query)):
        sent = spark.sparkContext.broadcast(block)
        block.weigh(seen[0], {r.term: r.held for r in held(index, sent).toLocalIterator()})
        sent.destroy()
        sent = spark.sparkContext.broadcast(block)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = search_index(index, sent, *seen, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.append(work.save(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), f"found-{b}"))
        sent.destroy()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], RESULT)


ORACLE = f"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM documents
), postings AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM postings GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
weights AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM postings, totals GROUP BY term, n_docs
), wanted AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
    FROM benchmark
), scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
    GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= {TOP}
"""
