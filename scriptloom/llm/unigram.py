"""Token counts under a unigram model, by dynamic programming over a shared trie.

Distinct pre-tokens go into a trie of bytes.  A node's forward state, the least cost of any
segmentation of its prefix and the number of its tokens, depends on the prefix alone, so it
is computed once however many pre-tokens share it; the state of a pre-token's last node is
its count.  Costs are whole micronats, so sums are exact.  Of equal costs the one with fewer
tokens counts, of these the one whose last token is longer.

The vocabulary is a public tokenizer's; the model's probabilities are estimated from the
corpus by one round of Viterbi training: pre-tokens are counted in each task, the counts of
each distinct one meet (one shuffle, by pre-token), it is segmented once for the whole corpus
under Zipf's law over the ranks, and a token's probability is its share of all tokens, with one
added to each count.

The second pass is narrow.  Counts, trie and caches have a size limit; they leave the task or
start anew beyond it, which changes no result.  Null texts count as empty: no pre-tokens, no
tokens, cost 0; very long texts are counted whole.  Repeated rows each count; an empty table
gives no rows.  Other columns pass through; those named like the results are replaced.
"""

from __future__ import annotations

import base64
import math
import struct
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, resident, tidy
from .pieces import PieceCache, cut_texts


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def zipf_costs(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Cost in micronats of each token."""
    mass = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {t: round(1e6 * (math.log(r + 1) + mass)) for t, r in ranks.items()}


#: Distinct pieces that a task counts before their pre-tokens leave it, and rows of a batch.
COUNTED, ROWS = 300_000, 50_000


def pretoken_counts(df: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """word, n: each distinct pre-token of all texts, and how often it occurs."""

    def left(pieces: dict[str, int], find: Callable[[str], list[str]]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = defaultdict(int)
        for p, n in pieces.items():
            for w in find(p):
                found[w] += n
        rows = iter(found.items())
        while part := list(islice(rows, ROWS)):
            own, n = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])
        pieces.clear()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, pieces = regex.compile(pattern).findall, defaultdict(int)
        for batch in batches:
            for _, texts in chunks(batch, text, 4_000_000):
                cut = cut_texts(texts)
                for p, n in zip(cut.pieces, np.bincount(cut.index, minlength=len(cut.pieces)).tolist(), strict=True):
                    pieces[p] += n
                for own, slow in zip(texts, cut.slow, strict=True):
                    if slow:
                        # Matches depend on what is around them here: these are pre-tokens already.
                        yield from left(Counter(find(own)), lambda w: [w])
                if len(pieces) > COUNTED:
                    yield from left(pieces, find)
        yield from left(pieces, find)

    return df.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def estimated_costs(df: DataFrame, ranks: str, pattern: str, text: str = "text") -> np.ndarray:
    """Cost in micronats of each token, in order of rank, as the texts have them."""
    vocabulary = load_ranks(ranks)
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, trie = resident(("segments", ranks), lambda: _segmenter(ranks))
        total = np.zeros(size, np.int64)
        for batch in batches:
            # Sorted, so that neighbours share prefixes even if the trie starts anew in between.
            rows = sorted(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True))
            ids, times = [], []
            for word, n in rows:
                own = [place[t] for t in trie.tokens(word.encode())]
                ids += own
                times += [n] * len(own)
            np.add.at(total, np.array(ids, np.int64), np.array(times, np.int64))
        (at,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["token", "n"])

    counted = pretoken_counts(df, pattern, text).mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))
    n = np.zeros(size, np.int64)
    for r in counted.collect():  # at most one row a token of the vocabulary
        n[r.token] = r.n
    return np.round(1e6 * (np.log(n.sum() + len(n)) - np.log(n + 1.0))).astype(np.int64)


class ForwardTrie:
    """Forward states of all prefixes seen so far: cost, tokens, where the last one starts, and the
    first place from which a token may still reach on.  What begins before it is no beginning of a
    token, nor is anything longer, so later bytes needn't look there."""

    def __init__(self, costs: dict[bytes, int], limit: int = 200_000):
        self.costs, self.limit = costs, limit
        self.begun = {t[:i] for t in costs for i in range(1, len(t) + 1)}
        self.clear()

    def clear(self) -> None:
        #: From (node << 8 | byte) to node; states by node.
        self.edges: dict[int, int] = {}
        self.states: list[tuple[int, int, int, int]] = [(0, 0, 0, 0)]

    def path(self, word: bytes) -> list[tuple[int, int, int, int]]:
        """The states of a pre-token's prefixes."""
        if len(self.states) > self.limit:
            self.clear()
        edges, states, cost_of, begun = self.edges, self.states, self.costs.get, self.begun
        node, path = 0, [states[0]]
        for end, byte in enumerate(word, 1):
            edge = node << 8 | byte
            known = edges.get(edge)
            if known is None:
                # The single byte is a token, so there is a state before any other comes.
                last = end - 1
                least, tokens, _, first = path[last]
                least, tokens, at = least + cost_of(word[last:end]), tokens + 1, last
                while first < last and word[first:end] not in begun:
                    first += 1
                for start in range(first, last):
                    cost = cost_of(word[start:end])
                    if cost is not None:
                        before = path[start]
                        cost += before[0]
                        if cost < least or cost == least and (before[1] + 1, start) < (tokens, at):
                            least, tokens, at = cost, before[1] + 1, start
                known = edges[edge] = len(states)
                states.append((least, tokens, at, first))
            node = known
            path.append(states[node])
        return path

    def count(self, word: bytes) -> tuple[int, int]:
        """(tokens, cost) of a pre-token's best segmentation."""
        cost, tokens, _, _ = self.path(word)[-1]
        return tokens, cost

    def tokens(self, word: bytes) -> list[bytes]:
        """A pre-token's best segmentation, last token first."""
        path, end, out = self.path(word), len(word), []
        while end:
            start = path[end][2]
            out.append(word[start:end])
            end = start
        return out


def _segmenter(ranks: str) -> tuple[dict[bytes, int], ForwardTrie]:
    """Places of tokens in order of rank, and a trie under Zipf's law."""
    vocabulary = load_ranks(ranks)
    return {t: i for i, t in enumerate(sorted(vocabulary, key=vocabulary.get))}, ForwardTrie(zipf_costs(vocabulary))


#: Pre-tokens, tokens and cost of a piece.
ROW = struct.Struct("=3q")


class _Counter:
    """Pre-tokens, tokens and cost of texts."""

    def __init__(self, ranks: str, pattern: str, costs: np.ndarray):
        self.find = regex.compile(pattern).findall
        vocabulary = load_ranks(ranks)
        self.trie = ForwardTrie(dict(zip(sorted(vocabulary, key=vocabulary.get), costs.tolist(), strict=True)))
        self.cache = PieceCache(self.pieces, 1_000_000)

    def words(self, words: Iterable[str]) -> np.ndarray:
        """A row for each of these distinct words, in order."""
        # Most have been met already, as pieces; sorted, as neighbours share prefixes.
        get, count, rows = self.cache.known.get, self.trie.count, []
        for w in sorted(words):
            rows.append(get(w) or ROW.pack(1, *count(w.encode())))
        return np.frombuffer(b"".join(rows), np.int64).reshape(-1, 3)

    def pieces(self, pieces: list[str]) -> list[bytes]:
        cut = [self.find(p) for p in pieces]
        own = set().union(*cut)
        place = {w: i for i, w in enumerate(sorted(own))}
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        index = np.fromiter((place[w] for c in cut for w in c), np.int64, ends[-1])
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(self.words(own)[index], axis=0)])
        # Three 64-bit integers a piece: smaller than a tuple, and joined without a look at each.
        rows = (sums[ends] - sums[np.concatenate([[0], ends[:-1]])]).tobytes()
        return [rows[i : i + 24] for i in range(0, len(rows), 24)]

    def __call__(self, texts: list[str]) -> np.ndarray:
        """A row for each text."""
        cut = cut_texts(texts)
        values = np.frombuffer(b"".join(map(self.cache.fill([cut.pieces]), cut.pieces)), np.int64).reshape(-1, 3)
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(values[cut.index], axis=0)])
        out = sums[cut.offsets[1:]] - sums[cut.offsets[:-1]]
        for k, slow in enumerate(cut.slow):
            if slow:
                times = Counter(self.find(texts[k]))
                out[k] = self.words(times).T @ np.array([times[w] for w in sorted(times)], np.int64)
        return out


def token_counts(df: DataFrame, ranks: str, pattern: str, text: str = "text", costs: np.ndarray | None = None) -> DataFrame:
    """Adds ``n_pretokens``, ``n_tokens`` and ``cost_micronats`` to each row, from the rank
    file's vocabulary and the split pattern.  ``costs``: in order of rank; estimated from
    these texts, in a pass before this one, if not given."""
    added = ["n_pretokens", "n_tokens", "cost_micronats"]
    df = df.drop(*(c for c in added if c in df.columns))
    schema = T.StructType(df.schema.fields + [T.StructField(n, T.LongType()) for n in added])
    costs = estimated_costs(df, ranks, pattern, text) if costs is None else costs
    key = ("unigram", ranks, pattern, hash(costs.tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = resident(key, lambda: _Counter(ranks, pattern, costs))
        for batch in batches:
            for own, texts in chunks(batch, text, 4_000_000):
                rows = count(texts)
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(rows[:, k]) for k in range(3))], names=[*own.schema.names, *added])

    return df.mapInArrow(run, schema)
