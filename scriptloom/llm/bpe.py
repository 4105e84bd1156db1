"""Byte-level BPE by recursive DuckDB queries, one database for each Python worker.

Texts are split by the tokenizer's pattern; distinct words that are no token by themselves
become lists of tokens, first one for each byte.  A recursive query then joins each word's pairs
of neighbours with the merge table, takes each word's pair of least rank (of equal ranks the
leftmost), contracts it, and goes on with the words that had one; the other words' lists are
final.  That is the order in which the tiktoken library merges, so the ids
are the same.  A second query decodes documents from their final ids: token bytes,
aggregated in order of position.

The merge table has every way to cut a token into two tokens, as a pair's rank is that of
its joined bytes.  Words are handled in blocks of ``BLOCK_BYTES`` and remembered up to a
limit, so memory is bounded.

Words over ``LONG`` bytes would need a round for each token.  They are first cut where no
token of the vocabulary crosses, so no merge does; what stays long is contracted by
``LONG_SQL``: in each round all of a word's pairs of the least rank that don't overlap, up
to the first that makes a cheaper pair with its neighbours.  That is what the leftmost pairs
would come to one by one, so the ids are the same; rounds are as many as different ranks are
met, and the table that grows is keyed by place, so it holds each place once.

Narrow: no shuffle.  Null texts count as empty: no ids, nothing decoded.  Repeated rows are
encoded alike; an empty table gives no rows.  Other columns pass through; columns named like
the results are replaced.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, resident, unused
from .pieces import PieceCache, cut_texts
from .unigram import load_ranks

#: Bytes of words that one query contracts together; a longer word is a block by itself.
BLOCK_BYTES = 200_000
#: Bytes of a word from which it is cut and contracted as a long one.
LONG = 64
#: Characters of texts that are encoded together: a query costs the same for few new words as for
#: thousands.
TOGETHER = 1_000_000
#: Ids that are decoded together.
DECODED = 100_000
#: Pieces remembered in a Python worker, at some 180 bytes each.
CACHED = 600_000

ENCODE_SQL = """
WITH RECURSIVE step AS (
    SELECT word, list(id ORDER BY pos) AS ids, TRUE AS live FROM bytes_in GROUP BY word
  UNION ALL (
    WITH pairs AS (
        SELECT word, unnest(ids[:-2]) AS left_id, unnest(ids[2:]) AS right_id, generate_subscripts(ids[2:], 1) AS pos FROM step WHERE live
    ), best AS (
        SELECT word, min(rank::BIGINT * 4294967296 + pos) AS place FROM pairs JOIN merges USING (left_id, right_id) GROUP BY word
    )
    SELECT s.word, CASE WHEN b.word IS NULL THEN s.ids ELSE list_concat(list_append(s.ids[:(place & 4294967295) - 1], (place >> 32)::INTEGER), s.ids[(place & 4294967295) + 2:]) END AS ids, b.word IS NOT NULL AS live
    FROM step s LEFT JOIN best b ON b.word = s.word WHERE s.live
  )
)
SELECT word, ids FROM step WHERE NOT live
"""

LONG_SQL = """
WITH RECURSIVE step(word, pos, id, live) USING KEY (word, pos) AS (
    SELECT word, pos, id, TRUE AS live FROM bytes_in
  UNION ALL (
    WITH pairs AS (
        SELECT word, pos, id, lag(id) OVER w AS before, lead(pos) OVER w AS next_pos, lead(id) OVER w AS next_id, lead(id, 2) OVER w AS after
        FROM step WHERE live AND id >= 0 WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), ranked AS (
        SELECT p.*, rank, min(rank) OVER (PARTITION BY word) AS least
        FROM pairs p JOIN merges ON left_id = id AND right_id = next_id
    ), runs AS (
        SELECT *, sum(fresh) OVER (PARTITION BY word ORDER BY pos) AS run
        FROM (SELECT *, CASE WHEN lag(next_pos) OVER (PARTITION BY word ORDER BY pos) = pos THEN 0 ELSE 1 END AS fresh FROM ranked WHERE rank = least)
    ), apart AS (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word, run ORDER BY pos) AS k FROM runs) WHERE k % 2 = 1
    ), cheaper AS (
        SELECT a.word, min(a.pos) AS pos FROM apart a
        LEFT JOIN merges x ON x.left_id = a.before AND x.right_id = a.rank
        LEFT JOIN merges y ON y.left_id = a.rank AND y.right_id = a.after
        LEFT JOIN merges b ON b.left_id = a.rank AND b.right_id = a.rank
        WHERE least(x.rank, y.rank, b.rank) < a.rank GROUP BY a.word
    ), chosen AS (
        SELECT a.word, a.pos, a.next_pos, a.rank FROM apart a LEFT JOIN cheaper c ON c.word = a.word WHERE c.pos IS NULL OR a.pos <= c.pos
    )
    SELECT p.word, p.pos, CASE WHEN g.word IS NOT NULL THEN -1 WHEN a.word IS NOT NULL THEN a.rank ELSE p.id END AS id, b.word IS NOT NULL AS live
    FROM pairs p
    LEFT JOIN chosen a ON a.word = p.word AND a.pos = p.pos
    LEFT JOIN chosen g ON g.word = p.word AND g.next_pos = p.pos
    LEFT JOIN (SELECT DISTINCT word FROM chosen) b ON b.word = p.word
  )
)
SELECT word, list(id ORDER BY pos) AS ids FROM step WHERE id >= 0 GROUP BY word
"""

DECODE_SQL = """
SELECT doc, list(v.text ORDER BY pos) AS parts FROM tokens_in t JOIN vocabulary v ON v.id = t.id GROUP BY doc
"""


class Coder:
    """Ids (little-endian, 32-bit) and decoded bytes of texts."""

    def __init__(self, ranks: str, pattern: str, cached: int = CACHED, memory: str = "100MB"):
        import duckdb

        self.find = regex.compile(pattern).findall
        self.ranks = load_ranks(ranks)
        self.base = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        #: Ids are kept in two bytes where the vocabulary allows it.
        self.kind = "<u2" if max(self.ranks.values()) < 1 << 16 else "<u4"
        self.starts: set[bytes] = set()
        cuts = [(self.ranks.get(t[:i]), self.ranks.get(t[i:]), r) for t, r in self.ranks.items() for i in range(1, len(t))]
        left, right, rank = zip(*(c for c in cuts if None not in c), strict=True)
        # What a query can't hold it writes into this process's own temporary folder, as Spark's sorts do.
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": f"{tempfile.gettempdir()}/scriptloom-{os.getpid()}"})
        for name, data in (
            ("merges", {"left_id": pa.array(left, pa.int32()), "right_id": pa.array(right, pa.int32()), "rank": pa.array(rank, pa.int32())}),
            # A character for each byte, so that the bytes of a token can be text.
            ("vocabulary", {"id": pa.array(self.ranks.values(), pa.int32()), "text": [t.decode("latin-1") for t in self.ranks]}),
        ):
            self.db.register("given", pa.table(data))
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.cache = PieceCache(self.pieces, cached)

    def cut(self, word: bytes) -> list[bytes]:
        """A long word in parts that no token of the vocabulary reaches across."""
        if not self.starts:
            self.starts = {t[:i] for t in self.ranks for i in range(1, len(t) + 1)}
        starts, ranks, out, at, reach = self.starts, self.ranks, [], 0, 1
        for i in range(len(word)):
            if i >= reach:
                out.append(word[at:i])
                at, reach = i, i + 1
            stop = i + 2
            while stop <= len(word) and word[i:stop] in starts:
                if stop > reach and word[i:stop] in ranks:
                    reach = stop
                stop += 1
        return [*out, word[at:]]

    def words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each distinct word."""
        out, rest, parts, width = {}, [], {}, np.dtype(self.kind).itemsize
        for w in words:
            b = w.encode()
            # What is a token is not merged from its bytes; as in tiktoken.
            if (r := self.ranks.get(b)) is not None:
                out[w] = r.to_bytes(width, "little")
            elif len(b) > LONG:
                parts[w] = self.cut(b)
            else:
                rest.append((w, b))
        out.update(self.contracted(rest, ENCODE_SQL))
        if parts:
            own = dict.fromkeys(p for ps in parts.values() for p in ps)
            known = {p: self.ranks[p].to_bytes(width, "little") for p in own if p in self.ranks}
            known |= self.contracted([(p, p) for p in own if p not in known and len(p) <= LONG], ENCODE_SQL)
            known |= self.contracted([(p, p) for p in own if p not in known], LONG_SQL)
            out.update((w, b"".join(map(known.__getitem__, ps))) for w, ps in parts.items())
        return out

    def contracted(self, rest: list[tuple], sql: str) -> dict:
        """The ids of (name, bytes) by name."""
        out, width, lo = {}, np.dtype(self.kind).itemsize, 0
        while lo < len(rest):
            hi, size = lo, 0
            while hi < len(rest) and (hi == lo or size + len(rest[hi][1]) <= BLOCK_BYTES):
                size += len(rest[hi][1])
                hi += 1
            own, lo = rest[lo:hi], hi
            sizes = np.array([len(b) for _, b in own])
            flat = np.frombuffer(b"".join(b for _, b in own), np.uint8)
            word = np.repeat(np.arange(len(own), dtype=np.int32), sizes)
            pos = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            self.db.register("bytes_in", pa.table({"word": word, "pos": pos, "id": self.base[flat]}))
            got = self.db.sql(sql).to_arrow_table().combine_chunks()
            self.db.unregister("bytes_in")
            ids = got.column("ids").combine_chunks()
            data = np.asarray(ids.flatten()).astype(self.kind).tobytes()
            ends = (np.cumsum(np.asarray(ids.value_lengths())) * width).tolist()
            out.update((own[k][0], data[a:b]) for k, a, b in zip(got.column("word").to_pylist(), [0, *ends], ends, strict=False))
        return out

    def decoded(self, ids: list[np.ndarray]) -> list[bytes]:
        """What lists of ids stand for."""
        sizes, out = np.array([len(x) for x in ids]), [b""] * len(ids)
        if not sizes.sum():
            return out
        flat = np.concatenate(ids).astype(np.int32)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        self.db.register("tokens_in", pa.table({"doc": doc, "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
        got = self.db.sql(DECODE_SQL).to_arrow_table()
        self.db.unregister("tokens_in")
        for k, text in zip(got.column("doc").to_pylist(), pc.binary_join(got.column("parts"), "").to_pylist(), strict=True):
            out[k] = text.encode("latin-1")
        return out

    def pieces(self, pieces: list[str]) -> list[bytes]:
        cut = [self.find(p) for p in pieces]
        # Most words have been met already, with other signs around them.
        get = self.cache.known.get
        known = {w: get(w) for w in set().union(*cut)}
        known.update(self.words([w for w, ids in known.items() if ids is None]))
        return [known[c[0]] if len(c) == 1 else b"".join([known[w] for w in c]) for c in cut]

    def __call__(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        cut = cut_texts(texts)
        get = self.cache.fill([cut.pieces])
        ids = cut.joined(list(map(get, cut.pieces)), self.kind)
        for k, slow in enumerate(cut.slow):
            if slow:
                words = self.find(texts[k])
                get = self.cache.fill([words])
                ids[k] = np.frombuffer(b"".join(map(get, words)), self.kind)
        lo = size = 0
        for k, own in enumerate(ids):
            size += len(own)
            if size > DECODED or k == len(ids) - 1:
                for part, back in zip(ids[lo : k + 1], self.decoded(ids[lo : k + 1]), strict=True):
                    yield part.astype("<u4").tobytes(), back
                lo, size = k + 1, 0


def coder(ranks: str, pattern: str, cached: int = CACHED) -> Coder:
    return resident(("bpe", ranks, pattern, cached), lambda: Coder(ranks, pattern, cached))


def encode_decode(df: DataFrame, ranks: str, pattern: str, text: str = "text", keep: list[str] | None = None, cached: int = CACHED) -> DataFrame:
    """Adds ``ids`` (binary, little-endian 32-bit) and ``decoded`` (binary) to the columns in
    ``keep`` (None: all).  ``cached``: pieces that a Python worker remembers; it trades
    memory for time and changes no result."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("ids", "decoded")]
    (own_text,) = unused(keep, "__text")
    df = df.select(*keep, F.col(text).alias(own_text))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks, pattern, cached)
        for batch in batches:
            for own, texts in chunks(batch, own_text, TOGETHER):
                ids, decoded = zip(*code(texts), strict=True)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=[*keep, "ids", "decoded"])

    return df.mapInArrow(run, schema)


def digest_ids(df: DataFrame) -> DataFrame:
    """Number and digest of the ids, digest of the decoded bytes."""
    size = F.octet_length("ids")
    return df.withColumns({"n_tokens": (size / 4).cast("long"), "ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}).drop("ids", "decoded")
