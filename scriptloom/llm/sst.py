"""Token ids in sorted-string-table shards, and their lookup.

A shard holds the documents of one range of identifiers:

    block*  index  bloom  footer
    block   zlib of entries; entry = shared, unshared, value length (varints), key suffix, value
    index   for each block: last key, offset, stored length, entries, ids before it
    bloom   bit array over the keys, K bits each
    footer  offsets and lengths of index and Bloom filter, counts, crc32 of index, magic

Keys are eight bytes, big-endian with the sign bit flipped, so that they sort as the
identifiers do; a null identifier has the empty key and sorts first.  Each block starts with
a whole key, so a lookup needs the footer, the index and one block.  Values are ids as
little-endian integers, two bytes each while the vocabulary allows it, else four.

Documents are dealt out by range of identifier and digest of the text, so tasks are sorted,
the whole is in order, and identifiers that very many rows share, or that are null, are
spread.  A task starts a new shard after ``SHARD_BYTES``; it writes under names of its own
and returns them, and only names that Spark's committed output lists are ever read, so
repeated and lost tasks do no harm.  Equal identifiers keep all their rows, next to each
other, ordered by the digest.  An empty table gives no rows.  Null texts count as empty; a
very long text is one entry, and one block.  Columns but identifier and text are not read,
so their names can't clash.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, chunks, resident
from .pieces import PieceCache, cut_texts

MAGIC = b"SLSST001"
BLOCK_BYTES = 64 * 1024
#: Bytes after which a shard is closed; one more block may follow.
SHARD_BYTES = 64 * 1024 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QIQIQQBI8s")
END_ID = 0

_ENDS = (",", ".", "\n")


def _core(piece: str) -> tuple[str, str, str]:
    """A piece's line feed, the rest, and the mark at its end."""
    line = "\n" if piece[:1] == "\n" and len(piece) > 1 else ""
    mark = piece[-1] if piece[-1:] in (",", ".") and piece[-2:-1].isalpha() else ""
    return line, piece[len(line) : len(piece) - len(mark)], mark


class _Encoder:
    """Ids of texts as little-endian 32-bit integers, through the tokenizers library.

    Pieces of letters go to the library's BPE model directly.  Others are encoded many at a
    time with a special token between them, which the library takes out before it splits and
    merges, so each is encoded as if alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks = [t.content for t in added.values()]
        plain = (i for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized))
        self.mark = next(plain, None)
        self.between = "" if self.mark is None else added[self.mark].content
        self.cache = PieceCache(self.pieces, 1_000_000)
        self.letters = self._letters()

    def _letters(self) -> dict | None:
        """The byte alphabet, if a piece of letters is one pre-token whose ids the model gives
        directly: no normalizer, a byte-level pre-tokenizer with its usual pattern, BPE, and
        no added token of letters."""
        from tokenizers import models, pre_tokenizers

        pre = self.tokenizer.pre_tokenizer
        usual = isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and pre.use_regex
        if not usual or self.tokenizer.normalizer is not None or not isinstance(self.tokenizer.model, models.BPE) or any(m.strip().isalpha() for m in self.marks):
            return None
        # Printable bytes stand for themselves, the others, in order, for code points from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
        hidden = [b for b in range(256) if b not in shown]
        return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """A comma or full stop after a letter, and a line feed, are cut off by the usual
        pattern, so only what is between them is encoded, once for all pieces that share it."""
        cores = [_core(p) for p in pieces]
        known = self.cache.known
        wanted = list({c for _, c, _ in cores}.difference(known))
        new = dict(zip(wanted, self.whole(wanted), strict=True))
        ends = dict(zip(_ENDS, self.whole(list(_ENDS)), strict=True)) | {"": b""}
        return [ends[a] + (new.get(c) if c in new else known[c]) + ends[b] for a, c, b in cores]

    def whole(self, pieces: list[str]) -> list[bytes]:
        tokenize, letters, kind = self.tokenizer.model.tokenize, self.letters, self.kind
        out, rest = [None] * len(pieces), []
        for i, p in enumerate(pieces):
            if (p[1:] if p[:1] == " " else p).isalpha():
                ids = [t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))]
                out[i] = np.array(ids, kind).tobytes()
            else:
                rest.append(i)
        for i, ids in zip(rest, self.encoded([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def encoded(self, pieces: list[str]) -> list[bytes]:
        out = []
        for lo in range(0, len(pieces), 5000):
            own = pieces[lo : lo + 5000]
            if self.mark is None or any(m in p for m in self.marks for p in own):
                out += [self.ids(p).tobytes() for p in own]
                continue
            ids = self.ids(self.between.join(own))
            at, width, data = np.flatnonzero(ids == self.mark), ids.itemsize, ids.tobytes()
            starts, stops = [0, *((at + 1) * width).tolist()], [*(at * width).tolist(), len(data)]
            out += [data[a:b] for a, b in zip(starts, stops, strict=True)]
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.letters is None:  # Pieces are known to be encoded alone by the usual pattern only.
            return [self.ids(text) for text in texts]
        cut = cut_texts(texts)
        get = self.cache.fill([cut.pieces])
        quick = cut.joined(list(map(get, cut.pieces)), self.kind)
        return [self.ids(text) if slow else own for text, own, slow in zip(texts, quick, cut.slow, strict=True)]


def encoder(path: str) -> _Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return resident(("sst", path), lambda: _Encoder(path))


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class ShardWriter:
    """Writes entries, which must come in order of their keys."""

    def __init__(self, out, wide: bool, block_bytes: int = BLOCK_BYTES):
        self.out, self.wide, self.block_bytes = out, wide, block_bytes
        self.at = self.entries = self.ids = 0
        self.index, self.hashes = [], []
        self._start()

    def _start(self) -> None:
        self.block, self.last, self.count, self.before = bytearray(), b"", 0, self.ids

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.count:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype("<u4" if self.wide else "<u2").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.count, self.entries, self.ids = key, self.count + 1, self.entries + 1, self.ids + len(ids)
        self.hashes.append(xxhash.xxh64_intdigest(key))
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.count:
            stored = zlib.compress(bytes(self.block), 1)
            self.out.write(stored)
            self.index.append((self.last, self.at, len(stored), self.count, self.before))
            self.at += len(stored)
        self._start()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + b"".join(map(_varint, rest)) for k, *rest in self.index)
        bits = max(64, self.entries * BLOOM_BITS)
        filled = np.zeros(bits, bool)
        h = np.array(self.hashes, np.uint64)
        for i in range(BLOOM_HASHES):
            filled[((h >> np.uint64(32)) + np.uint64(i) * (h & np.uint64(0xFFFFFFFF))) % np.uint64(bits)] = True
        bloom = struct.pack("<Q", bits) + np.packbits(filled).tobytes()
        self.out.write(index)
        self.out.write(bloom)
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.ids, self.wide, zlib.crc32(index), MAGIC))


class Shard:
    """A shard that is open for reading."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - _FOOTER.size)
        index_at, index_len, bloom_at, bloom_len, self.entries, self.ids, self.wide, crc, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(index_at)
        index, bloom = file.read(index_len), file.read(bloom_len)
        if zlib.crc32(index) != crc:
            raise ValueError("the shard's index is damaged")
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        self.blocks, at = [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            row = [index[at : at + n]]
            at += n
            for _ in range(4):
                n, at = _read_varint(index, at)
                row.append(n)
            self.blocks.append(tuple(row))

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, stored, count, _ = self.blocks[k]
        self.file.seek(offset)
        data, at, key = zlib.decompress(self.file.read(stored)), 0, b""
        for _ in range(count):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, "<u4" if self.wide else "<u2", n // (4 if self.wide else 2), at)
            at += n

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def may_have(self, key: bytes) -> bool:
        h = xxhash.xxh64_intdigest(key)
        spots = (((h >> 32) + i * (h & 0xFFFFFFFF)) % self.bits for i in range(BLOOM_HASHES))
        return all(self.bloom[s >> 3] >> (7 - (s & 7)) & 1 for s in spots)

    def lookup(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first document with this identifier: Bloom filter, binary search
        over the blocks' last keys, one block."""
        key = key_of(doc_id)
        if not self.may_have(key):
            return None
        k = bisect.bisect_left(self.blocks, key, key=lambda b: b[0])
        return next((ids for found, ids in self.block(k) if found == key), None) if k < len(self.blocks) else None


def open_shard(path: str) -> Shard:
    fs, place = pafs.FileSystem.from_uri(path)
    return Shard(fs.open_input_file(place))


def write_shards(docs: DataFrame, root: str, tokenizer: str, end_id: int | None = END_ID, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes every text and writes the shards below ``root`` (a URI).  Returns, lazily, a
    row per shard: path, first and last identifier, the first text's digest, entries, ids."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("tag", F.md5(F.col("text").cast("binary")))
    order = (F.col("id").asc_nulls_first(), F.col("tag"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        first = last = name = tag = writer = out = None
        tail = [] if end_id is None else [end_id]

        def closed() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{root}/{name}"], "first_id": pa.array([first], pa.int64()), "last_id": pa.array([last], pa.int64()), "first_tag": [tag], "entries": [writer.entries], "n_ids": [writer.ids]})

        for batch in batches:
            for own, texts in chunks(batch, "text", 2_000_000):
                for key, digest, ids in zip(own.column("id").to_pylist(), own.column("tag").to_pylist(), encode(texts), strict=True):
                    if writer is None:
                        name, first, tag = f"{uuid.uuid4().hex}.sst", key, digest
                        out = fs.open_output_stream(f"{base}/{name}")
                        writer = ShardWriter(out, encode.wide)
                    writer.add(key_of(key), np.concatenate([ids, np.array(tail, ids.dtype)]))
                    last = key
                    if writer.at >= shard_bytes:
                        yield closed()
                        writer = None
        if writer:
            yield closed()

    return rows.mapInArrow(run, "path string, first_id long, last_id long, first_tag string, entries long, n_ids long")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the shards in ``manifest``: doc_id, start, n_tokens, ids (binary,
    little-endian 32-bit).  The manifest's rows, one a shard, are all that the driver sees."""
    shards = sorted(manifest.collect(), key=lambda r: (r.first_id is not None, r.first_id or 0, r.first_tag))
    starts, total = [], 0
    for r in shards:
        starts.append((r.path, total))
        total += r.n_ids
    # One task a shard, in the manifest's order.
    places = spark.createDataFrame(starts, "path string, start long") if starts else spark.createDataFrame([], "path string, start long")
    places = places.repartition(max(1, len(starts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows, size = [], 0
                for key, ids in open_shard(path).scan():
                    data = ids.astype("<u4").tobytes()
                    rows.append((id_of(key), start, len(ids), data))
                    start += len(ids)
                    size += len(data)
                    if size > 4_000_000:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)

    return places.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def token_shards(spark: SparkSession, documents: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the corpus's shards into the shared folder, reads them back, and digests them."""
    work = Workspace(spark, "sst")
    manifest = work.save(write_shards(documents, f"{work.path}/shards", tokenizer), "manifest")
    return read_shards(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
