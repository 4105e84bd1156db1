"""Audio columns: 8-bit wave files, polyphase resampling, log-mel frames, energy segments.

``store_waves`` keeps any binary payload as the samples of a RIFF/WAVE file and runs in
the JVM.  ``audio_features`` reads such files back and computes, file by file:

1. samples resampled by the ratio UP/DOWN with a windowed-sinc low-pass whose taps are
   split into UP phases, so only samples that are kept are computed;
2. log-mel energies of overlapping Hann frames, rounded to ``STEPS`` parts of a neper, as
   are the frames' energies in decibels, so that equal payloads give equal bytes although
   processors differ in the last digits of a transform;
3. segments by hysteresis: a segment is a run of frames over the low threshold that has at
   least one frame over the high one; both are set from the file's own energies;
4. windows of ``TENSOR_FRAMES`` frames cut from each segment, the last one padded with the
   floor, as an Arrow IPC stream whose ``logmel`` column has the extension type
   ``fixed_shape_tensor`` and whose ``start_s``/``end_s`` are the time spans.

Both are narrow: no shuffle, one file in memory at a time, long files in blocks.  Equal
payloads give equal bytes.  Null payloads count as empty; an empty payload is one block of
zeros, has no segment and gives a stream of no rows.  Repeated rows are computed again; an
empty table gives no rows.  Other columns pass through; columns named like the results
(``samples``, ``rate``, ``features``, ``n_windows``, ``active_s``) are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_BYTES, tidy

RATE, BLOCK = 8_000, 64
UP, DOWN, TAPS = 3, 4, 12
FRAME, HOP, MELS = 256, 128, 24
TENSOR_FRAMES = 16
#: Percentiles of a file's frame energies over which a segment must rise once, and stay.
HIGH, LOW = 80, 50
FLOOR = 1e-10
STEPS = 64
#: Samples handled at once.
SPAN = 1 << 16


def _little_endian(value: Column) -> Column:
    """A 32-bit integer column as four bytes, least significant first."""
    digits = F.lpad(F.hex(value.cast("long")), 8, "0")
    return F.unhex(F.concat(*(F.substring(digits, i, 2) for i in (7, 5, 3, 1))))


def padded(payload: Column) -> Column:
    """The payload with zero bytes appended up to a positive multiple of BLOCK."""
    size = F.octet_length(payload)
    missing = F.when(size == 0, F.lit(BLOCK)).otherwise((BLOCK - size % BLOCK) % BLOCK)
    return F.concat(payload, F.substring(F.lit(bytes(BLOCK)), F.lit(1), missing))


def wave_file(payload: Column, rate: int = RATE) -> Column:
    """A RIFF/WAVE file of one 8-bit channel whose samples are the payload's bytes."""
    size = F.octet_length(payload)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return F.concat(F.lit(b"RIFF"), _little_endian(size + 36), F.lit(b"WAVE" + fmt + b"data"), _little_endian(size), payload)


def store_waves(df: DataFrame, payload: Column, into: str = "media") -> DataFrame:
    """Adds the column ``into``: the payload (null: empty), padded, as a wave file."""
    return df.withColumn(into, wave_file(padded(F.coalesce(payload, F.lit(b"")))))


def read_wave(data: bytes) -> tuple[int, bytes]:
    """Rate and samples of a wave file of one 8-bit channel, found by walking its chunks."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit samples of one channel are read")
        elif kind == b"data":
            if at + 8 + size > len(data):
                raise ValueError("the file ends within its samples")
            return rate, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("the file has no samples")


@lru_cache
def phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """The low-pass filter for the ratio up/down, one row of taps for each phase."""
    n = np.arange(up * taps) - (up * taps - 1) / 2
    h = np.sinc(n / max(up, down)) * np.hamming(up * taps)
    h *= up / h.sum()
    return h.reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """x at up/down times its rate: y[n] is the sum over k of h[p + k*up] * x[i - k], where
    n*down = i*up + p."""
    h = phases(up, down, taps)
    total = -(-len(x) * up // down)
    y = np.empty(total, np.float32)
    past = np.concatenate([np.zeros(taps - 1, np.float32), x])
    per = SPAN // up * up
    for lo in range(0, total, per):
        hi = min(total, lo + per)
        for p in range(up):
            n = np.arange(lo + p, hi, up)
            if not len(n):
                continue
            i, phase = n[0] * down // up, n[0] * down % up
            seen = np.lib.stride_tricks.sliding_window_view(past, taps)[i : i + (len(n) - 1) * down + 1 : down]
            y[lo + p : hi : up] = seen @ h[phase, ::-1]
    return y


@lru_cache
def mel_bank(rate: float, size: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters on the mel scale, one column for each."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(size, 1 / rate)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


def rounded(x: np.ndarray) -> np.ndarray:
    """Multiples of 1 / STEPS, which 32-bit numbers hold exactly."""
    return np.round(x * STEPS) / STEPS


def log_mel(y: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies, a row for each frame, and each frame's energy in decibels."""
    if len(y) < FRAME:
        y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
    count = 1 + (len(y) - FRAME) // HOP
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank(rate)
    mels, energy = np.empty((count, MELS), np.float32), np.empty(count, np.float32)
    step = SPAN // HOP
    for lo in range(0, count, step):
        part = frames[lo : lo + step]
        power = np.abs(np.fft.rfft(part * window, axis=1)) ** 2
        mels[lo : lo + step] = rounded(np.log(power.astype(np.float32) @ bank + FLOOR))
        energy[lo : lo + step] = rounded(10 * np.log10((part**2).mean(axis=1) + FLOOR))
    return mels, energy


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """Runs of frames over the low threshold with a frame over the high one (end exclusive)."""
    upper, lower = np.percentile(energy, [high, low])
    over = np.concatenate([[False], energy > lower, [False]])
    edges = np.flatnonzero(over[1:] != over[:-1])
    loud = np.concatenate([[0], np.cumsum(energy > upper)])
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if loud[b] > loud[a]]


_TENSOR = pa.fixed_shape_tensor(pa.float32(), (TENSOR_FRAMES, MELS), dim_names=("frame", "mel"))
TENSOR_SCHEMA = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("logmel", _TENSOR)])


def feature_stream(samples: bytes, rate: int) -> tuple[bytes, int, float]:
    """The Arrow IPC stream of a file's windows, their number, and the seconds in segments."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    rate_out = rate * UP / DOWN
    mels, energy = log_mel(resample(x), rate_out)
    starts, ends, rows, length = [], [], [], 0
    for a, b in segments(energy):
        length += b - a
        for lo in range(a, b, TENSOR_FRAMES):
            hi = min(b, lo + TENSOR_FRAMES)
            starts.append(lo * HOP / rate_out)
            ends.append(((hi - 1) * HOP + FRAME) / rate_out)
            rows.append((lo, hi))
    block = np.full((len(rows), TENSOR_FRAMES, MELS), rounded(np.log(FLOOR)), np.float32)
    for k, (lo, hi) in enumerate(rows):
        block[k, : hi - lo] = mels[lo:hi]
    flat = pa.FixedSizeListArray.from_arrays(pa.array(block.reshape(-1)), TENSOR_FRAMES * MELS)
    batch = pa.record_batch([pa.array(starts, pa.float64()), pa.array(ends, pa.float64()), pa.ExtensionArray.from_storage(_TENSOR, flat)], schema=TENSOR_SCHEMA)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSOR_SCHEMA) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes(), len(rows), length * HOP / rate_out


def audio_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds to each row what its wave file holds: ``samples`` as read back, ``rate``, and
    ``features`` (the Arrow stream of tensors), ``n_windows`` and ``active_s``."""
    added = [("samples", T.BinaryType()), ("rate", T.IntegerType()), ("features", T.BinaryType()), ("n_windows", T.LongType()), ("active_s", T.DoubleType())]
    clash = {c for c, _ in added} & set(df.columns)
    df = df.drop(*clash)
    schema = T.StructType(df.schema.fields + [T.StructField(n, t) for n, t in added])
    types = [pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.float64()]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size, start = [], 0, 0
            column = batch.column(media)
            for i in range(batch.num_rows):
                rate, samples = read_wave(column[i].as_py())
                rows.append((samples, rate, *feature_stream(samples, rate)))
                size += 2 * len(samples) + len(rows[-1][2])
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    own = batch.slice(start, i + 1 - start)
                    new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*own.columns, *new], names=[*own.schema.names, *(n for n, _ in added)])
                    rows, size, start = [], 0, i + 1

    return df.mapInArrow(run, schema)


def digest_media(documents: DataFrame) -> DataFrame:
    """Stores every text as a wave file, reads it back and digests file, samples and tensors."""
    docs = documents.select("doc_id", F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")).alias("payload"))
    stored = store_waves(docs, F.col("payload")).select("doc_id", F.octet_length("payload").cast("long").alias("n_bytes"), "media")
    return audio_features(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("n_windows"), F.round("active_s", 3), F.sha2("features", 256)).alias("feature"),
    )
