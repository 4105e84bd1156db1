import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptloom.llm import media


def test_payloads_come_back_whole(odd):
    got = media.digest_media(odd).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r for r in got}
    for r in odd.collect():
        raw = (r.text or "").encode()
        whole = raw + bytes(-len(raw) % 64 if raw else 64)
        g = by_id[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        assert g.media_bytes == len(whole) + 44


def test_equal_texts_have_equal_values(odd):
    got = [tuple(r)[1:] for r in media.digest_media(odd.where("text = 'plain words here'")).collect()]
    assert len(got) == 3 and len(set(got)) == 1


def test_empty_table(none):
    assert media.digest_media(none).collect() == []


def test_stored_form_is_a_wave_file(tmp_path, docs_of):
    import wave

    row = media.store_waves(docs_of(["hello"]), F.encode("text", "UTF-8")).first()
    (tmp_path / "x.wav").write_bytes(row.media)
    with wave.open(str(tmp_path / "x.wav")) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()) == (1, 1, 8000, 64)
        assert w.readframes(64) == b"hello" + bytes(59)
    assert media.read_wave(bytes(row.media)) == (8000, b"hello" + bytes(59))
    with pytest.raises(ValueError, match="ends within"):
        media.read_wave(bytes(row.media)[:-1])


@pytest.mark.parametrize(("up", "down", "n"), [(3, 4, 1000), (5, 2, 333), (1, 3, 200), (3, 4, 200_001)])
def test_polyphase_equals_stuffing_filtering_and_dropping(up, down, n):
    x = np.random.default_rng(1).normal(size=n).astype(np.float32)
    h = media.phases(up, down, 12).T.reshape(-1)
    stuffed = np.zeros(n * up)
    stuffed[::up] = x
    want = np.convolve(stuffed, h)[: n * up][::down]
    np.testing.assert_allclose(media.resample(x, up, down, 12), want, atol=1e-4)


def test_log_mel_in_blocks_equals_frame_by_frame():
    y = np.random.default_rng(2).normal(size=media.SPAN + 5000).astype(np.float32)
    mels, energy = media.log_mel(y, 6000)
    for k in (0, 1, media.SPAN // media.HOP, len(mels) - 1):
        part = y[k * media.HOP : k * media.HOP + media.FRAME]
        power = np.abs(np.fft.rfft(part * np.hanning(media.FRAME))) ** 2
        np.testing.assert_allclose(mels[k], np.log(power @ media.mel_bank(6000) + media.FLOOR), rtol=1e-3, atol=0.5 / media.STEPS)
        assert abs(energy[k] - 10 * np.log10((part**2).mean() + media.FLOOR)) < 0.51 / media.STEPS
    assert (mels * media.STEPS % 1 == 0).all() and (energy * media.STEPS % 1 == 0).all()


def test_hysteresis():
    e = np.array([0, 1, 5, 1, 0, 1, 1, 0, 9, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0.0])
    assert media.segments(e, 90, 50) == [(1, 4), (8, 9)]  # (5, 7) never rises over the high threshold
    assert media.segments(np.ones(5)) == []


def test_stream_has_tensors_of_fixed_shape_with_spans():
    x = np.full(20_000, 128, np.uint8)
    x[8000:12000] = np.random.default_rng(3).integers(0, 255, 4000)
    data, n, active = media.feature_stream(x.tobytes(), 8000)
    table = pa.ipc.open_stream(data).read_all()
    assert table.schema.field("logmel").type == pa.fixed_shape_tensor(pa.float32(), (media.TENSOR_FRAMES, media.MELS), dim_names=("frame", "mel"))
    assert table.num_rows == n > 0 and active > 0
    assert 0.9 < min(table["start_s"].to_pylist()) and max(table["end_s"].to_pylist()) < 1.6


@pytest.mark.parametrize("span", [media.HOP * 3, 1 << 30])
def test_long_payload_in_blocks(monkeypatch, span):
    x = np.random.default_rng(4).integers(0, 255, 3 * media.SPAN + 77).astype(np.uint8).tobytes()
    want = media.feature_stream(x, 8000)
    monkeypatch.setattr(media, "SPAN", span)
    got = media.feature_stream(x, 8000)
    assert got[1:] == want[1:] and got[1] > 100
    a, b = (pa.ipc.open_stream(g[0]).read_all() for g in (got, want))
    assert a.drop(["logmel"]) == b.drop(["logmel"])
    # Sums of other lengths differ in their last digits, so a value at the edge may round otherwise.
    flat = [np.asarray(t["logmel"].combine_chunks().storage.flatten()) for t in (a, b)]
    assert np.abs(flat[0] - flat[1]).max() <= 1 / media.STEPS and (flat[0] != flat[1]).mean() < 0.001


def test_clashing_columns_are_replaced(docs_of):
    docs = media.store_waves(docs_of(["hello"]).withColumn("rate", F.lit("clash")).withColumn("samples", F.lit(1)), F.encode("text", "UTF-8"))
    row = media.audio_features(docs).first()
    assert (row.rate, bytes(row.samples), row.lang) == (8000, b"hello" + bytes(59), "en")
