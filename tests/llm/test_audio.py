import hashlib
import zlib

import numpy as np
import pytest

from skylocus.llm import audio, common, queries


def test_wav_round_trip():
    for n in (0, 64, 65, 1000):
        data = bytes(k % 256 for k in range(n))
        assert audio.wav_samples(audio.wav(data, 16_000)) == (data, 16_000)


def test_resample_keeps_a_tone():
    x = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    y = audio.resample(x, 1, 2, 24)
    # half an input sample late, as the docstring says
    want = np.sin(2 * np.pi * 440 * (np.arange(len(y)) - 0.25) / 8_000)
    assert abs(len(y) - 8_000) <= 1
    assert np.abs(y - want)[200:-200].max() < 0.002
    high = np.sin(2 * np.pi * 7_000 * np.arange(16_000) / 16_000)
    assert np.abs(audio.resample(high, 1, 2, 24))[200:-200].max() < 0.05


def test_hysteresis():
    db = np.array([-30, -15, -10, -15, -15, -30, -15, -30, -10, -17, -10.0])
    assert audio.segments(db, -14, -16).tolist() == [[2, 5], [8, 9], [10, 11]]
    assert len(audio.segments(np.zeros(0), -14, -16)) == 0


def test_query_columns(spark, tmp_path):
    texts = [(1, "hello"), (2, None), (3, ""), (4, "é" * 1000), (5, "x" * 300_000), (6, "hello"), (None, "a" * 64)]
    spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, media int").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op7_audio_features(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    by_id = {r.doc_id: r for r in rows}
    for i, t in texts:
        data = (t or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        r = by_id[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = audio.wav(payload, queries.AUDIO.rate)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert by_id[1].feature == by_id[6].feature and by_id[1].feature != by_id[4].feature
    assert by_id[2].feature == by_id[3].feature


def naive_resample(x, up, down, taps):
    """Zeros between the samples, one long low pass, and every ``down``-th value."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) / max(up, down) * np.hanning(n + 2)[1:-1]
    h *= up / h.sum()
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    out = []
    for k in range(-(-len(x) * up // down)):
        # so many of the filter's input samples come before the middle
        at = k * down + (taps - taps // 2 - 1) * up
        total = sum(h[j] * stuffed[at - j] for j in range(n) if 0 <= at - j < len(stuffed))
        out.append(total)
    return np.array(out)


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 3), (3, 2), (2, 1)])
def test_polyphase_is_stuffing_filtering_and_dropping(up, down):
    x = np.random.default_rng(up * 10 + down).normal(size=150)
    assert np.allclose(audio.resample(x, up, down, 8), naive_resample(x, up, down, 8))


def naive_features(samples, config):
    """Log-mel by a plain Fourier sum, filter by filter, and segments frame by frame."""
    x = np.array([b - 128 for b in samples]) / 128
    y = audio.resample(x, config.up, config.down, config.taps).tolist()
    n = max(1, -(-(len(y) - config.frame) // config.hop) + 1)
    y += [0.0] * (n * config.hop + config.frame)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(config.out_rate / 2) * k / (config.mels + 1) / 2595) - 1) for k in range(config.mels + 2)]
    turns = np.exp(-2j * np.pi * np.outer(np.arange(config.frame // 2 + 1), np.arange(config.frame)) / config.frame)
    rows, db = [], []
    for k in range(n):
        part = np.array(y[k * config.hop : k * config.hop + config.frame])
        db.append(10 * np.log10(max(np.mean(part**2), 1e-10)))
        power = np.abs(turns @ (part * np.hanning(config.frame))) ** 2
        row = []
        for low, mid, high in zip(edges, edges[1:], edges[2:], strict=False):
            weights = []
            for b in range(config.frame // 2 + 1):
                f = b * config.out_rate / config.frame
                weights.append(max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid))))
            row.append(np.log10(max(np.dot(weights, power) / max(sum(weights), 1e-9), 1e-10)))
        rows.append(row)
    spans, start = [], None
    for k, level in enumerate([*db, -1e9]):
        if start is None and level >= config.high_db:
            start = k
        elif start is not None and level < config.low_db:
            spans.append([start, k])
            start = None
    return np.array(rows), np.array(db), spans


@pytest.mark.parametrize("config", [audio.Config(), audio.Config(up=3, down=2, mels=20)])
def test_features_against_plain_sums(config):
    r = np.random.default_rng(3)
    loud = (128 + 120 * np.sin(np.arange(1500) / 3)).astype(np.uint8).tobytes()
    for samples in (b"\0" * 64, b"plain text, some of it " * 60, loud + bytes([128]) * 3000 + loud, r.integers(0, 256, 3000).astype(np.uint8).tobytes()):
        got = audio.analyse(samples, config.rate, config)
        mel, db, spans = naive_features(samples, config)
        assert np.allclose(got.log_mel, mel, atol=1e-3) and np.allclose(got.energy_db, db)
        assert got.segments.tolist() == spans


def test_tensor_files(spark, monkeypatch):
    monkeypatch.setattr(audio, "FILE_MEDIA", 2)
    config = audio.Config()
    texts = [(1, "hello " * 5000), (2, None), (None, "x" * 64), (1, "again " * 700), (5, "end")]
    docs = spark.createDataFrame([(*t, "y") for t in texts], "doc_id long, text string, tensor string").coalesce(1)
    manifest = audio.write_tensors(audio.store(docs, config.rate), common.new_folder(spark, "tensors"), config).collect()
    tables = [audio.read_tensors(m.file) for m in manifest]
    assert [t.num_rows for t in tables] == [m.n_tensors for m in manifest]
    rows = [r for t in tables for r in zip(t["key"].to_pylist(), t["tensor_index"].to_pylist(), t["tensor"].combine_chunks().to_numpy_ndarray(), t["n_frames"].to_pylist(), t["start_s"].to_pylist(), t["end_s"].to_pylist(), strict=True)]
    seen = 0
    for key, text in texts:
        data = (text or "").encode()
        f = audio.analyse(data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data)), config.rate, config)
        n = -(-len(f.log_mel) // config.tensor_frames)
        own = rows[seen : seen + n]
        seen += n
        assert [(r[0], r[1]) for r in own] == [(key, k) for k in range(n)] and all(r[2].shape == (config.tensor_frames, config.mels) for r in own)
        assert np.array_equal(np.concatenate([r[2][: r[3]] for r in own]), f.log_mel.astype(np.float16))
        assert all(abs(r[4] - r[1] * config.tensor_frames * config.hop / config.out_rate) < 1e-9 and r[5] > r[4] for r in own)
    assert seen == len(rows)
    assert audio.write_tensors(audio.store(docs, config.rate).limit(0), common.new_folder(spark, "tensors"), config).collect() == []


def test_query_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op7_audio_features(spark, str(tmp_path))
    assert out.collect() == [] and out.columns == [x.split()[0] for x in audio.DIGESTS.split(", ")]


def test_empty_table(spark):
    assert audio.store(spark.createDataFrame([], "doc_id long, text string"), 16_000).collect() == []
