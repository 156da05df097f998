"""Audio features of media columns.

Audio is a binary column of WAV files of 8-bit samples. Features come from polyphase
resampling, overlapped log-mel filterbanks and segments of energy with hysteresis,
and are kept as tensors of one fixed shape, each with the span of time it covers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, files


@dataclass(frozen=True)
class Config:
    """``rate`` is resampled by ``up`` / ``down``; frames, hop and tensors are counted in the resampled signal."""

    rate: int = 16_000
    up: int = 1
    down: int = 2
    taps: int = 24
    frame: int = 256
    hop: int = 128
    mels: int = 40
    tensor_frames: int = 16
    high_db: float = -14.0
    low_db: float = -16.0

    @property
    def out_rate(self) -> float:
        return self.rate * self.up / self.down


#: Samples resampled at a time.
AT_ONCE = 1 << 20
#: Tensor bytes and media of a file of tensors, and tensor bytes of a record batch in it.
FILE_BYTES, FILE_MEDIA, BATCH_BYTES = 32 << 20, 1 << 12, 1 << 20
_WAV = struct.Struct("<4sI4s4sIHHIIHH4sI")


def wav(samples: bytes, rate: int) -> bytes:
    """A WAV file of one channel of unsigned 8-bit samples; an odd number is padded as the format asks."""
    odd = len(samples) & 1
    return _WAV.pack(b"RIFF", 36 + len(samples) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + b"\0" * odd


def wav_samples(data: bytes) -> tuple[bytes, int]:
    """The samples and the rate of a WAV file of 8-bit samples in one channel."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("only one channel of 8-bit samples is read")
        elif kind == b"data":
            return data[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("the WAV file has no samples")


@lru_cache
def filter_phases(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low pass for the slower of the rates, cut into ``up`` phases of ``taps`` each."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cutoff = 1 / max(up, down)
    h = cutoff * np.sinc(t * cutoff) * np.hanning(n + 2)[1:-1]
    h *= up / h.sum()
    return h.reshape(taps, up).T[:, ::-1].copy()


def resample(x: np.ndarray, up: int, down: int, taps: int) -> np.ndarray:
    """``x`` at ``up / down`` times its rate: each output takes one phase of the filter, and no zeros are multiplied.

    With an even number of taps the filter's middle lies between two samples, and the result is half an input sample late.
    """
    if up == down or not len(x):
        return x
    phases = filter_phases(up, down, taps)
    n = -(-len(x) * up // down)
    padded = np.concatenate((np.zeros(taps // 2), x, np.zeros(taps)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n)
    for phase in range(up):
        # outputs k with k * down % up == phase, a whole number of inputs apart
        ks = np.flatnonzero(np.arange(min(n, up)) * down % up == phase)
        for k in ks:
            for lo in range(k, n, up * AT_ONCE):
                hi = min(n, lo + up * AT_ONCE)
                first = lo * down // up
                out[lo:hi:up] = windows[first :: down][: len(range(lo, hi, up))] @ phases[phase]
    return out


@lru_cache
def mel_bank(rate: float, frame: int, mels: int) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, over the bins of a frame's spectrum."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.arange(frame // 2 + 1) * rate / frame
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0, np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid)))
    return (bank / np.maximum(bank.sum(axis=1, keepdims=True), 1e-9)).T.copy()


def frames_of(x: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """Overlapping frames, the last one padded with silence; one at least."""
    n = max(1, -(-(len(x) - frame) // hop) + 1)
    padded = np.concatenate((x, np.zeros(max(0, (n - 1) * hop + frame - len(x)))))
    return np.lib.stride_tricks.sliding_window_view(padded, frame)[::hop][:n]


def log_mel(frames: np.ndarray, rate: float, mels: int) -> np.ndarray:
    window = np.hanning(frames.shape[1])
    bank = mel_bank(rate, frames.shape[1], mels)
    out = np.empty((len(frames), mels), np.float32)
    for lo in range(0, len(frames), 1 << 12):
        power = np.abs(np.fft.rfft(frames[lo : lo + (1 << 12)] * window)) ** 2
        out[lo : lo + (1 << 12)] = np.log10(np.maximum(power @ bank, 1e-10))
    return out


def segments(db: np.ndarray, high: float, low: float) -> np.ndarray:
    """Runs of frames, as (first, last + 1), that begin at ``high`` or louder and go on while not below ``low``."""
    loud = np.concatenate(([False], db >= low, [False]))
    starts, ends = np.flatnonzero(loud[1:] & ~loud[:-1]), np.flatnonzero(~loud[1:] & loud[:-1])
    peaks = np.concatenate(([0], np.cumsum(db >= high)))
    # a quiet beginning is no part of the segment: it begins where it first is loud enough
    first_high = np.searchsorted(peaks, peaks[starts], "right") - 1 if len(starts) else starts
    keep = first_high < ends
    return np.stack([first_high[keep], ends[keep]], axis=1) if keep.any() else np.zeros((0, 2), np.int64)


@dataclass(frozen=True)
class Features:
    log_mel: np.ndarray
    energy_db: np.ndarray
    segments: np.ndarray


def analyse(samples: bytes, rate: int, config: Config) -> Features:
    """The features of 8-bit samples. They depend on the samples and the configuration only."""
    if rate != config.rate:
        raise ValueError(f"the samples have rate {rate}; the configuration is for {config.rate}")
    x = (np.frombuffer(samples, np.uint8).astype(np.float64) - 128) / 128
    frames = frames_of(resample(x, config.up, config.down, config.taps), config.frame, config.hop)
    db = 10 * np.log10(np.maximum(np.einsum("ij,ij->i", frames, frames) / config.frame, 1e-10))
    return Features(log_mel(frames, config.out_rate, config.mels), db, segments(db, config.high_db, config.low_db))


def tensors(f: Features, config: Config) -> tuple[np.ndarray, list[tuple[float, float]], np.ndarray]:
    """The log-mel frames in tensors of one shape (the last padded with zeros), their spans in seconds, and how many frames are real."""
    n = len(f.log_mel)
    count = -(-n // config.tensor_frames)
    out = np.zeros((count, config.tensor_frames, config.mels), np.float16)
    out.reshape(-1, config.mels)[:n] = f.log_mel
    real = np.minimum(config.tensor_frames, n - np.arange(count) * config.tensor_frames)
    step = config.hop / config.out_rate
    spans = [(k * config.tensor_frames * step, (k * config.tensor_frames + int(real[k]) - 1) * step + config.frame / config.out_rate) for k in range(count)]
    return out, spans, real


def tensor_type(config: Config) -> pa.DataType:
    return pa.fixed_shape_tensor(pa.float16(), [config.tensor_frames, config.mels])


class TensorFile:
    """An Arrow file of fixed-shape tensors that is written media by media.

    Its columns: ``key``, ``tensor_index``, ``tensor``, ``n_frames``, ``start_s``,
    ``end_s``, and ``active``, the (start, end) seconds of energy segments within the tensor.
    """

    def __init__(self, folder: str, config: Config) -> None:
        self.config, self.uri, self.n_media, self.n_tensors = config, files.fresh(folder, "tensors", ".arrow"), 0, 0
        span = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
        self.schema = pa.schema([
            ("key", pa.int64()), ("tensor_index", pa.int32()), ("tensor", tensor_type(config)), ("n_frames", pa.int32()),
            ("start_s", pa.float64()), ("end_s", pa.float64()), ("active", pa.list_(span)),
        ])
        system, path = files.resolve(self.uri)
        self.sink = system.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.tensor_bytes = 2 * config.tensor_frames * config.mels
        self.blocks: list[np.ndarray] = []
        self.rows: list[tuple] = []

    def add(self, key: int | None, f: Features) -> int:
        """Write the tensors of one media; returns how many there are."""
        config, step = self.config, self.config.hop / self.config.out_rate
        block, spans, real = tensors(f, config)
        active = [
            [{"start_s": max(a * step, s), "end_s": min((b - 1) * step + config.frame / config.out_rate, e)} for a, b in f.segments.tolist()
             if a < (t + 1) * config.tensor_frames and b > t * config.tensor_frames]
            for t, (s, e) in enumerate(spans)
        ]
        self.blocks.append(block)
        self.rows += [(key, t, int(real[t]), *spans[t], active[t]) for t in range(len(block))]
        self.n_media, self.n_tensors = self.n_media + 1, self.n_tensors + len(block)
        if len(self.rows) * self.tensor_bytes >= BATCH_BYTES:
            self._flush()
        return len(block)

    def _flush(self) -> None:
        if not self.rows:
            return
        own = dict(zip(("key", "tensor_index", "n_frames", "start_s", "end_s", "active"), zip(*self.rows, strict=True), strict=True))
        flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(self.blocks).reshape(-1)), self.config.tensor_frames * self.config.mels)
        made = {"tensor": pa.ExtensionArray.from_storage(tensor_type(self.config), flat)}
        columns = [made.get(f.name) if f.name in made else pa.array(own[f.name], f.type) for f in self.schema]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.blocks, self.rows = [], []

    @property
    def full(self) -> bool:
        return self.n_media >= FILE_MEDIA or self.n_tensors * self.tensor_bytes >= FILE_BYTES

    def close(self) -> str:
        self._flush()
        self.writer.close()
        self.sink.close()
        return self.uri


def write_tensors(media: DataFrame, folder: str, config: Config = Config(), key: str = "doc_id", column: str = "media") -> DataFrame:
    """Write the tensors of a media column to files (``TensorFile``) of bounded size.

    Returns the manifest (``file``, ``n_tensors``), materialised: a task that runs twice
    writes other files, of which it names those of one run. Null media give no tensors;
    null and repeated keys stay; an empty partition gives no file; other columns are ignored.
    """
    files.make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: TensorFile | None = None
        done = []
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not data.is_valid:
                    continue
                out = out or TensorFile(folder, config)
                out.add(k, analyse(*wav_samples(data.as_py()), config))
                if out.full:
                    done.append({"file": out.close(), "n_tensors": out.n_tensors})
                    out = None
        if out is not None:
            done.append({"file": out.close(), "n_tensors": out.n_tensors})
        if done:
            yield pa.RecordBatch.from_pylist(done)

    rows = media.select(F.col(key).cast("long").alias("key"), F.col(column).alias("media"))
    return common.checkpoint(rows.mapInArrow(run, "file string, n_tensors long"))


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame, folder: str, config: Config = Config()) -> DataFrame:
    """Write the tensors of media (``doc_id``, ``n_bytes``, ``media``), read them back, and digest media and tensors: ``DIGESTS``.

    ``feature`` has the frames and mel bands, the tensors, the second they end, the active
    spans in them, and the CRC-32 of all tensors as the file has them. A row for each row
    with media, repeated and null ids too; an empty table gives none; other columns are ignored.
    """
    files.make_folder(folder)

    def read_back(uri: str, held: list[tuple]) -> pa.RecordBatch:
        found = read_tensors(uri)
        block = found["tensor"].combine_chunks().storage.flatten().to_numpy().reshape(found.num_rows, -1)
        n_frames, ends, spans = found["n_frames"].to_numpy(), found["end_s"].to_numpy(), pc.list_value_length(found["active"]).to_numpy()
        out, at = [], 0
        for *own, n in held:
            lo, at = at, at + n
            crc = zlib.crc32(block[lo:at].astype("<f2").tobytes())
            out.append((*own, f"{n_frames[lo:at].sum()}x{config.mels}:{n}:{ends[at - 1]:.4f}:{spans[lo:at].sum()}:{crc:08x}"))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in DIGESTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: TensorFile | None = None
        held: list[tuple] = []
        for batch in batches:
            for doc, n, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if not value.is_valid:
                    continue
                stored = value.as_py()
                payload, rate = wav_samples(stored)
                out = out or TensorFile(folder, config)
                count = out.add(doc, analyse(payload, rate, config))
                held.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), count))
                if out.full:
                    yield read_back(out.close(), held)
                    out, held = None, []
        if out is not None:
            yield read_back(out.close(), held)

    return media.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), "media").mapInArrow(run, DIGESTS)


def read_tensors(uri: str) -> pa.Table:
    """A file of tensors, whose column ``tensor`` gives numpy arrays of the fixed shape."""
    system, path = files.resolve(uri)
    with system.open_input_file(path) as f:
        return pa.ipc.open_file(f).read_all()


def store(docs: DataFrame, rate: int, block: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A media column from texts: the UTF-8 bytes, filled up with zeros to a positive multiple of ``block``, as samples of a WAV file.

    Returns ``doc_id``, ``n_bytes`` (of the text) and ``media``. A null text is an empty one; repeated rows and null ids
    stay; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                rows = batch.slice(lo, 512)
                texts = [x.as_py() or b"" for x in rows.column(1)]
                media = [wav(t + b"\0" * (max(block, -(-len(t) // block) * block) - len(t)), rate) for t in texts]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")
