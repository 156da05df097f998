"""Videos: headers of AVI and MP4 / MOV files, and the frames of AVI files whose pictures stand for themselves.

Containers are walked by their chunk headers, so a probe reads some hundred bytes and a
frame scan only the frames that are wanted. Motion JPEG pictures are decoded by Spark's
image source, uncompressed ones here. Other codecs need a decoder that isn't here.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylocus.operators import imaging, tiling
from skylocus.sources import storage

EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".m4v")
HEADER = "video string, fps double, frame_count_header long, width int, height int, fourcc string, duration_sec_header double"
#: Boxes of an MP4 file that hold other boxes on the way to a track's description.
_NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl")


def _fourcc(data: bytes) -> str:
    return data.decode("latin-1").strip("\0")


def _riff(f, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """The chunks of a RIFF list: name (a list's own after ``LIST``), place of the data, and its size."""
    while at + 8 <= end:
        f.seek(at)
        name, size = struct.unpack("<4sI", f.read(8))
        if name in (b"LIST", b"RIFF"):
            yield name + f.read(4), at + 12, size - 4
        else:
            yield name, at + 8, size
        at += 8 + size + (size & 1)


def _avi(f, size: int) -> dict:
    """Header of the first video stream, its number, and where its frames are listed."""
    found: dict = {"movi": []}
    streams = 0
    for top, start, n in _riff(f, 0, size):
        if top not in (b"RIFFAVI ", b"RIFFAVIX"):
            continue
        for name, at, length in _riff(f, start, start + n):
            if name == b"LISTmovi":
                found["movi"].append((at, length))
            elif name == b"LISThdrl":
                for inner, a, m in _riff(f, at, at + length):
                    if inner != b"LISTstrl":
                        continue
                    head = {k: (b, c) for k, b, c in _riff(f, a, a + m)}
                    f.seek(head[b"strh"][0])
                    kind, handler, _, _, _, _, scale, rate, _, count = struct.unpack("<4s4sIHHIIIII", f.read(36))
                    if kind == b"vids" and "fps" not in found:
                        f.seek(head[b"strf"][0])
                        _, width, height, _, depth, codec = struct.unpack("<IiiHH4s", f.read(20))
                        found |= {
                            "fps": rate / scale if scale else 0.0, "frame_count_header": count, "width": width, "height": abs(height),
                            "fourcc": _fourcc(codec if codec != b"\0" * 4 else handler), "stream": streams, "flipped": height > 0, "depth": depth,
                        }
                    streams += 1
    if "fps" not in found:
        raise RuntimeError("the AVI file has no video stream")
    return found


def _boxes(f, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        f.seek(at)
        size, name = struct.unpack(">I4s", f.read(8))
        head = 8
        if size == 1:
            (size,), head = struct.unpack(">Q", f.read(8)), 16
        size = size or end - at
        if size < head:
            return
        yield name, at + head, size - head
        at += size


def _mp4(f, size: int) -> dict:
    """Header of the first video track."""

    def track(at: int, end: int, found: dict) -> dict:
        for name, start, n in _boxes(f, at, end):
            f.seek(start)
            if name in _NESTED:
                track(start, start + n, found)
            elif name == b"hdlr":
                found["kind"] = f.read(12)[8:12]
            elif name == b"mdhd":
                version = f.read(4)[0]
                f.seek(start + (20 if version else 12))
                (found["timescale"],) = struct.unpack(">I", f.read(4))
            elif name == b"stsd":
                data = f.read(min(n, 44))
                found["fourcc"] = _fourcc(data[12:16])
                found["width"], found["height"] = struct.unpack(">HH", data[40:44]) if len(data) == 44 else (0, 0)
            elif name == b"stts":
                (entries,) = struct.unpack(">4xI", f.read(8))
                runs = [struct.unpack(">II", f.read(8)) for _ in range(entries)]
                found["frames"], found["units"] = sum(c for c, _ in runs), sum(c * d for c, d in runs)
        return found

    for name, start, n in _boxes(f, 0, size):
        if name != b"moov":
            continue
        for inner, at, m in _boxes(f, start, start + n):
            if inner == b"trak":
                found = track(at, at + m, {})
                if found.get("kind") == b"vide" and "frames" in found:
                    fps = found["frames"] * found["timescale"] / found["units"] if found["units"] else 0.0
                    return {"fps": fps, "frame_count_header": found["frames"], "width": found["width"], "height": found["height"], "fourcc": found["fourcc"]}
    raise RuntimeError("the file has no video track")


def header(uri: str) -> dict:
    """A video's header, as the container tells it; the frame count may be wrong. An unknown container raises, a missing file too."""
    system, path = storage.resolve(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        mark = f.read(12)
        if mark[:4] == b"RIFF" and mark[8:] == b"AVI ":
            found = _avi(f, size)
        elif mark[4:8] in (b"ftyp", b"moov", b"wide", b"mdat", b"free"):
            found = _mp4(f, size)
        else:
            raise RuntimeError(f"can't open the video {uri}")
    found["duration_sec_header"] = found["frame_count_header"] / found["fps"] if found["fps"] > 0 else None
    return found


def probe(videos: DataFrame) -> DataFrame:
    """``HEADER`` of each ``video`` (a URI), where the files are read."""
    names = [f.split(" ")[0] for f in HEADER.split(", ")]
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in HEADER.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{"video": v, **{k: x for k, x in header(v).items() if k in names}} for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    return videos.select("video").mapInArrow(run, HEADER)


def audit(headers: DataFrame, rates: tuple[int, ...] = (1, 2, 5, 10)) -> DataFrame:
    """About how many frames each video gives at some rates; without a frame rate it lasts no time."""
    seconds = F.when(F.col("fps") > 0, F.col("frame_count_header") / F.when(F.col("fps") > 0, F.col("fps"))).otherwise(0.0)
    out = headers.withColumn("duration_sec", seconds).withColumn("target_fps", F.explode(F.array(*[F.lit(r) for r in rates])))
    return out.select("video", "width", "height", "fps", "frame_count_header", "duration_sec", "target_fps", F.floor(F.col("duration_sec") * F.col("target_fps")).alias("frames"))


def default_video(folder: str, preferred: str | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> str:
    """``preferred`` if it is there, else the one video of a folder; none or several raise."""
    if preferred and storage.exists(preferred):
        return preferred
    found = [n for n in storage.names(folder) if storage.suffix(n).lower() in extensions]
    if len(found) != 1:
        raise FileNotFoundError(f"{folder} has no video") if not found else RuntimeError(f"{folder} has several videos: {', '.join(found)}")
    return f"{folder}/{found[0]}"


def frame_index(videos: DataFrame) -> DataFrame:
    """Where each frame of AVI files is: ``video``, ``source_frame_idx``, ``offset``, ``length``. Only chunk headers are read."""
    schema = pa.schema([("video", pa.string()), ("source_frame_idx", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])

    def places(f, at: int, end: int, stream: bytes) -> Iterator[tuple[int, int]]:
        for name, start, n in _riff(f, at, end):
            if name == b"LISTrec ":
                yield from places(f, start, start + n, stream)
            elif name[:2] == stream and name[2:] in (b"dc", b"db"):
                yield start, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for video in batch.column(0).to_pylist():
                system, path = storage.resolve(video)
                with system.open_input_file(path) as f:
                    if f.read(4) != b"RIFF":
                        raise RuntimeError(f"frames are read of AVI files only, not of {video}")
                    found = _avi(f, f.size())
                    stream = b"%02d" % found["stream"]
                    own = [p for at, n in found["movi"] for p in places(f, at, at + n, stream)]
                yield pa.RecordBatch.from_pylist([{"video": video, "source_frame_idx": k, "offset": a, "length": n} for k, (a, n) in enumerate(own)], schema=schema)

    return videos.select("video").mapInArrow(run, "video string, source_frame_idx long, offset long, length long")


def pictures(wanted: DataFrame) -> DataFrame:
    """The bytes of frames (columns of ``frame_index``): adds ``fourcc``, ``data``, and of uncompressed ones ``rgb``, ``width`` and ``height``."""
    kept = wanted.columns
    made = pa.schema([("fourcc", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("data", pa.binary()), ("rgb", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[str, dict] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                video, offset, length = (batch.column(c)[k].as_py() for c in ("video", "offset", "length"))
                system, path = storage.resolve(video)
                head = heads.get(video) or heads.setdefault(video, header(video))
                with system.open_input_file(path) as f:
                    f.seek(offset)
                    data = f.read(length)
                w, h, rgb = head["width"], head["height"], None
                if head["fourcc"] in ("", "DIB ", "RGB "):
                    if head["depth"] != 24:
                        raise RuntimeError(f"uncompressed frames of {head['depth']} bits in {video}")
                    rows = np.frombuffer(data, np.uint8).reshape(h, -1)[:, : 3 * w].reshape(h, w, 3)[..., ::-1]
                    rgb = (rows[::-1] if head["flipped"] else rows).tobytes()
                elif head["fourcc"].upper() != "MJPG":
                    raise RuntimeError(f"there is no decoder for {head['fourcc']} in {video}")
                row = {"fourcc": head["fourcc"], "width": w, "height": h, "data": data if rgb is None else None, "rgb": rgb}
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, *pa.RecordBatch.from_pylist([row], schema=made).columns], [*batch.schema.names, *made.names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)
    return wanted.select(*kept).mapInArrow(run, f"{fields}, fourcc string, width int, height int, data binary, rgb binary")


def sampled(spark: SparkSession, video: str, target_fps: float | None = 1.0, every_n: int | None = None, start_sec: float = 0.0, limit: int | None = None) -> tuple[DataFrame, dict]:
    """The frame registry of a video with each frame's place in it, and the header with the step taken."""
    head = header(video)
    step = tiling.step_of(head["fps"], target_fps, every_n)
    index = frame_index(spark.createDataFrame([(video,)], "video string")).withColumns({"width": F.lit(head["width"]), "height": F.lit(head["height"])})
    registry = tiling.sample_frames(index, head["fps"], target_fps, every_n, max(0.0, start_sec), limit)
    return registry.join(index.select("source_frame_idx", "video", "offset", "length"), "source_frame_idx"), head | {"step": step}


def decoded(spark: SparkSession, frames: DataFrame, stage: str) -> DataFrame:
    """Frames (``frame_id`` and their places) as images: ``image_id``, ``width``, ``height``, ``rgb``.

    JPEG pictures go through files in the folder ``stage``, as the image source reads files. One that can't be decoded raises.
    """
    found = pictures(frames.select("frame_id", "video", "offset", "length"))
    raw = found.filter("rgb IS NOT NULL").select(F.col("frame_id").alias("image_id"), "width", "height", "rgb")
    coded = found.filter("rgb IS NULL").select(F.concat(F.col("frame_id"), F.lit(".jpg")).alias("name"), "data")
    written = imaging.write_files(coded, stage, "name", "data").agg(F.count(F.lit(1))).first()[0]
    if not written:
        return raw
    images = imaging.read_images(spark, stage)
    return raw.unionByName(images.select(F.regexp_replace("name", "[.]jpg$", "").alias("image_id"), "width", "height", "rgb"))
