"""Pictures, a map and a video made by formulas, as files: inputs of queries whose results SQL can compute too."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import SparkSession

from skylocus.operators import imaging
from skylocus.sources import storage

MAP_W, MAP_H, TILE = 200, 136, 64
VIDEO_W, VIDEO_H, VIDEO_FRAMES, FPS = 24, 16, 95, 30
#: Frames of the town, by the place of their first pixel on it.
TOWN_W, TOWN_H, FRAME_W, FRAME_H, SCALE = 640, 512, 960, 540, 0.27
PLACES = {"frame_0001.png": (210, 170), "frame_0002.png": (30, 41), "frame_0003.png": (350, 300)}


def map_pixels() -> np.ndarray:
    """RGBA of (x, y): 7x + 3y, xy, x + 2y, and 255 - (x + y) mod 3 * 60; all mod 256."""
    y, x = np.mgrid[0:MAP_H, 0:MAP_W]
    return np.stack([(7 * x + 3 * y) % 256, x * y % 256, (x + 2 * y) % 256, 255 - (x + y) % 3 * 60], axis=-1).astype(np.uint8)


def write_map(spark: SparkSession) -> str:
    folder = storage.scratch(spark, "map")
    storage.write(f"{folder}/map.png", imaging.png(map_pixels()))
    return folder


def write_video(spark: SparkSession) -> str:
    """An AVI of uncompressed pictures: of frame k, pixel (x, y) is k + x, 2k + y, 3k mod 256."""
    y, x = np.mgrid[0:VIDEO_H, 0:VIDEO_W]
    pictures = [np.stack([(k + x) % 256, (2 * k + y) % 256, 3 * k % 256 + 0 * x], axis=-1).astype(np.uint8) for k in range(VIDEO_FRAMES)]

    def chunk(name: bytes, data: bytes) -> bytes:
        return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)

    head = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", bytes(4), 0, 0, 0, 0, 1, FPS, 0, VIDEO_FRAMES, 0, 0, 0, 0, 0, VIDEO_W, VIDEO_H)
    form = struct.pack("<IiiHH4sIiiII", 40, VIDEO_W, VIDEO_H, 1, 24, b"DIB ", 0, 0, 0, 0, 0)
    whole = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0, VIDEO_FRAMES, 0, 1, 0, VIDEO_W, VIDEO_H, 0, 0, 0, 0)
    headers = b"hdrl" + chunk(b"avih", whole) + chunk(b"LIST", b"strl" + chunk(b"strh", head) + chunk(b"strf", form))
    frames = b"movi" + b"".join(chunk(b"00db", p[::-1, :, ::-1].tobytes()) for p in pictures)
    path = f"{storage.scratch(spark, 'video')}/made.avi"
    storage.write(path, chunk(b"RIFF", b"AVI " + chunk(b"LIST", headers) + chunk(b"LIST", frames)))
    return path


def write_town(spark: SparkSession) -> str:
    """A map of patches of many sizes, and frames of it as a camera above sees them at ``PLACES``."""
    r = np.random.default_rng(0)
    picture = np.full((TOWN_H, TOWN_W, 3), 120.0)
    for _ in range(2500):
        x, y, w, h = r.integers(0, TOWN_W), r.integers(0, TOWN_H), r.integers(4, 30), r.integers(4, 30)
        picture[y : y + h, x : x + w] = r.integers(0, 256, 3)
    folder = storage.scratch(spark, "town")
    storage.write(f"{folder}/map.png", imaging.png(picture.astype(np.uint8)))
    y, x = np.mgrid[0:FRAME_H, 0:FRAME_W]
    for name, (ox, oy) in PLACES.items():
        u, v = (x + 0.5) * SCALE - 0.5 + ox, (y + 0.5) * SCALE - 0.5 + oy
        i, j = np.clip(u.astype(int), 0, TOWN_W - 2), np.clip(v.astype(int), 0, TOWN_H - 2)
        a, b = np.clip(u - i, 0, 1)[..., None], np.clip(v - j, 0, 1)[..., None]
        seen = (1 - b) * ((1 - a) * picture[j, i] + a * picture[j, i + 1]) + b * ((1 - a) * picture[j + 1, i] + a * picture[j + 1, i + 1])
        storage.write(f"{folder}/frames/{name}", imaging.png(np.clip(np.rint(seen), 0, 255).astype(np.uint8)))
    return folder
