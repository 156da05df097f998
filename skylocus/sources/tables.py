"""Registries as CSV with fixed schemas, run information as JSON, and the feature cache as Parquet with a signature."""

from __future__ import annotations

import json
import platform
import subprocess
import time
import uuid
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylocus.sources import storage

TILES = "tile_id string, x_origin int, y_origin int, width int, height int"
FRAMES = "frame_id string, source_frame_idx int, timestamp_sec double, width int, height int"
EVAL_PAIRS = "pair_id int, frame string, tile string, scene_type string"
FORMAT_VERSION = 1


def read_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV registry; a header with other names or another order raises."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def with_ordinal(registry: DataFrame, name: str, key: str) -> DataFrame:
    """Add the number in a registry's ids: rows have no order in Spark, and ties need one."""
    return registry.withColumn(name, F.regexp_extract(key, r"_(\d+)\.", 1).cast("long"))


def write_registry(rows: DataFrame, path: str, order: str | None = None) -> None:
    """Replace a registry, one CSV file: readers see the old one or the new one.

    Spark writes a folder beside it, whose one file is moved over the old. A registry's
    rows are in ``order`` in it, which makes one sorted partition of them: a row for each
    tile of a map or frame of a video.
    """
    rows = rows.coalesce(1) if order is None else rows.orderBy(order).drop(order).coalesce(1)
    folder = f"{path}.{uuid.uuid4().hex}.tmp"
    rows.write.option("header", True).csv(folder)
    system, at = storage.resolve(path)
    _, made = storage.resolve(folder)
    system.move(f"{made}/{storage.names(folder, 'part-*.csv')[0]}", at)
    system.delete_dir(made)


def write_json(document: dict, path: str) -> None:
    """Replace a JSON document."""
    storage.write(path, json.dumps(document, ensure_ascii=False, indent=2).encode())


def read_run_info(path: str) -> dict:
    """A run's JSON document; none where there is no file."""
    return json.loads(storage.read(path)) if storage.exists(path) else {}


def map_size(tiles: DataFrame, run_info: dict | None = None) -> tuple[int, int]:
    """The map's size as the run information says, or the tiles' extent."""
    if run_info and "map_width" in run_info and "map_height" in run_info:
        return int(run_info["map_width"]), int(run_info["map_height"])
    row = tiles.agg(F.max(F.col("x_origin") + F.col("width")), F.max(F.col("y_origin") + F.col("height"))).first()
    return row[0], row[1]


def file_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def signature(matcher: dict, work_scale: float, tiles_sha256: str, map_sha256: str | None) -> dict:
    """What features depend on; the device isn't part of it."""
    kept = {k: v for k, v in matcher.items() if k != "device"}
    return {"format_version": FORMAT_VERSION, "matcher": kept, "work_scale": work_scale, "tiles_sha256": tiles_sha256, "map_sha256": map_sha256}


def _manifest(spark: SparkSession, folder: str) -> dict | None:
    return read_run_info(f"{folder}/manifest.json") or None


def now() -> str:
    """The time in UTC, in ISO form, to the second."""
    return datetime.now(UTC).isoformat(timespec="seconds")


def environment(spark: SparkSession, device: str = "cpu") -> dict:
    """Where a run took place."""
    return {"device": device, "spark": spark.version, "master": spark.sparkContext.master, "python": platform.python_version(), "platform": platform.platform()}


def git_commit(folder: str = ".") -> str | None:
    """The short commit of a folder's repository, with ``-dirty`` after it if anything has changed; None where there is none."""
    run = lambda *a: subprocess.run(["git", *a], cwd=folder, capture_output=True, text=True, check=True).stdout.strip()
    try:
        return run("rev-parse", "--short", "HEAD") + ("-dirty" if run("status", "--porcelain") else "")
    except (OSError, subprocess.CalledProcessError):
        return None


def write_cache(features: DataFrame, folder: str, sign: dict, overwrite: bool = False, device: str = "cpu", tiles_csv: str | None = None) -> dict:
    """Write features (``matching.FEATURES``) and their manifest. Another signature is refused unless ``overwrite``; no features raise."""
    spark = features.sparkSession
    old = _manifest(spark, folder)
    if old and old["signature"] != sign and not overwrite:
        raise RuntimeError(f"{folder} has features with another signature")
    began = time.perf_counter()
    features.write.mode("overwrite").parquet(f"{folder}/features")
    wall = time.perf_counter() - began
    row = cache_summary(spark.read.parquet(f"{folder}/features")).first().asDict()
    if not row["tiles"]:
        raise ValueError("there are no tiles to keep features of")
    known = None not in (row["least"], row["mean"], row["most"]) and row["counted"] == row["tiles"]
    system, path = storage.resolve(f"{folder}/features")
    manifest = {
        "created_utc": now(), "signature": sign, "tiles_csv": tiles_csv, "tiles": row["tiles"], "device": device,
        "keypoints": {"min": row["least"], "mean": row["mean"], "max": row["most"]} if known else None,
        "extract_time_sec": {"total": row["seconds"], "mean": row["seconds"] / row["tiles"]}, "wall_time_sec": wall,
        "size_bytes": sum(f.size for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".parquet")),
    }
    write_json(manifest, f"{folder}/manifest.json")
    return manifest


def cache_summary(features: DataFrame) -> DataFrame:
    """One row: how many features there are, the least, mean and most keypoints, how many have a number of them, and the seconds they took."""
    n = F.col("n_keypoints")
    return features.agg(
        F.count(F.lit(1)).alias("tiles"), F.count(n).alias("counted"), F.min(n).alias("least"), F.avg(n).alias("mean"), F.max(n).alias("most"),
        F.coalesce(F.sum("time_extract"), F.lit(0.0)).alias("seconds"),
    )


def read_cache(spark: SparkSession, folder: str, sign: dict, tiles: DataFrame) -> DataFrame:
    """The features of ``tiles``; no cache, another signature or a tile without features raise."""
    manifest = _manifest(spark, folder)
    if manifest is None:
        raise FileNotFoundError(f"{folder} has no feature cache")
    if manifest["signature"] != sign:
        raise RuntimeError(f"{folder} has features with another signature")
    features = spark.read.parquet(f"{folder}/features")
    wanted = tiles.select(F.col("tile_id").alias("image_id")).distinct()
    missing = wanted.join(features.select("image_id"), "image_id", "left_anti").first()
    if missing:
        raise FileNotFoundError(f"{folder} lacks {missing[0]}")
    return features.join(wanted, "image_id", "left_semi")
