"""Maps to tiles and videos to frames: files, registry and a record of the run; and whether they still fit together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylocus.operators import imaging, integrity, tiling
from skylocus.sources import storage, tables, video

TILE_FILES, FRAME_FILES = "tile_*.png", "frame_*.png"


def grid_record(tiles: DataFrame) -> DataFrame:
    """One row: ``tile_count``, ``grid_cols``, ``grid_rows``, and the sorted origins on either axis, of which a map has few."""
    origins = lambda c: F.sort_array(F.collect_set(c))
    out = tiles.agg(F.count(F.lit(1)).alias("tile_count"), origins("x_origin").alias("x_origins"), origins("y_origin").alias("y_origins"))
    return out.select("tile_count", F.size("x_origins").alias("grid_cols"), F.size("y_origins").alias("grid_rows"), "x_origins", "y_origins")


def prepare_map(spark: SparkSession, map_path: str, folder: str, registry: str, run_info: str | None = None, size: int = 512, overlap: float = 0.5,
                roi_xywh: tuple[int, int, int, int] | None = None, background: tuple[int, int, int] = (255, 255, 255), clean: bool = True, root: str = ".") -> DataFrame:
    """Cut a map into tile files; returns their registry, written last but for the run's record."""
    image = imaging.read_images(spark, map_path, background)
    head = image.drop("rgb", "origin", "name").first()
    tiles = tiling.grid(spark, head["width"], head["height"], size, overlap, roi_xywh)
    if clean:
        storage.clean(folder, TILE_FILES)
    written = imaging.write_files(imaging.with_png(imaging.crops(tiles, image)), folder, "tile_id").count()
    if written != tiles.count():
        raise RuntimeError(f"{written} tiles were written")
    tables.write_registry(tiles, registry, "tile_ord")
    if run_info:
        made = grid_record(tiles).first().asDict()
        tables.write_json({
            "created_utc": tables.now(), "map_path": storage.portable(map_path, root), "map_sha256": storage.sha256(map_path),
            "map_width": head["width"], "map_height": head["height"], "source_channels": head["source_channels"], "had_alpha": head["had_alpha"],
            "alpha_fully_opaque": head["alpha_fully_opaque"], "alpha_background_rgb": list(background), "roi_xywh": list(roi_xywh) if roi_xywh else None,
            "tile_size": size, "overlap": overlap, "stride": tiling.stride(size, overlap), **made, "tiles_dir": storage.portable(folder, root),
            "coordinate_convention": "(x, y) = (column, row), map pixels, origin top-left", "tile_order": "row-major, index starts at 1",
        }, run_info)
    return tiles


def prepare_frames(spark: SparkSession, video_path: str, folder: str, registry: str, run_info: str | None = None, target_fps: float | None = 1.0, every_n: int | None = None,
                   limit: int | None = None, start_sec: float = 0.0, clean: bool = True, stage: str | None = None, root: str = ".") -> DataFrame:
    """Sample a video's frames into files; returns their registry, written last but for the run's record. No frames raise."""
    if not storage.exists(video_path):
        raise FileNotFoundError(f"there is no video {video_path}")
    frames, head = video.sampled(spark, video_path, target_fps, every_n, start_sec, limit)
    if clean:
        storage.clean(folder, FRAME_FILES)
    stage = stage or f"{folder}/.stage"
    storage.clean(stage, "*.jpg")
    written = imaging.write_files(imaging.with_png(video.decoded(spark, frames, stage).withColumnRenamed("image_id", "frame_id")), folder, "frame_id").count()
    storage.clean(stage, "*.jpg")
    if not written:
        raise RuntimeError(f"no frames were sampled from {video_path}")
    rows = frames.select("frame_ord", "frame_id", "source_frame_idx", "timestamp_sec", "width", "height")
    tables.write_registry(rows, registry, "frame_ord")
    if run_info:
        last = rows.agg(F.max("source_frame_idx")).first()[0]
        total = head["frame_count_header"] if limit is None or written < limit else last + 1
        names = ("fps", "frame_count_header", "width", "height", "fourcc", "duration_sec_header")
        tables.write_json({
            "created_utc": tables.now(), "video_path": storage.portable(video_path, root), **{f"video_{k}": head[k] for k in names}, "frames_decoded": total,
            "target_fps": target_fps if every_n is None else None, "every_n": head["step"], "effective_fps": head["fps"] / head["step"] if head["fps"] > 0 else None,
            "start_sec": start_sec, "limit": limit, "frame_count": written, "frames_dir": storage.portable(folder, root),
            "color_space": "RGB in memory, PNG on disk (lossless)", "frame_order": "chronological, index starts at 1",
        }, run_info)
    return rows


def _listing(spark: SparkSession, folder: str, pattern: str, name: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in storage.names(folder, pattern)], f"{name} string")


def check_tiles(spark: SparkSession, map_path: str, folder: str, registry: str, run_info: str | None = None, background: tuple[int, int, int] = (255, 255, 255),
                sample: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Violations of a map's tiles (registry, coverage, count, files, pixels), and one row of figures."""
    rows = tables.read_registry(spark, registry, tables.TILES)
    info = tables.read_run_info(run_info) if run_info else {}
    image = imaging.read_images(spark, map_path, background)
    width, height = image.select("width", "height").first()
    size = info.get("tile_size")
    found = [integrity.columns(rows, "tiles"), integrity.tiles(rows, width, height, size)]
    if info.get("map_sha256") and info["map_sha256"] != storage.sha256(map_path):
        found.append(integrity.one(spark, "map_changed", map_path))
    x0, y0, w, h = info.get("roi_xywh") or (0, 0, width, height)
    inside = rows.withColumns({"x_origin": F.col("x_origin") - x0, "y_origin": F.col("y_origin") - y0})
    covered = tiling.coverage(inside, w, h)
    found.append(integrity.uncovered(covered))
    if size and info.get("overlap") is not None:
        step = tiling.stride(size, info["overlap"])
        found.append(integrity.count_is(rows, tiling.count(w, size, step) * tiling.count(h, size, step)))
    found.append(integrity.files(rows, _listing(spark, folder, TILE_FILES, "tile_id"), "tile_id"))
    looked_at = rows if sample is None else integrity.sampled(rows, "tile_id", sample, seed)
    whole = looked_at.filter(f"x_origin >= 0 AND y_origin >= 0 AND x_origin + width <= {width} AND y_origin + height <= {height}")
    checked = spark.createDataFrame([], "tile_id string, channels int, file_w int, file_h int, max_abs_diff int")
    if storage.names(folder, TILE_FILES):
        checked = imaging.differences(imaging.crops(whole, image), imaging.read_raw(spark, f"{folder}/{TILE_FILES}"))
    found.append(integrity.pixels(checked, "tile_id"))
    figures = rows.agg(F.count(F.lit(1)).alias("tiles"), F.count_distinct("x_origin").alias("cols"), F.count_distinct("y_origin").alias("rows"))
    return integrity.union(found), figures.crossJoin(covered.select("min_cover", "max_cover")).crossJoin(checked.agg(F.count(F.lit(1)).alias("pixel_checked")))


def check_frames(spark: SparkSession, folder: str, registry: str, run_info: str | None = None, size: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Violations of a video's frames (registry, steps and times, files, their channels and sizes), and one row of figures."""
    rows = tables.read_registry(spark, registry, tables.FRAMES)
    info = tables.read_run_info(run_info) if run_info else {}
    ordered = tables.with_ordinal(rows, "frame_ord", "frame_id").withColumn("video", F.lit(""))
    found = [integrity.columns(rows, "frames"), integrity.duplicates(rows, ["frame_id"], "duplicate_id")]
    found.append(integrity.frames(ordered, info.get("video_fps"), info.get("every_n")))
    if size:
        found.append(integrity.sizes(rows, "frame_id", *size))
    on_disk = _listing(spark, folder, FRAME_FILES, "frame_id")
    found.append(integrity.files(rows, on_disk, "frame_id"))
    checked = 0
    if storage.names(folder, FRAME_FILES):
        files = imaging.read_raw(spark, f"{folder}/{FRAME_FILES}").drop("pixels")
        checked = rows.join(on_disk, "frame_id", "left_semi").count()
        found.append(integrity.image_files(rows, files, "frame_id"))
    return integrity.union(found), integrity.frame_figures(ordered).withColumn("images_checked", F.lit(checked))
