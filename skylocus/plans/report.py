"""What a search says of its frames: rankings as rows, a summary for each frame as a JSON document, and both as files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylocus.functions import geometry as G
from skylocus.operators import imaging, matching, scoring, tiling
from skylocus.plans import figures, localize
from skylocus.sources import storage, tables


#: Pixels of the map to each side of the centre in the closer figure.
ZOOM = 700


def candidate(with_footprint: bool = False) -> Column:
    """A candidate as a struct of what a reader wants to know of it."""
    c = F.col
    where = F.when(c("center_x").isNotNull(), F.array(c("center_x"), c("center_y")))
    on_map = F.when(c("center_x").isNotNull(), F.array(c("x_map"), c("y_map")))
    fields = [
        c("tile_id"), F.array(c("x_origin").cast("double"), c("y_origin").cast("double")).alias("tile_origin"), c("passed"), c("score"), c("inliers"), c("matches"),
        scoring.inlier_ratio(c("inliers"), c("matches")).alias("inlier_ratio"), c("reproj_mean"), c("h_scale"), where.alias("center_local"), on_map.alias("center_map"),
        c("gate_reasons"), c("success").alias("success_stage2"), c("h").alias("homography"),
    ]
    if with_footprint:
        corners = G.corners(c("frame_w"), c("frame_h"))
        points = []
        for x, y in corners:
            u, v = G.project(c("h"), x, y)
            points.append(F.array(u + c("x_origin"), v + c("y_origin")))
        fields.append(F.array(*points).alias("footprint_map"))
    return F.struct(*fields)


def summaries(ranked: DataFrame, top_k: int = 5) -> DataFrame:
    """One row for each frame: its ``winner`` (null if none passed) and its margin, the first ``top_k``, counts, and the times of the search.

    Only the candidates that are told of are collected, ``top_k`` for a frame.
    """
    first = ranked.filter((F.col("rank") <= top_k) | (F.col("rank") == 1))
    told = first.groupBy("frame_id").agg(
        F.max(F.when((F.col("rank") == 1) & F.col("passed"), candidate(True))).alias("winner"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= top_k, F.struct("rank", candidate().alias("c"))))), lambda x: x["c"]).alias("top_k"),
    )
    second = ranked.filter("passed AND rank <= 2").groupBy("frame_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    margin = second.select("frame_id", F.when(F.col("second") > 0, F.col("best") / F.when(F.col("second") > 0, F.col("second"))).alias("score_margin_to_runner_up"))
    counts = ranked.groupBy("frame_id").agg(F.count_if("passed").alias("tiles_passed"), F.first("frame_w").alias("frame_w"), F.first("frame_h").alias("frame_h"))
    out = counts.join(told, "frame_id").join(margin, "frame_id", "left").join(scoring.search_timings(ranked, ["frame_id"]), "frame_id")
    return out.withColumn("success", F.col("winner").isNotNull())


def documents(summed: DataFrame) -> DataFrame:
    """``frame_id`` and its summary as JSON text, with nulls where there is nothing to tell."""
    body = F.to_json(F.struct(*[c for c in summed.columns if c != "frame_id"]), {"ignoreNullFields": "false"})
    return summed.select("frame_id", body.alias("document"))


def localize_frame(spark: SparkSession, frame_path: str, tiles_csv: str, tiles_dir: str, matcher: matching.ImageMatcher, rankings_dir: str, output: str,
                   roi_xyxy: tuple[int, int, int, int] | None = None, grid_step: int = 1, top_k: int = 5, cache_dir: str | None = None, run_info: str | None = None,
                   map_path: str | None = None, figure_dir: str | None = None, config: localize.Pipeline = localize.Pipeline(), gate: scoring.Gate = scoring.Gate(), warmup: int = 0) -> dict:
    """Locate one frame's image; writes its ranking (CSV), its summary (JSON) and, with a map, its figure (SVG). Returns the summary.

    Features are taken from a cache where one is named and there; no tiles raise.
    """
    registry = tables.with_ordinal(tables.read_registry(spark, tiles_csv, tables.TILES), "tile_ord", "tile_id")
    pool = tiling.select_tiles(registry, roi_xyxy, grid_step)
    total, checked = registry.count(), pool.count()
    if not checked:
        raise ValueError("no tiles are in the region and the step")
    info = tables.read_run_info(run_info) if run_info else {}
    map_w, map_h = tables.map_size(registry, info)
    cached, used = None, bool(cache_dir) and matcher.supports_feature_cache and storage.exists(f"{cache_dir}/manifest.json")
    if used:
        cached = tables.read_cache(spark, cache_dir, cache_signature(matcher, config, tiles_csv, info), pool)
    frame = imaging.read_images(spark, frame_path).select(F.col("name").alias("image_id"), "width", "height", "rgb")
    tiles = imaging.read_images(spark, f"{tiles_dir}/tile_*.png").select(F.col("name").alias("image_id"), "width", "height", "rgb") if cached is None else None
    if tiles is not None:
        tiles = tiles.join(pool.select(F.col("tile_id").alias("image_id")), "image_id", "left_semi")
    if warmup:
        matcher.warmup((64, 64), (64, 64), warmup)
    ranked = localize.search(frame, tiles, pool, matcher, (map_w, map_h), config, gate, cached).persist()
    stem, name = storage.stem(frame_path), frame_path.rpartition("/")[2]
    storage.make_folder(rankings_dir)
    ranking = f"{rankings_dir}/{stem}_{matcher.name}_candidates.csv"
    tables.write_registry(scoring.candidate_rows(ranked).drop("frame_id"), ranking, "rank")
    found = json.loads(documents(summaries(ranked, top_k)).first()["document"])
    if found["winner"]:
        found["winner"]["score_margin_to_runner_up"] = found.pop("score_margin_to_runner_up")
    times = {k: found.pop(k) for k in ("frame_extract", "tile_extract_sum", "match_sum", "ransac_sum", "per_tile_mean")}
    summary = {
        "created_utc": tables.now(), "git_commit": tables.git_commit(), "frame": name, "frame_size": [found["frame_w"], found["frame_h"]], "matcher": matcher.name,
        "matcher_config": matcher.config(), "pipeline": config.to_dict(), "gate": gate.__dict__,
        "search_space": {"roi_xyxy": roi_xyxy, "grid_step": grid_step, "tiles_checked": checked, "tiles_total": total, "tiles_passed": found["tiles_passed"]},
        "feature_cache": {"used": bool(used), "dir": cache_dir if used else None}, "timings_sec": times, "success": found["success"], "winner": found["winner"],
        "top_k": found["top_k"], "map_size": [map_w, map_h], "units": "pixels of the full map; times in seconds", "environment": tables.environment(spark, matcher.device),
        "candidates_csv": ranking,
    }
    tables.write_json(summary, output)
    if map_path and figure_dir:
        rects = [tuple(r) for r in pool.select("x_origin", "y_origin", "width", "height").collect()]
        passed = [tuple(r) for r in ranked.filter("passed").select("x_origin", "y_origin", "width", "height").collect()]
        text = figures.located(rects, passed, summary["winner"], (map_w, map_h), view=roi_xyxy, title=f"{name} | {matcher.name}")
        storage.write(f"{figure_dir}/{stem}_global_loc.svg", text.encode())
        if summary["winner"]:
            x, y = summary["winner"]["center_map"]
            near = (x - ZOOM, y - ZOOM, x + ZOOM, y + ZOOM)
            text = figures.located(rects, passed, summary["winner"], (map_w, map_h), view=near, title=f"{name} | {matcher.name}")
            storage.write(f"{figure_dir}/{stem}_global_loc_zoom.svg", text.encode())
    ranked.unpersist()
    return summary


def cache_signature(matcher: matching.ImageMatcher, config: localize.Pipeline, tiles_csv: str, info: dict) -> dict:
    return tables.signature(matcher.config(), config.work_scale, storage.sha256(tiles_csv), info.get("map_sha256"))


def build_cache(spark: SparkSession, tiles_csv: str, tiles_dir: str, folder: str, matcher: matching.ImageMatcher, run_info: str | None = None,
                config: localize.Pipeline = localize.Pipeline(), overwrite: bool = False) -> dict:
    """Extract the features of all tiles of a registry and keep them; returns the manifest. A matcher whose features can't be kept raises."""
    if not matcher.supports_feature_cache:
        raise ValueError(f"features of {matcher.name} can't be kept")
    registry = tables.read_registry(spark, tiles_csv, tables.TILES)
    images = imaging.read_images(spark, f"{tiles_dir}/tile_*.png").select(F.col("name").alias("image_id"), "width", "height", "rgb")
    wanted = images.join(registry.select(F.col("tile_id").alias("image_id")), "image_id", "left_semi")
    sign = cache_signature(matcher, config, tiles_csv, tables.read_run_info(run_info) if run_info else {})
    return tables.write_cache(matching.extract(wanted, matcher, config.work_scale), folder, sign, overwrite, matcher.device, tiles_csv)
