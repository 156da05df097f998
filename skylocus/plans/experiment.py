"""Experiments: pairs of images by several matchers, their flat rows, and the summaries of these."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylocus.operators import homography, imaging, matching, scoring
from skylocus.plans import figures, localize
from skylocus.sources import storage, tables

TIMES = ["time_extract_frame", "time_extract_tile", "time_match", "time_matcher_total", "time_ransac"]
KEYS = ["pair_id", "method", "frame", "tile", "scene_type", "repeats"]
MEANS = ["matches", "inliers", "inlier_ratio", *TIMES]
MEDIANS, SUCCESS_MEANS = ["inliers", "time_matcher_total"], ["reproj_mean", "reproj_median", "h_scale"]


def _numbered(images: DataFrame, repeats: int) -> DataFrame:
    """Each image as often as it is matched anew, known by its id and the repeat."""
    out = images.withColumn("__run", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return out.withColumn("image_id", F.concat_ws("#", "image_id", "__run")).drop("__run")


def match_pairs(pairs: DataFrame, frames: DataFrame, tiles: DataFrame, matcher: matching.ImageMatcher, config: localize.Pipeline = localize.Pipeline(), repeats: int = 1) -> DataFrame:
    """The matches of ``pairs`` (``pair_id``, ``frame``, ``tile``, ``scene_type``), as often as each is repeated (``run``); images are extracted for every repeat."""
    again = pairs.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    again = again.withColumns({"frame_id": F.concat_ws("#", "frame", "run"), "tile_id": F.concat_ws("#", "tile", "run")})
    matched = matching.match(again, matching.extract(_numbered(frames, repeats), matcher, config.frame_scale), matching.extract(_numbered(tiles, repeats), matcher, config.work_scale), matcher, guarded=True)
    # seeds and the registry go by the pair, not by the repeat
    return matched.withColumns({"frame_id": F.col("frame"), "tile_id": F.col("tile")})


def rows_of(matched: DataFrame, registry: DataFrame, method: str, config: localize.Pipeline = localize.Pipeline()) -> DataFrame:
    """A row for each pair of ``match_pairs``: ``KEYS`` and the pair's flat row.

    Times are medians over the repeats, all else is the first repeat's. A pair that failed
    with an error is a row without success, scene, repeats and figures.
    """
    verified = localize.verify(matched, registry, (F.col("frame_w"), F.col("frame_h")), config)
    flat = scoring.pair_rows(verified, ["pair_id", "frame", "tile", "scene_type", "run", "error"])
    rest = [c for c in [*KEYS, *scoring.PAIR_ROW] if c in flat.columns and c not in (*TIMES, "pair_id")]
    rows = scoring.timing_medians(flat, ["pair_id"], TIMES, "run", [*rest, "error"])
    rows = rows.withColumnsRenamed({f"{t}_median": t for t in TIMES}).withColumns({"repeats": F.col("repeats").cast("int"), "method": F.lit(method)})
    failed = F.col("error").isNotNull()
    kept = ("pair_id", "method", "frame", "tile")
    made = {"success": F.col("success") & ~failed, "failure_reason": F.coalesce("error", "failure_reason")}
    return rows.select(*[(made[c] if c in made else F.col(c) if c in kept else F.when(~failed, F.col(c))).alias(c) for c in [*KEYS, *scoring.PAIR_ROW]])


def write_figures(matched: DataFrame, registry: DataFrame, method: str, folder: str, map_wh: tuple[int, int], config: localize.Pipeline = localize.Pipeline()) -> int:
    """The figures of each pair's first repeat, in a folder of its own; returns how many files. Pairs come one after the other: an experiment is a list made by hand."""
    first = matched.filter("run = 1 AND error IS NULL")
    found = localize.verify(first, registry, (F.col("frame_w"), F.col("frame_h")), config, with_mask=True).join(first.select("pair_id", *homography.POINTS), "pair_id")
    n = 0
    for row in found.toLocalIterator():
        for name, text in figures.of_pair(row.asDict(), map_wh, method).items():
            storage.write(f"{folder}/pair_{row['pair_id']:03d}/{name}", text.encode())
            n += 1
    return n


def union(parts: list[DataFrame]) -> DataFrame:
    """The rows of several methods; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def images(spark: SparkSession, folder: str, names: DataFrame, name: str) -> DataFrame:
    """The named image files of a folder, each read once; one that is missing raises."""
    wanted = names.select(F.col(name).alias("image_id")).distinct()
    found = imaging.read_images(spark, folder).select(F.col("name").alias("image_id"), "width", "height", "rgb")
    missing = wanted.join(found.select("image_id"), "image_id", "left_anti").first()
    if missing:
        raise FileNotFoundError(f"{folder} has no {missing[0]}")
    return found.join(wanted, "image_id", "left_semi")


def evaluate(spark: SparkSession, pairs_csv: str, tiles_csv: str, frames_dir: str, tiles_dir: str, output: str, methods: list[str],
             config: localize.Pipeline = localize.Pipeline(), repeats: int = 1, warmup: int = 0, device: str = "cpu", figures_dir: str | None = None) -> DataFrame:
    """Run an experiment; writes its rows to the CSV ``output``, its record beside it, and figures if a folder is named. Returns the rows as written."""
    pairs, registry = tables.read_registry(spark, pairs_csv, tables.EVAL_PAIRS), tables.read_registry(spark, tiles_csv, tables.TILES)
    frames, tiles = images(spark, frames_dir, pairs, "frame"), images(spark, tiles_dir, pairs, "tile")
    matchers = [matching.create(m, device) for m in methods]
    for m in matchers:
        m.warmup((64, 64), (64, 64), warmup)
    matched = {m.name: match_pairs(pairs, frames, tiles, m, config, repeats).persist() for m in matchers}
    rows = union([rows_of(found, registry, name, config) for name, found in matched.items()])
    tables.write_registry(rows.orderBy("method", "pair_id"), output)
    for name, found in matched.items():
        if figures_dir:
            write_figures(found, registry, name, figures_dir, tables.map_size(registry), config)
        found.unpersist()
    tables.write_json({
        "created_utc": tables.now(), "git_commit": tables.git_commit(), "pairs": pairs_csv, "methods": methods, "repeats": repeats, "warmup": warmup,
        "pipeline": config.to_dict(), "matchers": {m.name: m.config() for m in matchers}, "environment": tables.environment(spark, device),
        "units": "all distances in full-map pixels; times in seconds",
    }, f"{output.removesuffix(storage.suffix(output))}_info.json")
    return read_results(spark, output)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """An experiment's CSV. Flags and numbers are read as such, empty fields as nulls."""
    kinds = {"pair_id": "int", "repeats": "int", "success": "boolean", "h_plausible": "boolean"}
    text = ("method", "frame", "tile", "scene_type", "failure_reason")
    whole = ("frame_work_w", "frame_work_h", "tile_work_w", "tile_work_h", "keypoints_frame", "keypoints_tile", "matches", "inliers")
    schema = ", ".join(f"{c} {'string' if c in text else 'long' if c in whole else kinds.get(c, 'double')}" for c in [*KEYS, *scoring.PAIR_ROW])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """``pairs``, ``success_rate``, means and medians over all rows of a key, and means over the successes."""
    out = scoring.summarize(rows, by, MEANS, MEDIANS, SUCCESS_MEANS)
    renamed = {"runs": "pairs", **{f"{c}_mean": f"mean_{c}" for c in MEANS}, **{f"{c}_median": f"median_{c}" for c in MEDIANS},
               **{f"{c}_success_mean": f"mean_{c}_success" for c in SUCCESS_MEANS}}
    return out.withColumnsRenamed(renamed)


def summarize(spark: SparkSession, results: str, folder: str) -> list[str]:
    """Write the summary by method, and that by scene and method if any row has a scene; returns the files."""
    rows, stem = read_results(spark, results), storage.stem(results)
    storage.make_folder(folder)
    made = [f"{folder}/{stem}_summary.csv"]
    tables.write_registry(summary(rows, ["method"]).orderBy("method"), made[0])
    if not rows.filter("scene_type IS NOT NULL").isEmpty():
        made.append(f"{folder}/{stem}_by_scene.csv")
        tables.write_registry(summary(rows, ["scene_type", "method"]).orderBy("scene_type", "method"), made[1])
    return made
