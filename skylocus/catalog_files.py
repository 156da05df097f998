"""Queries of the engine that write files into the shared folder and read them back: made pictures, a map, a video, results."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylocus.catalog import _RANKED, _SUMMARY, _evaluated, query
from skylocus.operators import imaging, integrity, matching, scoring, tiling
from skylocus.plans import bindings as B
from skylocus.plans import experiment, localize, made, prepare
from skylocus.sources import storage, tables, video

_W, _H, _T = made.MAP_W, made.MAP_H, made.TILE
_STEP = _T // 2


def _sums(images, key):
    """The sums of each channel over an image's pixels; pixels are taken apart in SQL."""
    at = lambda k: F.conv(F.hex(F.substring("rgb", F.col("i") * 3 + k + 1, F.lit(1))), 16, 10).cast("long")
    rows = images.withColumn("i", F.explode(F.expr("sequence(0, width * height - 1)")))
    return rows.groupBy(key).agg(*[F.sum(at(k)).alias(c) for k, c in enumerate(("red", "green", "blue"))])


#: The map's pixels on white, tile by tile.
_TILES = f"""px AS (SELECT x, y, (7 * x + 3 * y) % 256 AS r, x * y % 256 AS g, (x + 2 * y) % 256 AS b, (255 - (x + y) % 3 * 60) / 255e0 AS a FROM range({_W}) t(x), range({_H}) u(y)),
mixed AS (SELECT x, y, round_even(a * r + (1 - a) * 255, 0) AS r, round_even(a * g + (1 - a) * 255, 0) AS g, round_even(a * b + (1 - a) * 255, 0) AS b FROM px),
xs AS (SELECT row_number() OVER (ORDER BY x0) - 1 AS i, x0 FROM (SELECT DISTINCT least(k * {_STEP}, {_W - _T}) AS x0 FROM range({tiling.count(_W, _T, _STEP)}) t(k))),
ys AS (SELECT row_number() OVER (ORDER BY y0) - 1 AS j, y0 FROM (SELECT DISTINCT least(k * {_STEP}, {_H - _T}) AS y0 FROM range({tiling.count(_H, _T, _STEP)}) t(k))),
cut AS (SELECT printf('tile_%04d.png', j * {tiling.count(_W, _T, _STEP)} + i + 1) AS tile_id, x0, y0 FROM xs, ys)"""


def _tiled(spark):
    folder = made.write_map(spark)
    prepare.prepare_map(spark, f"{folder}/map.png", f"{folder}/tiles", f"{folder}/tiles.csv", f"{folder}/tiles.json", _T)
    return folder


@query(f"""WITH {_TILES} SELECT tile_id, x0 AS x_origin, y0 AS y_origin, CAST(sum(r) AS BIGINT) AS red, CAST(sum(g) AS BIGINT) AS green, CAST(sum(b) AS BIGINT) AS blue
 FROM cut JOIN mixed ON x >= x0 AND x < x0 + {_T} AND y >= y0 AND y < y0 + {_T} GROUP BY tile_id, x0, y0""")
def map_tiles(spark, sf_dir):
    """A map with alpha cut into tile files, and the files read back."""
    folder = _tiled(spark)
    files = imaging.read_images(spark, f"{folder}/tiles").withColumnRenamed("name", "tile_id")
    return tables.read_registry(spark, f"{folder}/tiles.csv", tables.TILES).select("tile_id", "x_origin", "y_origin").join(_sums(files, "tile_id"), "tile_id")


@query(f"""SELECT 4 AS channels, {_W} AS width, {_H} AS height, false AS opaque, CAST({_W * _H} * 4 AS BIGINT) AS n_bytes, CAST(sum((x + 2 * y) % 256) AS BIGINT) AS blue_first FROM range({_W}) t(x), range({_H}) u(y)""")
def raw_scan(spark, sf_dir):
    """A picture as decoded: channels, and the bytes in the decoder's order."""
    raw = imaging.read_raw(spark, f"{made.write_map(spark)}/map.png")
    first = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(_W * _H - 1)), lambda i: F.conv(F.hex(F.substring("pixels", i * 4 + 1, F.lit(1))), 16, 10).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return raw.select("channels", "width", "height", F.col("alpha_fully_opaque").alias("opaque"), F.octet_length("pixels").cast("long").alias("n_bytes"), first.alias("blue_first"))


@query(f"""SELECT {_W} AS map_width, {_H} AS map_height, {_T} AS tile_size, {_STEP} AS stride, CAST({tiling.count(_W, _T, _STEP) * tiling.count(_H, _T, _STEP)} AS BIGINT) AS tile_count, true AS had_alpha, true AS hash_is_the_files, {_W} AS extent""")
def tiling_record(spark, sf_dir):
    """A tiling's JSON record, read back, and the map's size from it and from the tiles."""
    folder = _tiled(spark)
    info = tables.read_run_info(f"{folder}/tiles.json")
    registry = tables.read_registry(spark, f"{folder}/tiles.csv", tables.TILES)
    same = info["map_sha256"] == tables.file_hash(spark, f"{folder}/map.png")
    row = (*tables.map_size(registry, info), info["tile_size"], info["stride"], info["tile_count"], info["had_alpha"], same, tables.map_size(registry)[0])
    return spark.createDataFrame([row], "map_width int, map_height int, tile_size int, stride int, tile_count long, had_alpha boolean, hash_is_the_files boolean, extent int")


@query("""SELECT * FROM (VALUES ('missing', 'tile_0002.png'), ('stale', 'tile_0999.png'), ('pixels', 'tile_0003.png'), ('channels', 'tile_0004.png'), ('file_size', 'tile_0005.png')) v("check", subject)""")
def damaged_tiles(spark, sf_dir):
    """What the check of a tiling finds where files are missing, stale, or of other pixels, channels and sizes."""
    folder = _tiled(spark)
    tiles = f"{folder}/tiles"
    first = storage.read(f"{tiles}/tile_0001.png")
    storage.clean(tiles, "tile_0002.png")
    for name in ("tile_0999.png", "tile_0003.png"):
        storage.write(f"{tiles}/{name}", first)
    storage.write(f"{tiles}/tile_0004.png", imaging.png(made.map_pixels()[:_T, :_T, 0]))
    storage.write(f"{tiles}/tile_0005.png", imaging.png(made.map_pixels()[: _T - 1, :_T, :3].copy()))
    return prepare.check_tiles(spark, f"{folder}/map.png", tiles, f"{folder}/tiles.csv", f"{folder}/tiles.json")[0]


_N = made.VIDEO_FRAMES


@query(f"""SELECT {made.FPS}e0 AS fps, CAST({_N} AS BIGINT) AS frame_count_header, {made.VIDEO_W} AS width, {made.VIDEO_H} AS height, 'DIB' AS codec, round({_N} / {made.FPS}e0, 6) AS seconds, f AS target_fps,
 CAST(floor({_N} / {made.FPS}e0 * f) AS BIGINT) AS frames FROM (VALUES (1), (2), (5), (10)) v(f)""")
def video_audit(spark, sf_dir):
    """A video's header and about how many frames it gives at some rates."""
    path = video.default_video(made.write_video(spark).rpartition("/")[0])
    headers = video.probe(spark.createDataFrame([(path,)], "video string"))
    out = video.audit(headers).join(headers.select("video", F.trim("fourcc").alias("codec")), "video")
    return out.select("fps", "frame_count_header", "width", "height", "codec", F.round("duration_sec", 6).alias("seconds"), "target_fps", "frames")


@query(f"""WITH k AS (SELECT n, 15 + 10 * (n - 1) AS k FROM range(1, 6) t(n)) SELECT printf('frame_%04d.png', n) AS frame_id, k AS source_frame_idx, round_even(k / {made.FPS}e0, 6) AS timestamp_sec,
 CAST(sum((k + x) % 256) AS BIGINT) AS red, CAST(sum((2 * k + y) % 256) AS BIGINT) AS green, CAST(sum(3 * k % 256) AS BIGINT) AS blue FROM k, range({made.VIDEO_W}) t(x), range({made.VIDEO_H}) u(y) GROUP BY n, k""")
def video_frames(spark, sf_dir):
    """Five frames of a video from half a second on, three a second, as files that are read back."""
    path = made.write_video(spark)
    folder = path.rpartition("/")[0]
    prepare.prepare_frames(spark, path, f"{folder}/frames", f"{folder}/frames.csv", f"{folder}/frames.json", target_fps=3.0, start_sec=0.5, limit=5)
    files = imaging.read_images(spark, f"{folder}/frames").withColumnRenamed("name", "frame_id")
    registry = tables.read_registry(spark, f"{folder}/frames.csv", tables.FRAMES).select("frame_id", F.col("source_frame_idx").cast("long").alias("source_frame_idx"), "timestamp_sec")
    return registry.join(_sums(files, "frame_id"), "frame_id")


@query(f"""SELECT {made.FPS}e0 AS video_fps, 10 AS every_n, 3e0 AS effective_fps, CAST({_N} AS BIGINT) AS frames_decoded, 8 AS frame_count, CAST(0 AS BIGINT) AS violations, round(70 / {made.FPS}e0, 6) AS span_sec""")
def extraction_record(spark, sf_dir):
    """The JSON record of a frame extraction, read back, and what the check of the frames says."""
    path = made.write_video(spark)
    folder = path.rpartition("/")[0]
    prepare.prepare_frames(spark, path, f"{folder}/frames", f"{folder}/frames.csv", f"{folder}/frames.json", target_fps=3.0, start_sec=0.5)
    info = tables.read_run_info(f"{folder}/frames.json")
    violations, figures = prepare.check_frames(spark, f"{folder}/frames", f"{folder}/frames.csv", f"{folder}/frames.json", (made.VIDEO_W, made.VIDEO_H))
    row = (info["video_fps"], info["every_n"], info["effective_fps"], info["frames_decoded"], info["frame_count"], integrity.report(violations)[1], round(figures.first()["span_sec"], 6))
    return spark.createDataFrame([row], "video_fps double, every_n int, effective_fps double, frames_decoded long, frame_count int, violations long, span_sec double")


def _middle(place):
    """A frame's centre on the map, by its first pixel's place."""
    return tuple((side / 2) * made.SCALE - 0.5 + o for side, o in zip((made.FRAME_W, made.FRAME_H), place, strict=True))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', true, true, true)" for n in made.PLACES) + ") v(frame_id, passed, within_two_pixels, scale_is_known)")
def located_from_pixels(spark, sf_dir):
    """Frames of a made town located from their pixels: features, matches, homographies, gate, rank; nothing is known but the pictures."""
    folder = made.write_town(spark)
    prepare.prepare_map(spark, f"{folder}/map.png", f"{folder}/tiles", f"{folder}/tiles.csv", None, 256)
    registry = tables.with_ordinal(tables.read_registry(spark, f"{folder}/tiles.csv", tables.TILES), "tile_ord", "tile_id")
    images = lambda path: imaging.read_images(spark, path).select(F.col("name").alias("image_id"), "width", "height", "rgb")
    ranked = localize.search(images(f"{folder}/frames"), images(f"{folder}/tiles"), registry, matching.create("corners"), (made.TOWN_W, made.TOWN_H))
    best = ranked.filter("rank = 1")
    known = spark.createDataFrame([(n, *_middle(p)) for n, p in made.PLACES.items()], "frame_id string, x double, y double")
    near = (F.abs(F.col("x_map") - F.col("x")) < 2) & (F.abs(F.col("y_map") - F.col("y")) < 2)
    return best.join(known, "frame_id").select("frame_id", "passed", near.alias("within_two_pixels"), (F.abs(F.col("h_scale") - made.SCALE) < 0.01).alias("scale_is_known"))


def _results(spark, sf_dir):
    """The runs as an experiment's rows."""
    rows = B.runs(spark, sf_dir).withColumns({"frame": F.col("frame").cast("string"), "tile": F.lit("t"), "repeats": F.lit(1), "time_matcher_total": F.col("time_total"), "inliers": F.col("inliers").cast("long")})
    missing = [c for c in [*experiment.KEYS, *scoring.PAIR_ROW] if c not in rows.columns]
    return rows.withColumns({c: F.lit(None).cast("string") for c in missing}).select(*experiment.KEYS, *scoring.PAIR_ROW)


@query(f"WITH {B.RUNS} SELECT pair_id, method, scene_type, success, inliers, time_total AS time_matcher_total, reproj_mean FROM runs")
def results_csv(spark, sf_dir):
    """An experiment's rows written as CSV and read back: numbers, flags and nulls as they were."""
    path = f"{storage.scratch(spark, 'results')}/results.csv"
    storage.make_folder(path.rpartition("/")[0])
    tables.write_registry(_results(spark, sf_dir), path)
    return experiment.read_results(spark, path).select(F.col("pair_id").cast("long").alias("pair_id"), "method", "scene_type", "success", "inliers", "time_matcher_total", "reproj_mean")


@query(f"""WITH {B.RUNS}, s AS (SELECT scene_type, method, {_SUMMARY} FROM runs WHERE scene_type IS NOT NULL GROUP BY scene_type, method UNION ALL SELECT NULL, method, {_SUMMARY} FROM runs GROUP BY method)
SELECT scene_type, method, runs AS pairs, success_rate, inliers_mean AS mean_inliers, inliers_median AS median_inliers, time_total_median AS median_time_matcher_total, reproj_mean_success_mean AS mean_reproj_mean_success FROM s""")
def summary_csv(spark, sf_dir):
    """An experiment's two summaries written as CSV and read back."""
    folder = storage.scratch(spark, "summary")
    storage.make_folder(folder)
    tables.write_registry(_results(spark, sf_dir), f"{folder}/results.csv")
    by_method, by_scene = (spark.read.option("header", True).option("inferSchema", True).csv(p) for p in experiment.summarize(spark, f"{folder}/results.csv", folder))
    rows = by_scene.unionByName(by_method, allowMissingColumns=True)
    digits = {"success_rate": 6, "mean_inliers": 6, "median_inliers": 6, "median_time_matcher_total": 4, "mean_reproj_mean_success": 6}
    return rows.select("scene_type", "method", F.col("pairs").cast("long").alias("pairs"), *[F.round(F.col(c).cast("double"), d).alias(c) for c, d in digits.items()])


@query(f"WITH {_RANKED} SELECT frame, tile, CAST(rank AS BIGINT) AS rank, passed, score, reasons AS gate_reasons FROM ranked")
def ranking_csv(spark, sf_dir):
    """Rankings written as CSV, a folder for each frame, and read back."""
    folder = storage.scratch(spark, "rankings")
    ranked = scoring.rank(_evaluated(spark, sf_dir), ["frame"], B.TIES)
    rows = ranked.select("frame", "tile", "rank", "passed", "score", F.concat_ws("; ", "gate_reasons").alias("gate_reasons"))
    rows.repartition("frame").write.partitionBy("frame").option("header", True).csv(folder)
    back = spark.read.schema("tile long, rank long, passed boolean, score double, gate_reasons string, frame long").option("header", True).csv(folder)
    return back.withColumn("gate_reasons", F.coalesce("gate_reasons", F.lit("")))


@query("""WITH f AS (SELECT 't' || p_partkey AS image_id, p_size AS n_keypoints FROM part) SELECT image_id, n_keypoints, CAST((SELECT count(*) FROM f) AS BIGINT) AS kept, true AS refused FROM f WHERE n_keypoints < 20""")
def kept_features(spark, sf_dir):
    """Features kept with a signature, read back for some tiles, and refused under another signature."""
    folder = storage.scratch(spark, "features")
    t = B.table(spark, sf_dir, "part", "p_partkey", "p_size").select(F.concat(F.lit("t"), F.col("p_partkey")).alias("image_id"), F.col("p_size").alias("n_keypoints"), F.lit(0.5).alias("time_extract"))
    sign = tables.signature({"name": "corners", "device": "cpu"}, 1.0, "a", None)
    manifest = tables.write_cache(t, folder, sign)
    try:
        tables.read_cache(spark, folder, sign | {"work_scale": 0.5}, t.limit(0))
        refused = False
    except RuntimeError:
        refused = True
    wanted = t.filter("n_keypoints < 20").select(F.col("image_id").alias("tile_id"))
    return tables.read_cache(spark, folder, sign, wanted).select("image_id", "n_keypoints", F.lit(manifest["tiles"]).cast("long").alias("kept"), F.lit(refused).alias("refused"))
