"""More queries of the engine over the driver's tables: outcomes, flat rows, timings, checks, names."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from skylocus.catalog import _RANKED, DIAG, _diagnosed, _evaluated, _grid_sql, fits, flagship, query
from skylocus.functions import geometry as G
from skylocus.functions import names
from skylocus.operators import imaging, integrity, matching, scoring, tiling
from skylocus.plans import bindings as B
from skylocus.plans import experiment, localize, prepare, report
from skylocus.sources import tables


@query(f"""WITH {DIAG}, c AS (SELECT *, p_partkey % 23 = 0 AS lost, p_size % 40 AS matches, p_partkey % 37 AS inliers FROM diag JOIN part USING (p_partkey)),
w AS (SELECT p_partkey, CASE WHEN lost AND matches < 4 THEN 'fewer than 4 matches' WHEN lost THEN 'no homography' WHEN inliers < 15 THEN 'inliers ' || inliers || ' < 15'
 ELSE reasons END AS failure_reason FROM c) SELECT p_partkey, failure_reason = '' AS success, failure_reason FROM w""")
def pair_outcome(spark, sf_dir):
    """Whether pairs are matched, and the first reason why not."""
    c = F.col
    t = _diagnosed(spark, sf_dir).join(B.table(spark, sf_dir, "part", "p_partkey", "p_size"), "p_partkey")
    success, why = scoring.outcome(F.when(c("p_partkey") % 23 != 0, c("h")), c("p_size") % 40, c("p_partkey") % 37, c("plausible"), c("reasons"))
    return t.select("p_partkey", success.alias("success"), why.alias("failure_reason"))


_VERIFIED = """SELECT o_orderkey AS pair_id, o_orderkey % 7 * 8 AS frame_work_w, o_orderkey % 300 AS matches, o_orderkey % 300 // 3 AS inliers, (o_orderkey % 35) * 1e-1 AS reproj_mean,
 o_orderkey % 4 <> 0 AS plausible, o_orderkey % 5 AS n, o_orderkey % 11 * 125e-3 AS time_extract_frame, o_orderkey % 13 * 25e-2 AS time_extract_tile, o_orderkey % 17 * 5e-1 AS time_match FROM orders"""


@query(f"""WITH v AS ({_VERIFIED}) SELECT pair_id, frame_work_w, matches, inliers, round(CASE WHEN matches > 0 THEN inliers / CAST(matches AS DOUBLE) ELSE 0e0 END, 6) AS inlier_ratio, reproj_mean,
 CASE WHEN n > 0 THEN round((n + 1) / 2e1, 6) END AS mean_confidence, plausible AS h_plausible, time_extract_frame + time_extract_tile + time_match AS time_matcher_total,
 CAST(27 AS BIGINT) AS n_columns, CAST(NULL AS DOUBLE) AS h_scale FROM v""")
def pair_rows(spark, sf_dir):
    """The flat row of a pair, of which some columns are shown; what isn't there is null."""
    t = B.table(spark, sf_dir, "orders", "o_orderkey").selectExpr(
        "o_orderkey AS pair_id", "o_orderkey % 7 * 8 AS frame_work_w", "o_orderkey % 300 AS matches", "o_orderkey % 300 div 3 AS inliers", "(o_orderkey % 35) * 0.1D AS reproj_mean",
        "o_orderkey % 4 <> 0 AS plausible", "CASE WHEN o_orderkey % 5 = 0 THEN CAST(array() AS array<double>) ELSE transform(sequence(1, CAST(o_orderkey % 5 AS INT)), i -> i / 10D) END AS conf",
        "o_orderkey % 11 * 0.125D AS time_extract_frame", "o_orderkey % 13 * 0.25D AS time_extract_tile", "o_orderkey % 17 * 0.5D AS time_match")
    out = scoring.pair_rows(t, ["pair_id"])
    shown = ["pair_id", "frame_work_w", "matches", "inliers", F.round("inlier_ratio", 6).alias("inlier_ratio"), "reproj_mean", F.round("mean_confidence", 6).alias("mean_confidence"), "h_plausible", "time_matcher_total"]
    return out.select(*shown, F.lit(len(out.columns) - 1).cast("long").alias("n_columns"), "h_scale")


@query(f"""WITH {_RANKED} SELECT frame AS frame_id, CAST(rank AS BIGINT) AS rank, tile AS tile_id, passed, score, reasons AS gate_reasons, center_x AS center_x_local, matches, inliers FROM ranked""")
def candidate_rows(spark, sf_dir):
    """Ranked candidates as flat rows, the gate's columns first."""
    ranked = scoring.rank(_evaluated(spark, sf_dir), ["frame"], B.TIES).withColumnsRenamed({"frame": "frame_id", "tile": "tile_id"})
    none = F.lit(None).cast("double")
    out = scoring.candidate_rows(ranked.withColumns({"x_origin": none, "y_origin": none, "time_extract_frame": none, "time_extract_tile": none, "time_match": none}))
    return out.select("frame_id", F.col("rank").cast("long").alias("rank"), "tile_id", "passed", "score", "gate_reasons", "center_x_local", "matches", "inliers")


_TIMED = "o_custkey AS frame, o_orderkey % 11 * 125e-3 AS a, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 13 * 25e-2 END AS b, o_orderkey % 17 * 5e-1 AS c, o_orderkey % 19 * 625e-4 AS d"


@query(f"""WITH t AS (SELECT {_TIMED} FROM orders), s AS (SELECT frame, count(*) AS tiles_checked, max(a) AS frame_extract, coalesce(sum(b), 0e0) AS tile_extract_sum, sum(c) AS match_sum, sum(d) AS ransac_sum FROM t GROUP BY frame)
SELECT *, round((tile_extract_sum + match_sum + ransac_sum) / tiles_checked, 6) AS per_tile_mean FROM s""")
def search_timings(spark, sf_dir):
    t = B.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").selectExpr(
        "o_custkey AS frame", "o_orderkey % 11 * 0.125D AS time_extract_frame", "CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 13 * 0.25D END AS time_extract_tile",
        "o_orderkey % 17 * 0.5D AS time_match", "o_orderkey % 19 * 0.0625D AS time_ransac")
    return scoring.search_timings(t, ["frame"]).withColumn("per_tile_mean", F.round("per_tile_mean", 6))


@query(f"""WITH {B.RUNS} SELECT frame, method, count(pair_id) AS repeats, round(median(time_total), 4) AS time_total_median, arg_min_null(inliers, pair_id) AS inliers, arg_min_null(reproj_mean, pair_id) AS reproj_mean
 FROM runs GROUP BY frame, method""")
def repeats(spark, sf_dir):
    """Over the repeats of a run: the median time, and the figures of the first."""
    out = scoring.timing_medians(B.runs(spark, sf_dir), ["frame", "method"], ["time_total"], "pair_id", ["inliers", "reproj_mean"])
    return out.withColumn("time_total_median", F.round("time_total_median", 4))


@query("""SELECT count(*) AS tiles, count(n) AS counted, min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most, coalesce(sum(s), 0e0) AS seconds
 FROM (SELECT CASE WHEN p_partkey % 50 <> 0 THEN p_size * 10 END AS n, p_size * 125e-3 AS s FROM part)""")
def cache_summary(spark, sf_dir):
    t = B.table(spark, sf_dir, "part", "p_partkey", "p_size").selectExpr("CASE WHEN p_partkey % 50 <> 0 THEN p_size * 10 END AS n_keypoints", "p_size * 0.125D AS time_extract")
    return tables.cache_summary(t).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {B.REG} SELECT count(*) AS tile_count, count(DISTINCT x_origin) AS grid_cols, count(DISTINCT y_origin) AS grid_rows,
 (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT x_origin AS x FROM reg)) AS x_origins, (SELECT string_agg(y, ',' ORDER BY y) FROM (SELECT DISTINCT y_origin AS y FROM reg)) AS y_origins FROM reg""")
def grid_record(spark, sf_dir):
    """What the record of a tiling says of its grid."""
    out = prepare.grid_record(B.registry(spark, sf_dir))
    text = lambda c: F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)
    return out.select("tile_count", F.col("grid_cols").cast("long").alias("grid_cols"), F.col("grid_rows").cast("long").alias("grid_rows"), text("x_origins"), text("y_origins"))


@query(f"""WITH {B.RUNS} {' UNION ALL '.join(f"SELECT 'nulls' AS check, '{c}' AS subject FROM runs HAVING count(*) > count({c})" for c in ("scene_type", "inliers", "time_total", "reproj_mean", "method"))}
 UNION ALL SELECT 'no_rows', 'empty'""".replace("AS check", 'AS "check"'))
def null_columns(spark, sf_dir):
    """Columns with nulls, and a table without rows."""
    runs = B.runs(spark, sf_dir)
    return integrity.columns(runs, "runs").unionByName(integrity.columns(runs.filter("pair_id < 0"), "empty"))


_SOME = "p_size * 4 % 256"


@query(f"""SELECT 't' || p_partkey AS tile_id, CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 3 END AS channels, CASE WHEN p_partkey % 13 = 0 THEN 3 ELSE 2 END AS file_w, 2 AS file_h,
 CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 THEN abs({_SOME} - (p_size * 4 + p_partkey % 3 * 100) % 256) END AS max_abs_diff FROM part""")
def pixel_differences(spark, sf_dir):
    """Tiles of 2 x 2 pixels against their files, some of other channels, sizes or pixels."""
    t = B.table(spark, sf_dir, "part", "p_partkey", "p_size").withColumn("tile_id", F.concat(F.lit("t"), F.col("p_partkey")))
    fill = lambda value, n: F.unhex(F.repeat(F.lpad(F.hex(value), 2, "0"), n))
    expected = t.select("tile_id", F.lit(2).alias("width"), F.lit(2).alias("height"), fill(F.expr(_SOME), F.lit(12)).alias("rgb"))
    channels, w = F.when(F.col("p_partkey") % 11 == 0, 1).otherwise(3), F.when(F.col("p_partkey") % 13 == 0, 3).otherwise(2)
    files = t.select(F.col("tile_id").alias("name"), w.alias("width"), F.lit(2).alias("height"), channels.alias("channels"), fill(F.expr("(p_size * 4 + p_partkey % 3 * 100) % 256"), channels * w * 2).alias("pixels"))
    return imaging.differences(expected, files)


@query(f"""WITH {B.FRAMES} SELECT count(*) AS frames, round(arg_max(timestamp_sec, frame_ord) - arg_min(timestamp_sec, frame_ord), 6) AS span_sec FROM fr""")
def frame_span(spark, sf_dir):
    return integrity.frame_figures(B.frames(spark, sf_dir)).withColumn("span_sec", F.round("span_sec", 6))


@query("""SELECT p_partkey FROM part ORDER BY md5('7:' || p_partkey), p_partkey LIMIT 50""")
def sampled_tiles(spark, sf_dir):
    """Fifty tiles, the same ones for a seed."""
    return integrity.sampled(B.table(spark, sf_dir, "part", "p_partkey"), "p_partkey", 50, 7)


@query(f"""WITH {B.PTS}, k AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY md5('3:' || idx), idx) AS k FROM pts) SELECT pair, idx FROM k WHERE k <= 5""")
def sampled_matches(spark, sf_dir):
    """Five matches of each pair, to be drawn."""
    return integrity.sampled_by(B.points(spark, sf_dir).select("pair", "idx"), ["pair"], "idx", 5, 3)


@query(f"""WITH {B.RUNS} SELECT pair_id, method, inliers, reproj_mean FROM runs WHERE method = 'F' UNION ALL SELECT pair_id, method, NULL, reproj_mean FROM runs WHERE method = 'O' UNION ALL SELECT pair_id, method, NULL, NULL FROM runs WHERE method = 'P'""")
def method_union(spark, sf_dir):
    """The rows of three methods, of which two lack columns."""
    runs = B.runs(spark, sf_dir)
    of = lambda method, *lacking: runs.filter(F.col("method") == method).select("pair_id", "method", "inliers", "reproj_mean").drop(*lacking)
    return experiment.union([of("F"), of("O", "inliers"), of("P", "inliers", "reproj_mean")])


@query("""SELECT p_partkey, CAST((4899 * (p_size * 5 % 256) + 9617 * (p_partkey % 256) + 1868 * (p_partkey // 256 % 256) + 8192) // 16384 AS BIGINT) AS gray FROM part""")
def gray_pixels(spark, sf_dir):
    """The gray of pictures of one pixel."""
    byte = lambda e: F.lpad(F.hex(F.expr(e)), 2, "0")
    t = B.table(spark, sf_dir, "part", "p_partkey", "p_size").withColumn("rgb", F.unhex(F.concat(byte("p_size * 5 % 256"), byte("p_partkey % 256"), byte("p_partkey div 256 % 256"))))
    return imaging.with_gray(t.select("p_partkey", "rgb")).select("p_partkey", F.conv(F.hex("gray"), 16, 10).cast("long").alias("gray"))


@query("""WITH s AS (SELECT p_partkey, p_size * 40 AS w, p_size * 25 AS h, 27e-2 * (1 + p_partkey % 3) AS scale FROM part),
t AS (SELECT *, CAST(greatest(8e0, round_even(w * scale / 8e0, 0) * 8e0) AS BIGINT) AS work_w, CAST(greatest(8e0, round_even(h * scale / 8e0, 0) * 8e0) AS BIGINT) AS work_h FROM s)
SELECT p_partkey, work_w, work_h, round(work_w / CAST(w AS DOUBLE), 6) AS sx, round(work_h / CAST(h AS DOUBLE), 6) AS sy FROM t""")
def working_sizes(spark, sf_dir):
    """Sizes that pictures are matched at, and the scales as they come out."""
    t = B.table(spark, sf_dir, "part", "p_partkey", "p_size").selectExpr("p_partkey", "p_size * 40 AS w", "p_size * 25 AS h", "0.27D * (1 + p_partkey % 3) AS scale")
    t = t.withColumns({"work_w": G.scaled_side(F.col("w"), F.col("scale"), 8), "work_h": G.scaled_side(F.col("h"), F.col("scale"), 8)})
    return t.select("p_partkey", "work_w", "work_h", F.round(F.col("work_w") / F.col("w"), 6).alias("sx"), F.round(F.col("work_h") / F.col("h"), 6).alias("sy"))


_CLIP = "SELECT greatest(0, least(x_origin, 6200)) AS x0, greatest(0, least(x_origin + width, 6200)) AS x1, greatest(0, least(y_origin, 4320)) AS y0, greatest(0, least(y_origin + height, 4320)) AS y1 FROM reg"
_EXPECTED = tiling.count(6200, 512, 256) * tiling.count(4320, 512, 256)


@query(f"""WITH {B.REG}, r AS ({_CLIP}), xs AS (SELECT k AS a, lead(k) OVER (ORDER BY k) AS b FROM (SELECT x0 AS k FROM r UNION SELECT x1 FROM r UNION SELECT 0 UNION SELECT 6200)),
ys AS (SELECT k AS c, lead(k) OVER (ORDER BY k) AS d FROM (SELECT y0 AS k FROM r UNION SELECT y1 FROM r UNION SELECT 0 UNION SELECT 4320)),
n AS (SELECT sum((b - a) * (d - c)) AS px FROM xs, ys WHERE b IS NOT NULL AND d IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r WHERE x0 <= a AND x1 >= b AND y0 <= c AND y1 >= d))
SELECT 'not_covered' AS "check", CAST(CAST(px AS BIGINT) AS VARCHAR) AS subject FROM n WHERE px > 0
UNION ALL SELECT 'count', CAST(count(*) AS VARCHAR) FROM reg HAVING count(*) <> {_EXPECTED} UNION ALL SELECT 'size', tile_id FROM reg WHERE width <> 512 OR height <> 512""")
def validate_grid(spark, sf_dir):
    """A registry's coverage, count and sizes as violations."""
    reg = B.registry(spark, sf_dir)
    return integrity.union([integrity.uncovered(tiling.coverage(reg, 6200, 4320)), integrity.count_is(reg, _EXPECTED), integrity.sizes(reg, "tile_id", 512, 512)])


@query("""WITH f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/data/maps/' WHEN 1 THEN '/data' WHEN 2 THEN 'here\\' ELSE '' END || 'p' || page_id || CASE page_id % 3 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '.PNG' ELSE '' END AS path FROM pages),
b AS (SELECT *, regexp_extract(path, '[^/]*$') AS base FROM f)
SELECT page_id, regexp_replace(base, '^(.+)[.][^.]*$', '\\1') AS stem, substr(base, length(regexp_replace(base, '^(.+)[.][^.]*$', '\\1')) + 1) AS suffix,
 CASE WHEN starts_with(replace(path, '\\', '/'), '/data/') THEN substr(replace(path, '\\', '/'), 7) ELSE replace(path, '\\', '/') END AS portable FROM b""")
def file_names(spark, sf_dir):
    folder = "CASE page_id % 4 WHEN 0 THEN '/data/maps/' WHEN 1 THEN '/data' WHEN 2 THEN 'here\\\\' ELSE '' END"
    t = B.table(spark, sf_dir, "pages", "page_id").withColumn("path", F.expr(f"concat({folder}, 'p', page_id, CASE page_id % 3 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '.PNG' ELSE '' END)"))
    path = F.col("path")
    return t.select("page_id", names.stem(path).alias("stem"), names.suffix(path).alias("suffix"), names.portable(path, "/data").alias("portable"))


_SEARCHED = f"""{_RANKED}, two AS (SELECT frame, max(CASE WHEN rank = 1 THEN score END) AS best, max(CASE WHEN rank = 2 THEN score END) AS second FROM ranked WHERE passed AND rank <= 2 GROUP BY frame),
one AS (SELECT frame, count(*) FILTER (passed) AS tiles_passed, max(CASE WHEN rank = 1 AND passed THEN tile END) AS winner, max(CASE WHEN rank = 1 AND passed THEN round(score, 4) END) AS winner_score,
 string_agg(tile, ',' ORDER BY rank) FILTER (rank <= 5) AS top FROM ranked GROUP BY frame)"""


@query(f"""WITH {_SEARCHED} SELECT one.frame, tiles_passed, winner IS NOT NULL AS success, winner, winner_score, round(CASE WHEN second > 0 THEN best / second END, 6) AS margin, top FROM one LEFT JOIN two USING (frame)""")
def search_documents(spark, sf_dir):
    """Each frame's search as a JSON document, and what is read back from it."""
    ranked = scoring.rank(_evaluated(spark, sf_dir), ["frame"], B.TIES)
    none = F.lit(None).cast("double")
    whole = ranked.withColumns({
        "frame_id": F.col("frame").cast("string"), "tile_id": F.col("tile").cast("string"), "x_origin": F.lit(0), "y_origin": F.lit(0), "x_map": F.col("center_x"), "y_map": F.col("center_y"),
        "h": F.lit(None).cast("array<double>"), "h_scale": none, "success": F.col("passed"), "frame_w": F.lit(1920), "frame_h": F.lit(1080),
        **{c: F.lit(0.0) for c in ("time_extract_frame", "time_extract_tile", "time_match", "time_ransac")},
    })
    documents = report.documents(report.summaries(whole))
    schema = "tiles_passed long, success boolean, winner struct<tile_id:string,score:double>, top_k array<struct<tile_id:string>>, score_margin_to_runner_up double"
    back = documents.select("frame_id", F.from_json("document", schema).alias("d")).select("frame_id", "d.*")
    return back.select(F.col("frame_id").cast("long").alias("frame"), "tiles_passed", "success", F.col("winner.tile_id").cast("long").alias("winner"), F.round("winner.score", 4).alias("winner_score"),
                       F.round("score_margin_to_runner_up", 6).alias("margin"), F.concat_ws(",", F.col("top_k.tile_id")).alias("top"))


@query(f"""WITH {_grid_sql(1280, 1024, 512, 256)}, p AS (SELECT p_partkey, p_partkey % 12 + 1 AS k FROM part) SELECT p_partkey, tile_id, x_origin, y_origin FROM p JOIN grid ON tile_ord = k""")
def pair_tiles(spark, sf_dir):
    """Pairs with the registry's columns of their tiles."""
    pairs = B.table(spark, sf_dir, "part", "p_partkey").withColumn("tile_id", F.format_string(tiling.TILE_NAME, F.col("p_partkey") % 12 + 1))
    return localize.with_tiles(pairs, tiling.grid(spark, 1280, 1024)).select("p_partkey", "tile_id", "x_origin", "y_origin")


@query("SELECT DISTINCT 'user_' || user_id AS frame_id, 'tile_0007.png' AS tile_id, true AS within_a_pixel, true AS most_are_inliers FROM events")
def flagship_places(spark, sf_dir):
    """Whether the flagship finds every frame's tile, and its place to a pixel."""
    x = 0.2696 * 959.5 - 0.0141 * 539.5 - 40.0 + 512
    y = 0.0141 * 959.5 + 0.2696 * 539.5 + 100.0 + 256
    near = (F.abs(F.col("x_map") - x) < 1) & (F.abs(F.col("y_map") - y) < 1)
    return flagship(spark, sf_dir).select("frame_id", "tile_id", near.alias("within_a_pixel"), (F.col("inliers") >= 60).alias("most_are_inliers"))


@query(f"""WITH {B.PTS} SELECT pair, count(*) AS matches, count(*) FILTER (idx % 3 <> 0 AND sqrt(dx * dx + dy * dy) <= 18e-1) >= 4 AS found, true AS corners_within_two FROM errs GROUP BY pair""")
def ransac_places(spark, sf_dir):
    """Whether the robust fit takes each pair's corners to where the known homography does, to two pixels."""
    h = F.col("h")
    known = F.array(*[F.lit(x) for x in B.H])
    off = []
    # in the middle of the points, which span a fifth of the frame
    for x, y in ((100.0, 200.0), (300.0, 200.0), (300.0, 900.0), (100.0, 900.0)):
        u, v = G.project(h, F.lit(x), F.lit(y))
        a, b = G.project(known, F.lit(x), F.lit(y))
        off.append(G.distance(u, v, a, b))
    return fits(spark, sf_dir).select("pair", "matches", h.isNotNull().alias("found"), (F.greatest(*off) < 2).alias("corners_within_two"))


@query("""WITH e AS (SELECT vec_id // 200 AS image, count(*) AS n FROM embeddings GROUP BY 1) SELECT image, n AS matches, n AS same FROM e""")
def features_meet_themselves(spark, sf_dir):
    """Kept features of an image matched with those of the same image: every keypoint meets itself."""
    e = B.table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("image", F.expr("vec_id div 200"))
    at = F.sort_array(F.collect_list(F.struct("vec_id", "embedding")))
    rows = e.groupBy("image").agg(at.alias("k"))
    x = F.transform("k", lambda k: (k["vec_id"] % 20).cast("float"))
    y = F.transform("k", lambda k: (F.floor(k["vec_id"] / 20) % 10).cast("float"))
    features = rows.select(F.col("image").cast("string").alias("image_id"), x.alias("x"), y.alias("y"), F.array_repeat(F.lit(1.0).cast("float"), 1).alias("scores"), F.flatten("k.embedding").alias("descriptors"),
                           F.size("k").alias("n_keypoints"), F.lit(20).alias("work_w"), F.lit(10).alias("work_h"), F.lit(20).alias("orig_w"), F.lit(10).alias("orig_h"), F.lit(0.0).alias("time_extract"))
    pairs = features.select(F.col("image_id").alias("frame_id"), F.col("image_id").alias("tile_id"))
    out = matching.match(pairs, features, features, matching.create("corners", least_similarity=-1.0), cached=True)
    same = F.size(F.filter(F.arrays_zip("x0", "y0", "x1", "y1"), lambda p: (p["x0"] == p["x1"]) & (p["y0"] == p["y1"])))
    return out.select(F.col("frame_id").cast("long").alias("image"), F.size("x0").cast("long").alias("matches"), same.cast("long").alias("same"))


@query("SELECT 'true' AS finished, 'true' AS in_utc, 'true' AS has_spark, CAST(NULL AS VARCHAR) AS no_commit")
def run_metadata(spark, sf_dir):
    """What a run's record says of time, place and commit, as far as it can be foretold."""
    where = tables.environment(spark)
    commit = tables.git_commit(tempfile.gettempdir())
    return spark.createDataFrame([("true", str(tables.now().endswith("+00:00")).lower(), str(where["spark"] == spark.version).lower(), commit)], "finished string, in_utc string, has_spark string, no_commit string")
