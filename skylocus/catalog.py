"""All queries of the engine by name, each with its SQL where that can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylocus.functions import geometry as G
from skylocus.operators import homography, integrity, matching, scoring, tiling
from skylocus.plans import bindings as B
from skylocus.plans import localize

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def _h() -> F.Column:
    return F.array(*[F.lit(x) for x in B.H])


def _grid_sql(w: int, h: int, size: int, step: int, x0: int = 0, y0: int = 0) -> str:
    nx, ny = tiling.count(w, size, step), tiling.count(h, size, step)
    return f"""grid AS (SELECT k + 1 AS tile_ord, printf('tile_%04d.png', k + 1) AS tile_id,
 least(k % {nx} * {step}, {w - size}) + {x0} AS x_origin, least(k // {nx} * {step}, {h - size}) + {y0} AS y_origin, {size} AS width, {size} AS height
 FROM range({nx * ny}) r(k))"""


GRID = _grid_sql(B.MAP_W, B.MAP_H, 512, 256)


def _grid(spark: SparkSession) -> DataFrame:
    return tiling.grid(spark, B.MAP_W, B.MAP_H)


@query(f"WITH {GRID} SELECT * FROM grid")
def tile_grid(spark, sf_dir):
    return _grid(spark)


@query(f"WITH {_grid_sql(768, 512, 256, 128, 912, 1409)} SELECT * FROM grid")
def tile_grid_roi(spark, sf_dir):
    return tiling.grid(spark, 2000, 2000, 256, 0.5, (912, 1409, 768, 512))


@query("""WITH s AS (SELECT p_partkey, p_size * 10 AS size, 500 + p_partkey % 4000 AS extent FROM part)
SELECT p_partkey, CAST(greatest(1, floor(size * (1e0 - 5e-1))) AS BIGINT) AS stride,
 CAST(ceil((extent - size) / greatest(1e0, floor(size * (1e0 - 5e-1)))) + 1 AS BIGINT) AS n FROM s""")
def tile_count_by_size(spark, sf_dir):
    t = B.table(spark, sf_dir, "part", "p_partkey", "p_size").selectExpr("p_partkey", "p_size * 10 AS size", "500 + p_partkey % 4000 AS extent")
    step = F.greatest(F.lit(1), F.floor(F.col("size") * F.lit(0.5))).cast("long")
    n = F.size(tiling.origins(F.col("extent"), F.col("size").cast("long"), step)).cast("long")
    return t.select("p_partkey", step.alias("stride"), n.alias("n"))


@query("""SELECT (event_id - 15) // 30 + 1 AS frame_ord, printf('frame_%04d.png', (event_id - 15) // 30 + 1) AS frame_id,
 event_id AS source_frame_idx, round_even(event_id / 30e0, 6) AS timestamp_sec, 1920 AS width, 1080 AS height FROM events WHERE event_id >= 15 AND (event_id - 15) % 30 = 0""")
def frame_sampling(spark, sf_dir):
    raw = B.table(spark, sf_dir, "events", "event_id").selectExpr("event_id AS source_frame_idx", "1920 AS width", "1080 AS height")
    return tiling.sample_frames(raw, 30.0, 1.0, start_sec=0.5)


@query("""WITH s AS (SELECT p_partkey, p_size * 1e0 AS fps, (p_partkey % 9) * 5e-1 AS target FROM part)
SELECT p_partkey, CASE WHEN fps > 0 AND target > 0 AND target <= fps THEN CAST(greatest(1e0, round_even(fps / target, 0)) AS BIGINT) END AS step FROM s""")
def frame_step_table(spark, sf_dir):
    t = B.table(spark, sf_dir, "part", "p_partkey", "p_size").selectExpr("p_partkey", "p_size * 1D AS fps", "(p_partkey % 9) * 0.5D AS target")
    return t.select("p_partkey", tiling.frame_step(F.col("fps"), F.col("target")).alias("step"))


@query(f"WITH {GRID} SELECT * FROM grid WHERE x_origin < 1536 AND x_origin + width > 256 AND y_origin < 3072 AND y_origin + height > 2048")
def roi_tiles(spark, sf_dir):
    return tiling.select_tiles(_grid(spark), (256, 2048, 1536, 3072))


@query(f"""WITH {GRID}, k AS (SELECT *, dense_rank() OVER (ORDER BY x_origin) - 1 AS cx, dense_rank() OVER (ORDER BY y_origin) - 1 AS cy FROM grid)
SELECT tile_ord, tile_id, x_origin, y_origin, width, height FROM k WHERE cx % 2 = 0 AND cy % 2 = 0""")
def grid_step_tiles(spark, sf_dir):
    return tiling.select_tiles(_grid(spark), None, 2)


@query(f"""WITH {GRID}, roi AS (SELECT p_partkey, p_partkey * 3 % 6000 AS x0, p_partkey * 7 % 4000 AS y0, p_partkey * 3 % 6000 + p_size * 20 AS x1, p_partkey * 7 % 4000 + p_size * 20 AS y1 FROM part)
SELECT p_partkey, tile_id FROM roi, grid WHERE x_origin < x1 AND x_origin + width > x0 AND y_origin < y1 AND y_origin + height > y0""")
def roi_range_join(spark, sf_dir):
    rois = B.table(spark, sf_dir, "part", "p_partkey", "p_size").selectExpr(
        "p_partkey", "p_partkey * 3 % 6000 AS x0", "p_partkey * 7 % 4000 AS y0", "p_partkey * 3 % 6000 + p_size * 20 AS x1", "p_partkey * 7 % 4000 + p_size * 20 AS y1")
    return tiling.tiles_in_regions(_grid(spark), rois).select("p_partkey", "tile_id")


@query(f"""WITH {GRID}, c AS (SELECT x.k * 1e0 AS px, y.k * 1e0 AS py FROM (SELECT DISTINCT x_origin AS k FROM grid) x, (SELECT DISTINCT y_origin AS k FROM grid) y),
xs AS (SELECT k AS x0, lead(k) OVER (ORDER BY k) AS x1 FROM (SELECT x_origin AS k FROM grid UNION SELECT x_origin + width FROM grid)),
ys AS (SELECT k AS y0, lead(k) OVER (ORDER BY k) AS y1 FROM (SELECT y_origin AS k FROM grid UNION SELECT y_origin + height FROM grid)),
cells AS (SELECT * FROM xs, ys WHERE x1 IS NOT NULL AND y1 IS NOT NULL),
n AS (SELECT x0, y0, any_value((x1 - x0) * (y1 - y0)) AS area, count(tile_id) AS n FROM cells LEFT JOIN grid ON x_origin <= x0 AND x_origin + width >= x1 AND y_origin <= y0 AND y_origin + height >= y1 GROUP BY x0, y0)
SELECT min(n) AS min_cover, max(n) AS max_cover, CAST(sum(CASE WHEN n = 0 THEN area ELSE 0 END) AS BIGINT) AS uncovered_px FROM n""")
def coverage(spark, sf_dir):
    return tiling.coverage(_grid(spark), B.MAP_W, B.MAP_H)


@query("""SELECT p_partkey, CAST(greatest(8e0, round_even(p_size * 40 * 27e-2 / 8e0, 0) * 8e0) AS BIGINT) AS work_w,
 CAST(greatest(1e0, round_even(p_size * 25 * 27e-2 / 1e0, 0) * 1e0) AS BIGINT) AS work_h FROM part""")
def scaled_sizes(spark, sf_dir):
    t = B.table(spark, sf_dir, "part", "p_partkey", "p_size")
    s = F.lit(0.27)
    return t.select("p_partkey", G.scaled_side(F.col("p_size") * 40, s, 8).alias("work_w"), G.scaled_side(F.col("p_size") * 25, s).alias("work_h"))


@query("SELECT event_id, round((value + 5e-1) * 27e-2 - 5e-1, 6) AS work, round(((value + 5e-1) * 27e-2 - 5e-1 + 5e-1) / 27e-2 - 5e-1, 6) AS back FROM events")
def coord_roundtrip(spark, sf_dir):
    t = B.table(spark, sf_dir, "events", "event_id", "value")
    work = G.to_work(F.col("value"), F.lit(0.27))
    return t.select("event_id", F.round(work, 6).alias("work"), F.round(G.to_original(work, F.lit(0.27)), 6).alias("back"))


@query(f"WITH {B.PTS} SELECT pair, idx, round(u, 6) AS x, round(v, 6) AS y FROM errs")
def project_points(spark, sf_dir):
    x, y = G.project(_h(), F.col("x0"), F.col("y0"))
    return B.points(spark, sf_dir).select("pair", "idx", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(f"""WITH {B.PTS}, e AS (SELECT pair, sqrt((u - (u + dx)) * (u - (u + dx)) + (v - (v + dy)) * (v - (v + dy))) AS error FROM errs)
SELECT pair, count(error) AS n, round(avg(error), 6) AS reproj_mean, round(median(error), 6) AS reproj_median, round(sqrt(avg(error * error)), 6) AS reproj_rmse, round(max(error), 6) AS reproj_max FROM e GROUP BY pair""")
def reproj_stats(spark, sf_dir):
    x, y = G.project_or_origin(_h(), F.col("x0"), F.col("y0"))
    t = B.points(spark, sf_dir).withColumn("x1", x + F.col("dx")).withColumn("y1", y + F.col("dy"))
    e = t.select("pair", G.reprojection_error(_h(), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("error"))
    out = scoring.error_stats(e, ["pair"])
    return out.select("pair", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def _at(k: int, x: str, y: str) -> str:
    return f"h{3 * k} * {x} + h{3 * k + 1} * {y} + " + ("1e0" if k == 2 else f"h{3 * k + 2}")


def _mapped(x: str, y: str, row: int, origin: str = "") -> str:
    w = _at(2, x, y)
    return f"CASE WHEN abs({w}) >= 1e-12 THEN ({_at(row, x, y)}) / ({w}) END{origin}"


_CORNERS = {"tl": ("0e0", "0e0"), "tr": ("1919e0", "0e0"), "br": ("1919e0", "1079e0"), "bl": ("0e0", "1079e0")}
_FOOT = ", ".join(f"round({_mapped(x, y, r, f' + {a}_origin')}, 4) AS {a}_{n}" for n, (x, y) in _CORNERS.items() for r, a in ((0, "x"), (1, "y")))


@query(f"WITH {B.HOMO} SELECT p_partkey, {_FOOT} FROM homo")
def footprints(spark, sf_dir):
    t = B.homographies(spark, sf_dir)
    foot = localize.footprint(F.col("h"), F.lit(B.FRAME_W), F.lit(B.FRAME_H), F.col("x_origin"), F.col("y_origin"))
    return t.select("p_partkey", *[F.round(c, 4).alias(n) for n, c in foot.items()])


@query(f"""WITH {B.HOMO}, c AS (SELECT p_partkey, {_mapped('9595e-1', '5395e-1', 0, ' + x_origin')} AS x, {_mapped('9595e-1', '5395e-1', 1, ' + y_origin')} AS y FROM homo)
SELECT p_partkey, round(x, 4) AS x_map, round(y, 4) AS y_map, coalesce(x BETWEEN 0 AND 6199 AND y BETWEEN 0 AND 4319, false) AS in_map FROM c""")
def center_on_map(spark, sf_dir):
    t = B.homographies(spark, sf_dir)
    cx, cy = G.project(F.col("h"), *G.center(F.lit(B.FRAME_W), F.lit(B.FRAME_H)))
    t = t.select("p_partkey", (cx + F.col("x_origin")).alias("x"), (cy + F.col("y_origin")).alias("y"))
    inside = G.inside(F.col("x"), F.col("y"), F.lit(B.MAP_W), F.lit(B.MAP_H))
    return t.select("p_partkey", F.round("x", 4).alias("x_map"), F.round("y", 4).alias("y_map"), inside.alias("in_map"))


_QUAD = ", ".join(f"CASE WHEN abs(w_{n}) < 2.220446049250313e-16 THEN 0e0 ELSE ({_at(r, x, y)}) / w_{n} END AS {a}_{n}" for n, (x, y) in _CORNERS.items() for r, a in ((0, "x"), (1, "y")))


def _turn(a: str, b: str, c: str) -> str:
    return f"(x_{b} - x_{a}) * (y_{c} - y_{b}) - (y_{b} - y_{a}) * (x_{c} - x_{b})"


_TURNS = ", ".join(_turn(*t) for t in (("tl", "tr", "br"), ("tr", "br", "bl"), ("br", "bl", "tl"), ("bl", "tl", "tr")))
DIAG = f"""{B.HOMO}, dw AS (SELECT *, {', '.join(f'{_at(2, x, y)} AS w_{n}' for n, (x, y) in _CORNERS.items())}, {_at(2, '9595e-1', '5395e-1')} AS w FROM homo),
quad AS (SELECT *, {_QUAD}, ({_at(0, '9595e-1', '5395e-1')}) / CASE WHEN abs(w) >= 1e-12 THEN w END AS u, ({_at(1, '9595e-1', '5395e-1')}) / CASE WHEN abs(w) >= 1e-12 THEN w END AS v FROM dw),
jac AS (SELECT *, (h0 - u * h6) / w AS jxx, (h1 - u * h7) / w AS jxy, (h3 - v * h6) / w AS jyx, (h4 - v * h7) / w AS jyy FROM quad),
d AS (SELECT *, jxx * jyy - jxy * jyx AS det, jxx * jxx + jxy * jxy + jyx * jyx + jyy * jyy AS q FROM jac),
big AS (SELECT *, sqrt((q + sqrt(greatest(q * q - 4 * det * det, 0e0))) / 2) AS large FROM d),
an AS (SELECT *, sqrt(abs(det)) AS s, CASE WHEN large > 0 AND abs(det) / large > 1e-12 THEN large / (abs(det) / large) END AS ani FROM big),
diag AS (SELECT *, concat_ws('; ',
 CASE WHEN NOT (least(w_tl, w_tr, w_br, w_bl) > 0 OR greatest(w_tl, w_tr, w_br, w_bl) < 0) THEN 'infinity' END,
 CASE WHEN NOT coalesce(det > 0, false) THEN 'reflection' END,
 CASE WHEN NOT (least({_TURNS}) > 0 OR greatest({_TURNS}) < 0) THEN 'not_convex' END,
 CASE WHEN coalesce(ani > 15e-1, true) THEN 'anisotropy' END,
 CASE WHEN NOT coalesce(s BETWEEN 27e-2 / 2e0 AND 27e-2 * 2e0, false) THEN 'scale' END) AS reasons FROM an)"""


def _diagnosed(spark, sf_dir):
    return G.diagnose(B.homographies(spark, sf_dir), F.col("h"), F.lit(B.FRAME_W), F.lit(B.FRAME_H))


@query(f"WITH {DIAG} SELECT p_partkey, round(s, 6) AS h_scale, round(degrees(atan2(jyx - jxy, jxx + jyy)), 6) AS h_rotation_deg, round(ani, 6) AS h_anisotropy FROM diag")
def homography_diagnostics(spark, sf_dir):
    return _diagnosed(spark, sf_dir).select("p_partkey", *[F.round(c, 6).alias(c) for c in ("h_scale", "h_rotation_deg", "h_anisotropy")])


@query(f"WITH {DIAG} SELECT p_partkey, reasons, reasons = '' AS plausible FROM diag")
def plausibility_reasons(spark, sf_dir):
    return _diagnosed(spark, sf_dir).select("p_partkey", F.concat_ws("; ", "reasons").alias("reasons"), "plausible")


def _evaluated(spark, sf_dir):
    return scoring.evaluate(B.candidates(spark, sf_dir), digits=6)


@query(f"WITH {B.CAND} SELECT frame, tile, k1, k2, k3, reasons, passed, score FROM scored")
def gate_candidates(spark, sf_dir):
    return _evaluated(spark, sf_dir).select("frame", "tile", "k1", "k2", "k3", F.concat_ws("; ", "gate_reasons").alias("reasons"), "passed", "score")


_RANKED = f"{B.CAND}, ranked AS (SELECT *, row_number() OVER (PARTITION BY frame {B.ORDER}) AS rank FROM scored)"


@query(f"WITH {_RANKED} SELECT frame, tile, inliers, score, passed, CAST(rank AS BIGINT) AS rank FROM ranked")
def rank_candidates(spark, sf_dir):
    return scoring.rank(_evaluated(spark, sf_dir), ["frame"], B.TIES).select("frame", "tile", "inliers", "score", "passed", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_RANKED} SELECT frame, tile, inliers, score FROM ranked WHERE rank = 1 AND passed")
def winner_per_frame(spark, sf_dir):
    return scoring.winners(_evaluated(spark, sf_dir), ["frame"], B.TIES).select("frame", "tile", "inliers", "score")


@query(f"WITH {_RANKED} SELECT frame, tile, score, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 5")
def top_k(spark, sf_dir):
    return scoring.rank(_evaluated(spark, sf_dir), ["frame"], B.TIES, 5).select("frame", "tile", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_RANKED}, two AS (SELECT frame, max(CASE WHEN rank = 1 THEN score END) AS best, max(CASE WHEN rank = 2 THEN score END) AS second FROM ranked WHERE passed GROUP BY frame)
SELECT frame, best, second, round(CASE WHEN second > 0 THEN best / second END, 6) AS margin FROM two""")
def score_margin(spark, sf_dir):
    out = scoring.margin(_evaluated(spark, sf_dir), ["frame"], B.TIES)
    return out.withColumn("margin", F.round("margin", 6))


_SUMMARY = """count(pair_id) AS runs, round(avg(CAST(success AS DOUBLE)), 6) AS success_rate, round(avg(inliers), 6) AS inliers_mean, round(avg(time_total), 4) AS time_total_mean,
 round(median(inliers), 6) AS inliers_median, round(median(time_total), 4) AS time_total_median, round(avg(CASE WHEN success THEN reproj_mean END), 6) AS reproj_mean_success_mean"""


def _summary(spark, sf_dir, by):
    out = scoring.summarize(B.runs(spark, sf_dir), by, ["inliers", "time_total"], ["inliers", "time_total"], ["reproj_mean"])
    digits = {c: 4 if c.startswith("time") else 6 for c in out.columns if c not in (*by, "runs")}
    return out.select(*by, "runs", *[F.round(c, d).alias(c) for c, d in digits.items()])


@query(f"WITH {B.RUNS} SELECT method, {_SUMMARY} FROM runs GROUP BY method")
def summary_by_method(spark, sf_dir):
    return _summary(spark, sf_dir, ["method"])


@query(f"WITH {B.RUNS} SELECT scene_type, method, {_SUMMARY} FROM runs WHERE scene_type IS NOT NULL GROUP BY scene_type, method")
def summary_by_scene(spark, sf_dir):
    return _summary(spark, sf_dir, ["scene_type", "method"])


@query(f"WITH {B.RUNS} SELECT frame, method, count(pair_id) AS repeats, round(median(time_total), 4) AS time_total_median FROM runs GROUP BY frame, method")
def timing_median(spark, sf_dir):
    out = scoring.timing_medians(B.runs(spark, sf_dir), ["frame", "method"], ["time_total"], "pair_id")
    return out.withColumn("time_total_median", F.round("time_total_median", 4))


@query("""SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, quantile_disc(value, 9e-1) AS p90 FROM events GROUP BY user_id""")
def p90_error(spark, sf_dir):
    out = scoring.localization_stats(B.table(spark, sf_dir, "events", "user_id", "value"), ["user_id"], "value")
    return out.select("user_id", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "p90")


_BEYOND = "x_origin < 0 OR y_origin < 0 OR x_origin + width > 6200 OR y_origin + height > 4320"


@query(f"""WITH {B.REG} SELECT 'size' AS "check", tile_id AS subject FROM reg WHERE width <> 512 OR height <> 512
UNION ALL SELECT 'beyond_map', tile_id FROM reg WHERE {_BEYOND}
UNION ALL SELECT 'duplicate_id', tile_id FROM reg GROUP BY tile_id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_origin', x_origin || ',' || y_origin FROM reg GROUP BY x_origin, y_origin HAVING count(*) > 1""")
def validate_tiles(spark, sf_dir):
    return integrity.tiles(B.registry(spark, sf_dir), B.MAP_W, B.MAP_H)


_FR = f"""{B.FRAMES}, o AS (SELECT *, lag(source_frame_idx) OVER w AS i0, lag(timestamp_sec) OVER w AS t0, row_number() OVER w AS k FROM fr WINDOW w AS (PARTITION BY video ORDER BY frame_ord))"""
_WHO = "video || '/' || frame_ord"


@query(f"""WITH {_FR} SELECT 'index_order' AS "check", {_WHO} AS subject FROM o WHERE source_frame_idx <= i0
UNION ALL SELECT 'time_order', {_WHO} FROM o WHERE timestamp_sec < t0 UNION ALL SELECT 'step', {_WHO} FROM o WHERE source_frame_idx - i0 <> 30
UNION ALL SELECT 'timestamp', {_WHO} FROM o WHERE abs(timestamp_sec - source_frame_idx / 30e0) > 1e-4 + 1e-5 * abs(source_frame_idx / 30e0)
UNION ALL SELECT 'contiguous', {_WHO} FROM o WHERE frame_ord <> k""")
def validate_frames(spark, sf_dir):
    return integrity.frames(B.frames(spark, sf_dir), 30.0, 30)


@query(f"""WITH {B.REG}, disk AS (SELECT DISTINCT printf('tile_%04d.png', l_partkey % 2100) AS tile_id FROM lineitem)
SELECT 'missing' AS "check", tile_id AS subject FROM (SELECT tile_id FROM reg EXCEPT SELECT tile_id FROM disk)
UNION ALL SELECT 'stale', tile_id FROM (SELECT tile_id FROM disk EXCEPT SELECT tile_id FROM reg)""")
def stale_files(spark, sf_dir):
    disk = B.table(spark, sf_dir, "lineitem", "l_partkey").selectExpr("format_string('tile_%04d.png', l_partkey % 2100) AS tile_id")
    return integrity.files(B.registry(spark, sf_dir), disk, "tile_id")


@query("""WITH e AS (SELECT *, vec_id // 200 AS image FROM embeddings),
s AS (SELECT a.label, a.image, a.vec_id AS id0, b.vec_id AS id1, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
 FROM e a JOIN e b ON b.label = (a.label + 1) % 10 AND b.image = a.image),
r AS (SELECT *, row_number() OVER (PARTITION BY id0 ORDER BY score DESC, id1) AS a, row_number() OVER (PARTITION BY id1 ORDER BY score DESC, id0) AS b FROM s)
SELECT label, image, id0, id1, round(score, 4) AS score FROM r WHERE a = 1 AND b = 1""")
def mutual_nn(spark, sf_dir):
    """Descriptors of labels next to each other, within images of 200 vectors."""
    e = B.table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").withColumn("image", F.expr("vec_id div 200"))
    side = lambda label: e.select(label.cast("int").alias("label"), "image", F.col("vec_id").alias("id"), F.col("embedding").alias("descriptor"))
    out = matching.mutual_nearest(side(F.col("label")), side(F.pmod(F.col("label") + 9, F.lit(10))), ["label", "image"])
    return out.withColumn("score", F.round("score", 4))


def fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The homography of each pair's points, a third of which are strays."""
    x, y = G.project_or_origin(_h(), F.col("x0"), F.col("y0"))
    stray = F.col("idx") % 3 == 0
    t = B.points(spark, sf_dir).withColumn("x1", F.when(stray, F.col("idx") * 37 % 512).otherwise(x + F.col("dx"))).withColumn("y1", F.when(stray, F.col("idx") * 91 % 512).otherwise(y + F.col("dy")))
    return homography.homographies(t, ["pair"])


@query()
def ransac_fit(spark, sf_dir):
    """``fits``, rounded."""
    out = fits(spark, sf_dir)
    return out.select("pair", "matches", "inliers", F.round("reproj_mean", 6).alias("reproj_mean"), *[F.round(G.entry(F.col("h"), k // 3, k % 3), 6).alias(f"h{k}") for k in range(9)])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's frame, made at a known place, located among the 12 tiles of a small map."""
    tiles = tiling.grid(spark, 1280, 1024)
    # the true tile's origin is (512, 256); the frame's content lies there by a fixed similarity
    h = F.when((F.col("x_origin") == 512) & (F.col("y_origin") == 256), F.array(*[F.lit(float(v)) for v in (0.2696, -0.0141, -40.0, 0.0141, 0.2696, 100.0, 0.0, 0.0, 1.0)]))
    frames = B.table(spark, sf_dir, "events", "user_id", "event_id").groupBy("user_id").agg(F.max("event_id").alias("noise"))
    frames = frames.select(F.concat(F.lit("user_"), F.col("user_id")).alias("frame_id"), "noise")
    pairs = frames.crossJoin(F.broadcast(tiles)).withColumn("h", h)  # a frame meets each tile of its pool: 12 rows, by construction
    matches = matching.oracle(localize.spread(pairs), n_points=100, sigma=0.3)
    evaluated = localize.candidates(matches, tiles, (B.FRAME_W, B.FRAME_H), (1280, 1024), homography.Ransac())
    return localize.positions(evaluated)


@query()
def localize_flagship(spark, sf_dir):
    return flagship(spark, sf_dir)


def _all() -> None:
    """The other modules' queries register themselves here."""
    from skylocus import catalog_files, catalog_rows  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)
