"""The engine's inputs derived from the driver's tables, in Spark and, with the same names, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAP_W, MAP_H, TILE = 6200, 4320, 512
FRAME_W, FRAME_H = 1920, 1080
#: A fixed homography of the point queries.
H = [0.27, -0.02, 20.0, 0.02, 0.27, 110.0, 1e-05, 0.0, 1.0]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    return t.selectExpr(
        "l_suppkey AS frame", "l_partkey % 384 + 1 AS tile", "l_orderkey AS k1", "l_linenumber AS k2", "l_extendedprice AS k3", "l_shipdate AS k4",
        "CAST(floor(l_quantity * 8D) AS BIGINT) AS matches", "CAST(floor(l_quantity * 8D * l_discount * 10D) AS BIGINT) AS inliers",
        "l_tax * 50D AS reproj_mean", "(l_suppkey % 100) * 6D - 40D AS center_x", "(l_partkey % 100) * 6D - 40D AS center_y",
        "512 AS tile_w", "512 AS tile_h", "l_returnflag <> 'N' AS plausible", "l_linenumber <> 7 AS homography_found",
        "(l_partkey % 24) * 256D + (l_suppkey % 100) * 6D < 6000D AS center_in_map",
    )


CAND = """cand AS (
 SELECT l_suppkey AS frame, l_partkey % 384 + 1 AS tile, l_orderkey AS k1, l_linenumber AS k2, l_extendedprice AS k3, l_shipdate AS k4,
  CAST(floor(l_quantity * 8e0) AS BIGINT) AS matches, CAST(floor(l_quantity * 8e0 * l_discount * 10e0) AS BIGINT) AS inliers,
  l_tax * 50e0 AS reproj_mean, (l_suppkey % 100) * 6e0 - 40e0 AS center_x, (l_partkey % 100) * 6e0 - 40e0 AS center_y,
  l_returnflag <> 'N' AS plausible, l_linenumber <> 7 AS homography_found,
  (l_partkey % 24) * 256e0 + (l_suppkey % 100) * 6e0 < 6000e0 AS center_in_map FROM lineitem),
ratio AS (SELECT *, CASE WHEN matches > 0 THEN inliers / CAST(matches AS DOUBLE) ELSE 0e0 END AS r FROM cand),
gated AS (SELECT *, CASE WHEN NOT homography_found THEN 'no_homography' ELSE concat_ws('; ',
  CASE WHEN NOT plausible THEN 'implausible' END, CASE WHEN inliers < 15 THEN 'few_inliers' END, CASE WHEN r < 15e-2 THEN 'low_ratio' END,
  CASE WHEN NOT reproj_mean <= 35e-1 THEN 'high_error' END,
  CASE WHEN NOT (center_x BETWEEN -30 AND 541 AND center_y BETWEEN -30 AND 541) THEN 'center_off_tile' END,
  CASE WHEN NOT center_in_map THEN 'center_off_map' END) END AS reasons FROM ratio),
scored AS (SELECT *, reasons = '' AS passed,
  CASE WHEN reasons = '' AND matches > 0 AND inliers > 0 THEN round(inliers * r * exp(-reproj_mean / 2e0), 6) ELSE 0e0 END AS score FROM gated)"""
TIES = ["tile", "k1", "k2", "k3", "k4"]
ORDER = "ORDER BY passed DESC, score DESC, inliers DESC, tile, k1, k2, k3, k4"


def homographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix for each part: most are plausible, some mirror, some have their horizon in the frame, some are flat."""
    return table(spark, sf_dir, "part", "p_partkey", "p_size").selectExpr(
        "p_partkey",
        "array(0.2D + (p_size % 50) * 2e-3D, ((p_partkey % 21) - 10) * 1e-2D, (p_partkey % 500) * 1D,"
        " ((p_partkey % 17) - 8) * 1e-2D, (CASE WHEN p_partkey % 29 = 0 THEN -1D ELSE 1D END) * (0.2D + (p_partkey % 13) * 1e-2D), p_size * 5D,"
        " CASE WHEN p_partkey % 31 = 0 THEN -1e-3D ELSE ((p_partkey % 11) - 5) * 1e-5D END, ((p_partkey % 7) - 3) * 2e-5D, 1D) AS h",
        "(p_partkey % 24) * 256 AS x_origin", "(p_partkey % 16) * 256 AS y_origin",
    )


HOMO = """homo AS (SELECT p_partkey, 2e-1 + (p_size % 50) * 2e-3 AS h0, ((p_partkey % 21) - 10) * 1e-2 AS h1, (p_partkey % 500) * 1e0 AS h2,
 ((p_partkey % 17) - 8) * 1e-2 AS h3, (CASE WHEN p_partkey % 29 = 0 THEN -1e0 ELSE 1e0 END) * (2e-1 + (p_partkey % 13) * 1e-2) AS h4, p_size * 5e0 AS h5,
 CASE WHEN p_partkey % 31 = 0 THEN -1e-3 ELSE ((p_partkey % 11) - 5) * 1e-5 END AS h6, ((p_partkey % 7) - 3) * 2e-5 AS h7,
 (p_partkey % 24) * 256 AS x_origin, (p_partkey % 16) * 256 AS y_origin FROM part)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a pair (a user) and, for most, their image under ``H`` some pixels off."""
    return table(spark, sf_dir, "events", "event_id", "user_id", "value").selectExpr(
        "user_id AS pair", "event_id AS idx", "value * 4D AS x0", "(event_id % 1080) * 1D AS y0", "(event_id % 7 - 3) * 0.5D AS dx", "(event_id % 5 - 2) * 0.5D AS dy",
    )


PTS = """pts AS (SELECT user_id AS pair, event_id AS idx, value * 4e0 AS x0, (event_id % 1080) * 1e0 AS y0, (event_id % 7 - 3) * 5e-1 AS dx, (event_id % 5 - 2) * 5e-1 AS dy FROM events),
mapped AS (SELECT *, 1e-05 * x0 + 0e0 * y0 + 1e0 AS w FROM pts),
errs AS (SELECT *, (27e-2 * x0 + -2e-2 * y0 + 20e0) / w AS u, (2e-2 * x0 + 27e-2 * y0 + 110e0) / w AS v FROM mapped)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment rows; some have no scene, and failed ones no metrics."""
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority").selectExpr(
        "o_orderkey AS pair_id", "o_orderstatus AS method", "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS scene_type",
        "o_orderkey % 4 <> 0 AS success", "CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 300 END AS inliers",
        "CASE WHEN o_orderkey % 8 <> 0 THEN o_totalprice END AS time_total", "(o_orderkey % 35) * 1e-1D AS reproj_mean", "o_custkey AS frame",
    )


RUNS = """runs AS (SELECT o_orderkey AS pair_id, o_orderstatus AS method, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS scene_type,
 o_orderkey % 4 <> 0 AS success, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 300 END AS inliers,
 CASE WHEN o_orderkey % 8 <> 0 THEN o_totalprice END AS time_total, (o_orderkey % 35) * 1e-1 AS reproj_mean, o_custkey AS frame FROM orders)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile registry with faults."""
    return table(spark, sf_dir, "part", "p_partkey", "p_size").selectExpr(
        "format_string('tile_%04d.png', p_partkey % 1900) AS tile_id", "(p_partkey % 25) * 256 AS x_origin", "(p_partkey div 25 % 17) * 256 AS y_origin",
        "CASE WHEN p_size = 1 THEN 500 ELSE 512 END AS width", "512 AS height",
    )


REG = """reg AS (SELECT printf('tile_%04d.png', p_partkey % 1900) AS tile_id, (p_partkey % 25) * 256 AS x_origin,
 (p_partkey // 25 % 17) * 256 AS y_origin, CASE WHEN p_size = 1 THEN 500 ELSE 512 END AS width, 512 AS height FROM part)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame registries, one for each user, with times some of which are off."""
    return table(spark, sf_dir, "events", "event_id", "user_id").selectExpr(
        "user_id AS video", "event_id AS frame_ord", "event_id - event_id % 3 AS source_frame_idx",
        "(event_id - event_id % 3) / 30D + CASE WHEN event_id % 17 = 0 THEN 1D ELSE 0D END AS timestamp_sec",
    )


FRAMES = """fr AS (SELECT user_id AS video, event_id AS frame_ord, event_id - event_id % 3 AS source_frame_idx,
 (event_id - event_id % 3) / 30e0 + CASE WHEN event_id % 17 = 0 THEN 1e0 ELSE 0e0 END AS timestamp_sec FROM events)"""
