"""The search: frames against tiles, to verified pairs, ranked candidates and positions on the map."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylocus.functions import geometry as G
from skylocus.operators import homography, matching, scoring


@dataclass(frozen=True)
class Pipeline:
    """What a pair goes through. Frames are resized by ``frame_scale``, tiles by ``work_scale``."""

    frame_to_map_scale: float = 0.27
    work_scale: float = 1.0
    min_inliers: int = 15
    ransac: homography.Ransac = field(default_factory=homography.Ransac)
    check_plausibility: bool = True
    scale_tolerance: float = 2.0
    max_anisotropy: float = 1.5

    @property
    def frame_scale(self) -> float:
        return self.frame_to_map_scale * self.work_scale

    def to_dict(self) -> dict:
        return asdict(self)


def spread(pairs: DataFrame) -> DataFrame:
    """Pairs, before they have points, dealt to all cores: a pair is some bytes but takes some milliseconds, and adaptive execution would merge them by bytes."""
    spark = pairs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return pairs.repartition(n, "frame_id", "tile_id")


def with_tiles(pairs: DataFrame, tiles: DataFrame) -> DataFrame:
    """The pairs with the registry's columns of their tiles; a tile that isn't in the registry raises."""
    registry = tiles.withColumnRenamed("tile_id", "__tile_id").withColumn("__known", F.lit(True))
    out = pairs.join(registry, F.col("tile_id") == F.col("__tile_id"), "left")
    unknown = F.raise_error(F.concat(F.lit("unknown tile "), F.coalesce("tile_id", F.lit("null")))).cast("boolean")
    # the check is a filter's condition, so that no later projection drops it
    return out.filter(F.coalesce("__known", unknown)).drop("__tile_id", "__known")


def verify(pairs: DataFrame, tiles: DataFrame, frame_size: tuple[Column, Column], config: Pipeline = Pipeline(), by: list[str] = ("frame_id", "tile_id"), with_mask: bool = False) -> DataFrame:
    """Matches (arrays in a row for each pair) to homographies, diagnostics, ``success`` and ``failure_reason``, and the frame's centre on the tile and the map."""
    w, h = frame_size
    found = with_tiles(homography.solve(pairs, list(by), config.ransac, with_mask), tiles)
    out = G.diagnose(found, F.col("h"), w, h, config.frame_to_map_scale, config.scale_tolerance, config.max_anisotropy)
    success, why = scoring.outcome(*(F.col(c) for c in ("h", "matches", "inliers", "plausible", "reasons")), config.min_inliers, config.check_plausibility)
    cx, cy = G.project(F.col("h"), *G.center(w, h))
    out = out.withColumns({"success": success, "failure_reason": why, "center_x": cx, "center_y": cy})
    return out.withColumns({"center_x_map": F.col("center_x") + F.col("x_origin"), "center_y_map": F.col("center_y") + F.col("y_origin")})


def evaluate(verified: DataFrame, map_size: tuple[int, int], gate: scoring.Gate = scoring.Gate()) -> DataFrame:
    """Verified pairs as candidates that the gate has judged."""
    out = verified.withColumns({
        "homography_found": F.col("h").isNotNull(), "tile_w": F.col("width"), "tile_h": F.col("height"),
        "x_map": F.col("center_x_map"), "y_map": F.col("center_y_map"), "plausible": F.coalesce("plausible", F.lit(False)),
    })
    out = out.withColumn("center_in_map", G.inside(F.col("x_map"), F.col("y_map"), *(F.lit(v) for v in map_size)))
    return scoring.evaluate(out, gate)


def candidates(pairs: DataFrame, tiles: DataFrame, frame_size: tuple[int, int], map_size: tuple[int, int], ransac: homography.Ransac = homography.Ransac(), gate: scoring.Gate = scoring.Gate()) -> DataFrame:
    """Matches of frames and tiles to evaluated candidates with centre and position on the map. Only the registry is joined."""
    size = tuple(F.lit(v) for v in frame_size)
    return evaluate(verify(pairs, tiles, size, Pipeline(ransac=ransac)), map_size, gate)


def search(frames: DataFrame, tiles: DataFrame, pool: DataFrame, matcher: matching.ImageMatcher, map_size: tuple[int, int], config: Pipeline = Pipeline(),
           gate: scoring.Gate = scoring.Gate(), cached: DataFrame | None = None) -> DataFrame:
    """Every frame image against every tile of its pool, evaluated and ranked.

    ``frames`` are images (``image_id``, ``width``, ``height``, ``rgb``), and so are
    ``tiles`` unless their features are ``cached``; ``pool`` is the registry of the tiles to
    search. Features are computed once for an image. A frame meets each tile of its pool,
    whose number the map bounds.
    """
    of_frames = matching.extract(frames, matcher, config.frame_scale)
    of_tiles = matching.extract(tiles, matcher, config.work_scale) if cached is None else cached
    pairs = spread(frames.select(F.col("image_id").alias("frame_id")).crossJoin(F.broadcast(pool.select("tile_id"))))
    matched = matching.match(pairs, of_frames, of_tiles, matcher, cached is not None)
    verified = verify(matched, pool, (F.col("frame_w"), F.col("frame_h")), config)
    return scoring.rank(evaluate(verified, map_size, gate), ["frame_id"], ["tile_ord"])


def footprint(h, width, height, x_origin, y_origin) -> dict:
    """The frame's corners on the map, as columns ``x_tl`` ... ``y_bl``."""
    out = {}
    for name, (x, y) in zip(("tl", "tr", "br", "bl"), G.corners(width, height), strict=True):
        u, v = G.project(h, x, y)
        out[f"x_{name}"], out[f"y_{name}"] = u + x_origin, v + y_origin
    return out


def positions(evaluated: DataFrame) -> DataFrame:
    """The winner of each frame: its tile, position and score."""
    return scoring.winners(evaluated, ["frame_id"], ["tile_ord"]).select("frame_id", "tile_id", "x_map", "y_map", "matches", "inliers", "score")
