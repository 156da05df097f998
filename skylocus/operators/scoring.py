"""Candidate gates, scores and ranks, and the summaries of experiments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylocus.functions import geometry as G
from skylocus.operators import quantiles


@dataclass(frozen=True)
class Gate:
    """What a candidate must reach."""

    min_inliers: int = 15
    min_inlier_ratio: float = 0.15
    max_reproj_error: float = 3.5
    center_margin: float = 30.0
    score_sigma: float = 2.0


def inlier_ratio(inliers: Column, matches: Column) -> Column:
    return F.when(matches > 0, inliers / F.when(matches > 0, matches)).otherwise(0.0)


def score(inliers: Column, matches: Column, error: Column, sigma: float) -> Column:
    """Inliers, their share and the error in one number; zero without matches or inliers."""
    return F.when((matches > 0) & (inliers > 0), inliers * inlier_ratio(inliers, matches) * F.exp(-error / G.lit(sigma))).otherwise(0.0)


#: Why a candidate is rejected, in order; without a homography that is the only reason.
REJECTED, NO_HOMOGRAPHY = ["implausible", "few_inliers", "low_ratio", "high_error", "center_off_tile", "center_off_map"], "no_homography"


def evaluate(candidates: DataFrame, gate: Gate = Gate(), digits: int | None = None) -> DataFrame:
    """Add ``gate_mask``, ``gate_reasons`` (codes), ``passed`` and ``score`` to candidates.

    They have ``homography_found``, ``plausible``, ``matches``, ``inliers``, ``reproj_mean``,
    ``center_x``, ``center_y``, ``tile_w``, ``tile_h`` and ``center_in_map``. A rejected
    candidate scores zero. The reasons are an int until the end, so that ranks and scores
    need no arrays.
    """
    c = F.col
    others = G.reason_mask(
        ~c("plausible"),
        c("inliers") < gate.min_inliers,
        inlier_ratio(c("inliers"), c("matches")) < gate.min_inlier_ratio,
        ~F.coalesce(c("reproj_mean") <= gate.max_reproj_error, F.lit(False)),
        ~G.inside(c("center_x"), c("center_y"), c("tile_w"), c("tile_h"), gate.center_margin),
        ~F.coalesce(c("center_in_map"), F.lit(False)),
    )
    mask = F.when(F.coalesce(c("homography_found"), F.lit(False)), others).otherwise(1 << len(REJECTED))
    out = candidates.withColumn("gate_mask", mask)
    out = out.withColumns({"gate_reasons": G.reason_codes(c("gate_mask"), REJECTED, NO_HOMOGRAPHY), "passed": c("gate_mask") == 0})
    value = score(c("inliers"), c("matches"), c("reproj_mean"), gate.score_sigma)
    if digits is not None:
        value = F.round(value, digits)
    return out.withColumn("score", F.when(c("gate_mask") == 0, value).otherwise(0.0))


def _best_first(ties: list[str]) -> list[Column]:
    return [F.col("passed").desc(), F.col("score").desc(), F.col("inliers").desc(), *[F.col(t).asc() for t in ties]]


def rank(evaluated: DataFrame, by: list[str], ties: list[str], k: int | None = None) -> DataFrame:
    """Add ``rank`` (from 1) in each group ``by``; ``k`` keeps the first ones, before the shuffle where Spark can."""
    out = evaluated.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*_best_first(ties))))
    return out if k is None else out.filter(F.col("rank") <= k)


def winners(evaluated: DataFrame, by: list[str], ties: list[str]) -> DataFrame:
    """The best candidate of each group that has one that passed.

    Those that passed rank first, so the filter can follow: pushed below, it would
    repeat the whole expression of the gate.
    """
    return rank(evaluated, by, ties, 1).filter("passed")


def margin(evaluated: DataFrame, by: list[str], ties: list[str]) -> DataFrame:
    """For each group's winner its score over that of the next that passed (null without one, or at zero)."""
    first_two = rank(evaluated, by, ties, 2).filter("passed")
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    return first_two.groupBy(*by).agg(at(1).alias("best"), at(2).alias("second")).withColumn(
        "margin", F.when(F.col("second") > 0, F.col("best") / F.when(F.col("second") > 0, F.col("second")))
    )


def summarize(runs: DataFrame, by: list[str], means: list[str], medians: list[str], success_means: list[str]) -> DataFrame:
    """Runs, share of success, means and medians by key, and means over successes. Rows with a null key go.

    Few keys may have very many runs, so medians come from ``quantiles.medians``, which
    holds no group's values.
    """
    runs = runs.dropna(subset=by)
    aggs = [F.count("pair_id").alias("runs"), F.avg(F.col("success").cast("double")).alias("success_rate")]
    aggs += [F.avg(c).alias(f"{c}_mean") for c in means]
    aggs += [F.avg(F.when(F.col("success"), F.col(c))).alias(f"{c}_success_mean") for c in success_means]
    out = runs.groupBy(*by).agg(*aggs)
    if medians:
        out = out.join(quantiles.medians(runs, by, medians), by, "left")
    order = ["runs", "success_rate", *[f"{c}_mean" for c in means], *[f"{c}_median" for c in medians], *[f"{c}_success_mean" for c in success_means]]
    return out.select(*by, *order)


def error_stats(errors: DataFrame, by: list[str], error: str = "error") -> DataFrame:
    """Mean, median, root mean square and maximum of the finite errors; null without any."""
    e = F.when(~F.isnan(error) & (F.abs(error) < float("inf")), F.col(error))
    return errors.withColumn("__e", e).groupBy(*by).agg(
        F.count("__e").alias("n"), F.avg("__e").alias("reproj_mean"), F.median("__e").alias("reproj_median"),
        F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("reproj_rmse"), F.max("__e").alias("reproj_max"),
    )


def localization_stats(errors: DataFrame, by: list[str], error: str = "error") -> DataFrame:
    """Count, mean, median and 90th percentile (nearest rank) of localization errors."""
    return errors.groupBy(*by).agg(
        F.count(error).alias("n"), F.avg(error).alias("mean"), F.median(error).alias("median"),
        F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY `{error}`)").alias("p90"),
    )


def timing_medians(runs: DataFrame, by: list[str], times: list[str], repeat: str = "run", firsts: list[str] = ()) -> DataFrame:
    """Over the repeats of a run: the medians of its times, and the values ``firsts`` of the first repeat. A run has a few repeats."""
    first = [F.min_by(c, repeat).alias(c) for c in firsts]
    return runs.groupBy(*by).agg(F.count(repeat).alias("repeats"), *[F.median(t).alias(f"{t}_median") for t in times], *first)


def search_timings(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Of each search: the sums of its candidates' times, and their mean for a candidate. Times that are null count as none."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    out = candidates.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tiles_checked"), F.max("time_extract_frame").alias("frame_extract"), total("time_extract_tile").alias("tile_extract_sum"),
        total("time_match").alias("match_sum"), total("time_ransac").alias("ransac_sum"),
    )
    return out.withColumn("per_tile_mean", F.expr("(tile_extract_sum + match_sum + ransac_sum) / greatest(1, tiles_checked)"))


def outcome(h: Column, matches: Column, inliers: Column, plausible: Column, reasons: Column, min_inliers: int = 15, check_plausibility: bool = True) -> tuple[Column, Column]:
    """Whether a pair of images is matched, and why not: the first of too few matches, no homography, too few inliers, implausible."""
    why = F.when(h.isNull(), F.when(matches < 4, "fewer than 4 matches").otherwise("no homography"))
    why = why.when(inliers < min_inliers, F.concat(F.lit("inliers "), inliers.cast("string"), F.lit(f" < {min_inliers}")))
    if check_plausibility:
        why = why.when(~F.coalesce(plausible, F.lit(False)), F.concat_ws("; ", reasons))
    why = why.otherwise("")
    return why == "", why


#: The columns of a pair's flat row, in order.
PAIR_ROW = [
    "frame_work_w", "frame_work_h", "tile_work_w", "tile_work_h", "keypoints_frame", "keypoints_tile", "matches", "inliers", "inlier_ratio",
    "reproj_mean", "reproj_median", "reproj_rmse", "reproj_max", "mean_confidence", "h_scale", "h_rotation_deg", "h_anisotropy", "h_plausible",
    "success", "failure_reason", "center_x_map", "center_y_map",
    "time_extract_frame", "time_extract_tile", "time_match", "time_matcher_total", "time_ransac",
]


def pair_rows(verified: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the 27 columns of ``PAIR_ROW``; a column that ``verified`` lacks is null, ratio and total time are computed.

    Confidences are averaged where ``conf`` (an array) is there; no matches have no mean.
    """
    c = F.col
    have = set(verified.columns)
    made = {
        "inlier_ratio": inlier_ratio(c("inliers"), c("matches")),
        "time_matcher_total": c("time_extract_frame") + c("time_extract_tile") + c("time_match"),
    }
    if "conf" in have:
        mean = F.aggregate("conf", F.lit(0.0), lambda a, x: a + x) / F.when(F.size("conf") > 0, F.size("conf"))
        made["mean_confidence"] = F.when(F.size("conf") > 0, mean)
    if "plausible" in have:
        made["h_plausible"] = c("plausible")
    return verified.select(*keys, *[(made[x] if x in made else c(x) if x in have else F.lit(None).cast("double")).alias(x) for x in PAIR_ROW])


def candidate_rows(evaluated: DataFrame) -> DataFrame:
    """Ranked candidates as flat rows: the gate's columns, then the pair's."""
    pair = pair_rows(evaluated, ["frame_id", "rank", "tile_id", "x_origin", "y_origin", "passed", "score", "gate_reasons", "center_x", "center_y"])
    out = pair.withColumn("gate_reasons", F.concat_ws("; ", "gate_reasons"))
    return out.withColumnsRenamed({"center_x": "center_x_local", "center_y": "center_y_local"})
