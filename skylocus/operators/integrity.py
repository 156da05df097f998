"""Data integrity as tables of violations: ``check`` (a code) and ``subject``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _found(df: DataFrame, check: str, subject) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.col(subject).cast("string").alias("subject") if isinstance(subject, str) else subject.cast("string").alias("subject"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def one(spark: SparkSession, check: str, subject: str) -> DataFrame:
    return spark.createDataFrame([(check, subject)], "check string, subject string")


def columns(df: DataFrame, subject: str) -> DataFrame:
    """The columns that have nulls (``nulls``), and ``no_rows`` of an empty table; in one pass."""
    nulls = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    each = F.array(F.when(F.col("__n") == 0, F.struct(F.lit("no_rows").alias("check"), F.lit(subject).alias("subject"))),
                   *[F.when(F.col(c) > 0, F.struct(F.lit("nulls").alias("check"), F.lit(c).alias("subject"))) for c in df.columns])
    return nulls.select(F.explode(F.array_compact(each)).alias("x")).select("x.*")


def sizes(df: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """Rows of another size than expected."""
    return _found(df.filter((F.col("width") != width) | (F.col("height") != height)), "size", key)


def uncovered(covered: DataFrame) -> DataFrame:
    """``not_covered`` with the number of pixels, if ``tiling.coverage`` found any."""
    return _found(covered.filter("uncovered_px > 0"), "not_covered", "uncovered_px")


def count_is(df: DataFrame, expected: int) -> DataFrame:
    """``count`` with the rows that there are, if these aren't as many as expected."""
    return _found(df.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != expected), "count", "n")


def sampled(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same for a seed however the rows are dealt: those whose hashed keys are smallest."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("__mark", mark).orderBy("__mark", key).limit(n).drop("__mark")


def sampled_by(df: DataFrame, by: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each group, as ``sampled``."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    first = Window.partitionBy(*by).orderBy(mark, key)
    return df.withColumn("__k", F.row_number().over(first)).filter(F.col("__k") <= n).drop("__k")


def pixels(compared: DataFrame, key: str) -> DataFrame:
    """What ``imaging.differences`` shows: files of other channels or sizes, and others whose pixels differ."""
    code = F.when(F.col("channels") != 3, "channels").when(F.col("max_abs_diff").isNull(), "file_size").when(F.col("max_abs_diff") > 0, "pixels")
    return compared.select(code.alias("check"), F.col(key).alias("subject")).filter("check IS NOT NULL")


def image_files(registry: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Files (``imaging.RAW``) of a registry that haven't three channels, or another size than it says."""
    there = files.select(F.col("name").alias(key), F.col("width").alias("file_w"), F.col("height").alias("file_h"), "channels")
    code = F.when(F.col("channels") != 3, "channels").when((F.col("file_w") != F.col("width")) | (F.col("file_h") != F.col("height")), "file_size")
    return registry.join(there, key).select(code.alias("check"), F.col(key).alias("subject")).filter("check IS NOT NULL")


def frame_figures(registry: DataFrame) -> DataFrame:
    """One row: how many frames, and the seconds from the first to the last by ``frame_ord``; null without any."""
    return registry.agg(F.count(F.lit(1)).alias("frames"), (F.max_by("timestamp_sec", "frame_ord") - F.min_by("timestamp_sec", "frame_ord")).alias("span_sec"))


def report(violations: DataFrame, most: int = 30) -> tuple[list[str], int]:
    """The first violations as lines, and how many there are: none is a pass."""
    n = violations.count()
    lines = [f"{r.check}: {r.subject}" for r in violations.orderBy("check", "subject").limit(most).collect()]
    return lines + ([f"... and {n - most} more"] if n > most else []), n


def duplicates(df: DataFrame, key: list[str], check: str) -> DataFrame:
    many = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _found(many, check, F.concat_ws(",", *key))


def tiles(registry: DataFrame, width: int, height: int, size: int | None = 512) -> DataFrame:
    """What is wrong with a tile registry: nulls, repeated ids and origins, sizes (if one is known), tiles beyond the map."""
    own = ["tile_id", "x_origin", "y_origin", "width", "height"]
    nulls = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in own])
    beyond = (F.col("x_origin") < 0) | (F.col("y_origin") < 0) | (F.col("x_origin") + F.col("width") > width) | (F.col("y_origin") + F.col("height") > height)
    # one scan gives all checks of single rows
    codes = F.array_compact(F.array(
        F.when(nulls, F.lit("null")),
        F.when((F.col("width") != size) | (F.col("height") != size), F.lit("size")) if size else F.lit(None).cast("string"),
        F.when(beyond, F.lit("beyond_map")),
    ))
    rows = registry.select(F.explode(codes).alias("check"), F.col("tile_id").alias("subject"))
    return union([rows, duplicates(registry, ["tile_id"], "duplicate_id"), duplicates(registry, ["x_origin", "y_origin"], "duplicate_origin")])


def frames(registry: DataFrame, fps: float | None, step: int | None, video: str = "video") -> DataFrame:
    """What is wrong with the frame registries of videos: repeated or falling indexes and times, other steps, times off the rate.

    Each frame is compared with the one before it by ``frame_ord`` in its video. Without
    a rate and a step, steps and times are only checked to rise.
    """
    before = Window.partitionBy(video).orderBy("frame_ord")
    idx, t = F.col("source_frame_idx"), F.col("timestamp_sec")
    rows = registry.withColumn("__idx", F.lag("source_frame_idx").over(before)).withColumn("__t", F.lag("timestamp_sec").over(before))
    rows = rows.withColumn("__k", F.row_number().over(before))
    known = bool(fps and step)
    true_t = idx / F.lit(float(fps or 1))
    codes = F.array_compact(F.array(
        F.when(idx <= F.col("__idx"), F.lit("index_order")),
        F.when(t < F.col("__t"), F.lit("time_order")),
        F.when(F.lit(known) & (idx - F.col("__idx") != (step or 1)), F.lit("step")),
        F.when(F.lit(known) & (F.abs(t - true_t) > F.lit(1e-4) + F.lit(1e-5) * F.abs(true_t)), F.lit("timestamp")),
        F.when(F.col("frame_ord") != F.col("__k"), F.lit("contiguous")),
    ))
    subject = F.concat_ws("/", F.col(video).cast("string"), F.col("frame_ord").cast("string"))
    return rows.select(F.explode(codes).alias("check"), subject.alias("subject"))


def files(listed: DataFrame, on_disk: DataFrame, name: str) -> DataFrame:
    """Names listed that aren't there (``missing``), and names there that aren't listed (``stale``)."""
    a, b = listed.select(name).distinct(), on_disk.select(name).distinct()
    return union([_found(a.join(b, name, "left_anti"), "missing", name), _found(b.join(a, name, "left_anti"), "stale", name)])
