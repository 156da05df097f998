"""Exact quantiles of few groups of very many values.

A sketch of bounded size brackets each quantile by two values that are surely below and
above it. A second pass counts what is below the bracket and how often each value in it
occurs, and the quantile is the value at its rank. No task holds a group's values, only
the small share of them that the bracket has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Of the sketch: ranks are off by one in so many at most.
ACCURACY = 10_000


def medians(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``<column>_median`` of each of ``columns`` in each group, the mean of the middle two; nulls don't count, and have no median."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]))
    long = rows.select(*by, pairs.alias("x")).select(*by, "x.metric", "x.value").filter("value IS NOT NULL")
    key = [*by, "metric"]
    slack = 4 / ACCURACY
    ends = long.groupBy(*key).agg(F.percentile_approx("value", [0.5 - slack, 0.5 + slack], ACCURACY).alias("ends"), F.count(F.lit(1)).alias("n"))
    ends = ends.select(*key, F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"), "n")
    near = long.join(ends, key).withColumn("place", F.when(F.col("value") < F.col("low"), -1).when(F.col("value") > F.col("high"), 1).otherwise(0))
    # one row for all that is below, and one for each value in the bracket
    value = F.when(F.col("place") == 0, F.col("value"))
    counts = near.filter("place <= 0").groupBy(*key, "n", value.alias("value")).agg(F.count(F.lit(1)).alias("times"))
    # dealt by the group once, for what follows: a bracket is small
    counts = counts.repartition(*by)
    upto = F.sum("times").over(Window.partitionBy(*key).orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).filter("value IS NOT NULL")
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("value")))
    middle = ranked.groupBy(*key).agg(at(F.expr("(n - 1) div 2")).alias("a"), at(F.expr("n div 2")).alias("b"))
    missed = F.raise_error(F.lit("a median lies outside its bracket")).cast("double")
    middle = middle.withColumn("median", F.coalesce((F.col("a") + F.col("b")) / 2, missed))
    return middle.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == c, F.col("median"))).alias(f"{c}_median") for c in columns])
