"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Expected copies are whole numbers of this fraction, so that prefix sums are exact.
UNIT = 1 << 30


def targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """Targets of the sources by filling them alike, up to their caps.

    ``sizes``: a row for each source with ``source`` and ``source_size``. Sources
    take ``weights`` in turn, ordered by code point, null last. The mix takes
    ``share`` times all sizes, a target stops at ``cap`` times its source's size,
    and what is above is dealt again by weight until no target is above: then each
    target is the smaller of its cap and its weight times one common level. The level
    rises with the sources that it fills, each time an aggregate over all sources,
    until it fills no more. No sources give no rows.
    """
    order = [F.col("source").asc_nulls_last()]
    w = common.ranked(sizes.select("source", F.col("source_size").cast("long").alias("source_size")), order)
    turn = F.pmod("rank", F.lit(len(weights))).cast("int")
    w = w.select("source", "source_size", F.get(F.lit([float(x) for x in weights]), turn).alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("cap"))
    w = common.checkpoint(w)
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("cap") <= F.col("weight") * F.lit(level)
        whole, taken, open_weight = w.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            return w.select("source", "source_size", F.col("cap").alias("target"))
        higher = (whole * float(share) - (taken or 0.0)) / open_weight
        if level is not None and higher <= level:
            return w.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))
        level = higher


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source in units: from the seed and the name, so that reruns agree."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 7), 16, 10).cast("long") * (UNIT >> 28)


def mix(
    docs: DataFrame, weights: list[float], share: float = 1.5, cap: float = 2.0, seed: int = 0,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """How many copies of each document the mix takes.

    Returns a row for each row of ``docs``: ``doc_id``, ``source``, ``size`` (words;
    null text: 0), ``source_size``, ``target``, ``copies``. The expected copies are the
    same for all documents of a source, target / source_size, so their prefix sum at
    the r-th document is r times that, and no running sum is needed: the distributed
    rank gives it, however large the source is. Documents are ordered by size, so that
    the copies' words follow the target; a copy is taken for each whole number that
    prefix sum plus offset crosses, which is at most ``cap`` (a whole number, 4 at most) times.
    A null source is a source; sources without words take nothing; repeated rows
    count as documents of their own; an empty table gives no rows.
    """
    if cap > 4:
        raise ValueError("a document is taken 4 times at most")
    small = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows = common.ranked(small, [F.col("size").asc(), F.col("doc_id").asc_nulls_first()], group="source")
    rows = common.checkpoint(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, share, cap)
    goal = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long"))
    goal = goal.withColumn("offset", offset(F.col("source"), seed)).withColumnRenamed("source", "__source")
    out = rows.join(goal, F.col("source").eqNullSafe(F.col("__source")))
    return out.select("doc_id", "source", "size", "source_size", "target", (crossed("(rank + 1)") - crossed("rank")).alias("copies"))


def crossed(documents: str) -> Column:
    """The whole numbers that the expected copies of so many documents cross, from ``rate`` and ``offset`` in units.

    The number of documents is split, so that no product exceeds 62 bits however many there are.
    """
    return F.expr(f"({documents} div {UNIT}) * rate + (({documents} % {UNIT}) * rate + offset) div {UNIT}")


def taken_rows(docs: DataFrame, copies: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The mixed rows: every document as often as ``copies`` (doc_id, copies) says, with the columns of ``docs``.

    Rows that share an id (null included) share its copies as evenly as whole numbers go,
    by a distributed rank among them. Documents of which there are no copies, and ids
    without a document, give no rows; so do empty tables. Columns may have any names.
    """
    counts = copies.groupBy(F.col("doc_id").alias("id")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    counts = common.checkpoint(counts.filter("copies > 0"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(doc_id).alias("own_id"))
    out = rows.join(counts, F.col("own_id").eqNullSafe(F.col("id"))).select("doc", "id", "copies", "n")
    taken = out.filter("n = 1").select("doc", "copies")
    if not counts.filter("n > 1").isEmpty():
        some = out.filter("n > 1").withColumn("turn", F.monotonically_increasing_id())
        some = common.ranked(some, [F.col("turn")], group="id")
        taken = taken.unionByName(some.select("doc", (F.expr("copies div n") + F.when(F.col("rank") < F.expr("copies % n"), 1).otherwise(0)).alias("copies")))
    taken = taken.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select("doc.*")
