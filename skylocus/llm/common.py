"""What the operators of this subpackage share: tables, checkpoints, ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The session's ``spark.checkpoint.dir`` names it. Where that is unset, one machine
    may do, and a temporary folder is made and set; a cluster has to name its own.
    """
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        set_dir = sc.getCheckpointDir()
        if not set_dir:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            set_dir = tempfile.mkdtemp(prefix="skylocus-")
            sc.setCheckpointDir(set_dir)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(set_dir)
    return set_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name, as a URI, in the shared folder."""
    base = shared_dir(spark).rstrip("/")
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    elif base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[len("file:"):]
    return f"{base}/{kind}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that lost executors lose no rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ranked(df: DataFrame, order: list[Column], group: str | None = None, rank: str = "rank") -> DataFrame:
    """Add each row's 0-based rank in ``order`` (within ``group``, if given).

    The rows are dealt by range and sorted in their partitions, once; the
    materialised rows carry the partition and the place in it. A rank is that
    place plus what the partitions before hold, from a table with a row for each
    partition (and group in it), so no group and no table meets in one task.
    With ``group``, rows are ordered by it first. ``order`` should end in a
    unique column: rows with equal keys rank in an arbitrary order.
    """
    keys = ([F.col(group).asc_nulls_first()] if group else []) + order
    at = "__at"
    df = checkpoint(df)  # dealing by range reads the rows twice, first for a sample
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    dealt = checkpoint(dealt)
    part = F.shiftright(F.col(at), 33)
    own = dealt.groupBy(part.alias("__part"), *([F.col(group).alias("__group")] if group else [])).agg(
        F.count(F.lit(1)).alias("__n"), F.min(at).alias("__first")
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    if group:
        before = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first"))
    on = part == F.col("__part")
    if group:
        on = on & F.col(group).eqNullSafe(F.col("__group"))
        return dealt.join(own, on).withColumn(rank, F.col(at) + F.col("__base")).drop("__group", "__part", "__n", "__first", "__base", at)
    # one row for each partition: small whatever the rows are
    return dealt.join(F.broadcast(own), on).withColumn(rank, F.col(at) + F.col("__base")).drop("__part", "__n", "__first", "__base", at)


def unused(columns: list[str], stem: str) -> str:
    """A name like ``stem`` that none of ``columns`` has, in any case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, at_least: int) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` in tables of ``at_least`` so many rows, but for the last; none ends amid a key's rows."""
    held: list[pa.RecordBatch] = []
    n, enough = 0, at_least
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n < enough:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = rows[key].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield rows.slice(0, cut)
        held, n = rows.slice(cut).to_batches(), n - cut
        enough = max(at_least, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def long_field(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())
