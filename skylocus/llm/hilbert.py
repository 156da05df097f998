"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata dimensions are quantised to a few bits each, every row gets its
index on the Hilbert curve through that grid, the rows are ordered by the index,
and the order is cut into runs. A run covers a compact part of the grid, so a
filter on any of the dimensions finds most shards out by their ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common


def curve_steps(n: int) -> list[int]:
    """Transitions of the curve in ``n`` dimensions: ``state * 2**n + corner`` to ``next_state << n | digit``.

    A state is the entry corner and the main direction of a sub-cube,
    ``entry * n + direction``. The digit of a corner is its place on the reflected
    Gray code, after turning the sub-cube into the standard position.
    """
    full = (1 << n) - 1

    def turn_right(x: int, k: int) -> int:
        k %= n
        return ((x >> k) | (x << (n - k))) & full

    def gray(x: int) -> int:
        return x ^ (x >> 1)

    place = {gray(x): x for x in range(1 << n)}
    trailing_ones = [next(k for k in range(n + 2) if not x >> k & 1) for x in range(1 << n)]

    def entry_of(digit: int) -> int:
        return gray((digit - 1) // 2 * 2) if digit else 0

    def direction_of(digit: int) -> int:
        if digit == 0:
            return 0
        return trailing_ones[digit if digit % 2 else digit - 1] % n

    steps = []
    for state in range((1 << n) * n):
        entry, direction = divmod(state, n)
        for corner in range(1 << n):
            digit = place[turn_right(corner ^ entry, direction + 1)]
            new_entry = entry ^ turn_right(entry_of(digit), n - (direction + 1) % n)
            new_direction = (direction + direction_of(digit) + 1) % n
            steps.append((new_entry * n + new_direction) << n | digit)
    return steps


def curve_index(cells: list[Column], bits: int) -> Column:
    """The Hilbert index of a grid cell whose coordinates are ints of ``bits`` bits (``len(cells) * bits`` < 63)."""
    n = len(cells)
    if n < 2 or n * bits > 62:
        raise ValueError("a curve needs two dimensions or more, and fits 62 bits")
    steps = F.lit(curve_steps(n))
    cells_of = F.array(*[c.cast("int") for c in cells])

    def step(acc: Column, level: Column) -> Column:
        corner = F.aggregate(
            F.sequence(F.lit(0), F.lit(n - 1)),
            F.lit(0),
            lambda x, j: x + F.get(cells_of, j).bitwiseAND(F.call_function("shiftleft", F.lit(1), level)).cast("boolean").cast("int")
            * F.call_function("shiftleft", F.lit(1), j),
        )
        to = F.get(steps, acc["s"] * F.lit(1 << n) + corner)
        return F.struct(
            (acc["h"] * F.lit(1 << n) + to.bitwiseAND(F.lit((1 << n) - 1))).cast("long").alias("h"),
            F.shiftright(to, n).alias("s"),
        )

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda acc: acc["h"])


#: Classes that a dimension's values are counted in, at most.
CLASSES = 1 << 12


def category_class(value: Column) -> Column:
    """A category's class: the leading bits of its MD5 (null: as the empty string)."""
    return F.conv(F.substring(F.md5(F.coalesce(value, F.lit("")).cast("binary")), 1, 3), 16, 10).cast("int")


def size_class(value: Column) -> Column:
    """A positive size's class: 32 steps to each doubling, in whole numbers (null: as 1)."""
    v = F.greatest(F.coalesce(value, F.lit(1)), F.lit(1)).cast("long")
    length = F.length(F.bin(v))
    # five bits below the leading one
    step = F.when(length > 6, F.call_function("shiftright", v, F.greatest(length - 6, F.lit(0)))).otherwise(F.call_function("shiftleft", v, F.greatest(6 - length, F.lit(0))))
    return (length * 32 + step.bitwiseAND(F.lit(31).cast("long"))).cast("int")


def equal_cells(rows: DataFrame, classes: dict[str, Column], bits: int) -> DataFrame:
    """Add a cell of ``bits`` bits for each of ``classes`` (ints below ``CLASSES``): the share of rows in lower classes.

    So cells hold about equally many rows, as far as classes can be told apart, and the
    values of a dimension that has few are as far apart as the grid allows. The counts
    by class are at most ``CLASSES`` rows, which are broadcast.
    """
    names = rows.columns
    for name, value in classes.items():
        own = common.unused([*names, *classes], "class")
        numbered = rows.withColumn(own, value)
        counts = numbered.groupBy(own).agg(F.count(F.lit(1)).alias("n"))
        by_class = Window.orderBy(own)
        before = F.coalesce(F.sum("n").over(by_class.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        whole = F.sum("n").over(by_class.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        counts = counts.select(own, before.alias("before"), whole.alias("whole"))
        counts = counts.select(own, F.expr(f"(before * {1 << bits}) div whole").cast("int").alias(name))
        names = [*names, name]
        rows = numbered.join(F.broadcast(counts), own).select(*[F.col(f"`{c}`") for c in names])
    return rows


def shard(rows: DataFrame, cells: dict[str, Column], bits: int, n_shards: int, tie: list[str], keep: list[str]) -> DataFrame:
    """Deal ``rows`` into ``n_shards`` runs of the curve through ``cells``, row counts at most one apart.

    Returns ``keep``, the cells, ``curve``, ``shard`` and ``slot`` (gapless from 0
    in each shard). Rows of one cell follow ``tie``, which should end in a unique
    column; repeated rows take slots of their own. An empty table gives no rows.
    Null values have cells like any other. Columns besides those named are dropped
    first, so their names can't clash.
    """
    small = rows.select(*keep, *[c.cast("int").alias(name) for name, c in cells.items()])
    small = small.withColumn("curve", curve_index([F.col(name) for name in cells], bits))
    order = [F.col("curve").asc(), *[F.col(t).asc_nulls_first() for t in tie]]
    out = common.ranked(small, order)
    total = out.agg(F.count(F.lit(1)).alias("__total"))  # one row
    out = out.crossJoin(F.broadcast(total))
    out = out.withColumn("shard", F.expr(f"(rank * {n_shards}) div __total").cast("int"))
    first = F.expr(f"(shard * __total + {n_shards - 1}) div {n_shards}")
    return out.withColumn("slot", F.col("rank") - first).drop("rank", "__total")


def zone_map(sharded: DataFrame, cells: list[str]) -> DataFrame:
    """A row for each shard with its rows and the range of each dimension: what a reader prunes by."""
    ranges = [f(c).alias(f"{side}_{c}") for c in cells for side, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *ranges)


def prune(zones: DataFrame, wanted: dict[str, tuple[int, int]]) -> DataFrame:
    """The shards that can hold rows whose cells lie in the wanted ranges, both ends included."""
    for cell, (low, high) in wanted.items():
        zones = zones.filter((F.col(f"max_{cell}") >= low) & (F.col(f"min_{cell}") <= high))
    return zones.select("shard")
