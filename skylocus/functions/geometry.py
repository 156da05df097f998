"""Projective geometry as Column expressions.

A homography is an ``array<double>`` of nine values, row by row, null where none was
found. Points are (column, row) pixel centres. Null stands for "not computed" and for
a point at infinity; NaN never enters a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Denominators below this count as zero.
TINY = 1e-12
#: Below this they count as zero where zero is the image.
EPS = 2.220446049250313e-16


def lit(x: float) -> Column:
    return F.lit(float(x))


def entry(h: Column, row: int, col: int) -> Column:
    return F.get(h, F.lit(3 * row + col))


def _dot(h: Column, row: int, x: Column, y: Column) -> Column:
    return entry(h, row, 0) * x + entry(h, row, 1) * y + entry(h, row, 2)


def denominator(h: Column, x: Column, y: Column) -> Column:
    return _dot(h, 2, x, y)


def project(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The image of a point; null at infinity."""
    w = denominator(h, x, y)
    away = F.abs(w) < TINY
    return tuple(F.when(away, None).otherwise(_dot(h, k, x, y) / F.when(away, None).otherwise(w)) for k in (0, 1))


def project_or_origin(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The image of a point; zero where the denominator is zero, as errors and diagnostics take it."""
    w = denominator(h, x, y)
    zero = F.abs(w) < EPS
    safe = F.when(zero, None).otherwise(w)
    return tuple(F.when(h.isNull(), None).when(zero, 0.0).otherwise(_dot(h, k, x, y) / safe) for k in (0, 1))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1))


def reprojection_error(h: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    x, y = project_or_origin(h, x0, y0)
    return distance(x, y, x1, y1)


def center(width: Column, height: Column) -> tuple[Column, Column]:
    return (width - 1) / lit(2), (height - 1) / lit(2)


def corners(width: Column, height: Column) -> list[tuple[Column, Column]]:
    """Pixel centres at top left, top right, bottom right, bottom left."""
    right, bottom = (width - 1).cast("double"), (height - 1).cast("double")
    return [(lit(0), lit(0)), (right, lit(0)), (right, bottom), (lit(0), bottom)]


def to_work(p: Column, scale: Column) -> Column:
    return (p + 0.5) * scale - 0.5


def to_original(p: Column, scale: Column) -> Column:
    return (p + 0.5) / scale - 0.5


def scaled_side(side: Column, scale: Column, multiple: int = 1) -> Column:
    """A side at another scale, rounded half to even to a multiple, which is the least."""
    m = lit(multiple)
    return F.greatest(m, F.rint(side * scale / m) * m).cast("long")


def inside(x: Column, y: Column, width: Column, height: Column, margin: float = 0.0) -> Column:
    """Whether a point lies within the pixel centres, widened by a margin, ends included; null is outside."""
    x_in = x.between(lit(-margin), width - 1 + lit(margin))
    y_in = y.between(lit(-margin), height - 1 + lit(margin))
    return F.coalesce(x_in & y_in, F.lit(False))


def with_spread(df: DataFrame, h: Column, x: Column, y: Column) -> DataFrame:
    """Add scale, rotation in degrees, anisotropy (null where singular) and determinant of the Jacobian at a point: ``h_scale`` ... ``h_det``.

    Each step is a projection of its own, so that no value is computed twice.
    """
    w = denominator(h, x, y)
    out = df.withColumn("__w", F.when(F.abs(w) >= TINY, w))
    out = out.withColumns({"__u": _dot(h, 0, x, y) / F.col("__w"), "__v": _dot(h, 1, x, y) / F.col("__w")})
    j = {}
    for name, row, value in (("x", 0, "__u"), ("y", 1, "__v")):
        for by, col in (("x", 0), ("y", 1)):
            j[f"__j{name}{by}"] = (entry(h, row, col) - F.col(value) * entry(h, 2, col)) / F.col("__w")
    out = out.withColumns(j)
    out = out.withColumns({
        "h_det": F.expr("__jxx * __jyy - __jxy * __jyx"),
        "__q": F.expr("__jxx * __jxx + __jxy * __jxy + __jyx * __jyx + __jyy * __jyy"),
    })
    out = out.withColumn("__large", F.expr("sqrt((__q + sqrt(greatest(__q * __q - 4 * h_det * h_det, 0D))) / 2)"))
    out = out.withColumn("__small", F.expr("CASE WHEN __large > 0 THEN abs(h_det) / nullif(__large, 0D) END"))
    out = out.withColumns({
        "h_scale": F.expr("sqrt(abs(h_det))"),
        "h_rotation_deg": F.expr("degrees(atan2(__jyx - __jxy, __jxx + __jyy))"),
        "h_anisotropy": F.when(F.col("__small") > TINY, F.expr("__large / nullif(__small, 0D)")),
    })
    return out.drop("__w", "__u", "__v", *j, "__q", "__large", "__small")


def convex(quad: list[tuple[Column, Column]]) -> Column:
    """Whether four points turn the same way at every corner."""
    turns = []
    for k in range(4):
        (ax, ay), (bx, by), (cx, cy) = (quad[(k + i) % 4] for i in range(3))
        turns.append((bx - ax) * (cy - by) - (by - ay) * (cx - bx))
    return (F.least(*turns) > 0) | (F.greatest(*turns) < 0)


def reason_mask(*checks: Column) -> Column:
    """A bit for each check that holds, the first the lowest; a null check doesn't hold."""
    mask = F.lit(0)
    for k, check in enumerate(checks):
        mask = mask + F.when(check, 1 << k).otherwise(0)
    return mask


def reason_codes(mask: Column, names: list[str], alone: str | None = None) -> Column:
    """The names of a mask's bits, in order; ``alone`` is that of a bit above, which comes without others.

    Looked up in a constant table, which Spark generates code for.
    """
    table = [F.array(*[F.lit(n) for k, n in enumerate(names) if m >> k & 1]).cast("array<string>") for m in range(1 << len(names))]
    if alone is not None:
        table.append(F.array(F.lit(alone)))
    return F.get(F.array(*table), mask)


#: What makes a homography implausible, in order.
IMPLAUSIBLE = ["infinity", "reflection", "not_convex", "anisotropy", "scale"]


def diagnose(df: DataFrame, h: Column, width: Column, height: Column, expected_scale: float | None = 0.27, tolerance: float = 2.0, max_anisotropy: float = 1.5) -> DataFrame:
    """Add ``h_scale``, ``h_rotation_deg``, ``h_anisotropy``, ``h_det``, ``reasons`` (of ``IMPLAUSIBLE``) and ``plausible``; null without a homography."""
    quad = corners(width, height)
    out = with_spread(df, h, *center(width, height))
    out = out.withColumns({f"__w{k}": denominator(h, x, y) for k, (x, y) in enumerate(quad)})
    image = {}
    for k, (x, y) in enumerate(quad):
        zero = F.abs(F.col(f"__w{k}")) < EPS
        for axis, row in (("x", 0), ("y", 1)):
            image[f"__{axis}{k}"] = F.when(zero, 0.0).otherwise(_dot(h, row, x, y) / F.when(zero, None).otherwise(F.col(f"__w{k}")))
    out = out.withColumns(image)
    w = [F.col(f"__w{k}") for k in range(4)]
    in_scale = F.lit(True)
    if expected_scale is not None:
        in_scale = F.coalesce(F.col("h_scale").between(lit(expected_scale / tolerance), lit(expected_scale * tolerance)), F.lit(False))
    mask = reason_mask(
        ~((F.least(*w) > 0) | (F.greatest(*w) < 0)),
        ~F.coalesce(F.col("h_det") > 0, F.lit(False)),
        ~convex([(F.col(f"__x{k}"), F.col(f"__y{k}")) for k in range(4)]),
        F.coalesce(F.col("h_anisotropy") > max_anisotropy, F.lit(True)),
        ~in_scale,
    )
    out = out.withColumn("__mask", F.when(h.isNotNull(), mask))
    out = out.withColumns({"reasons": reason_codes(F.col("__mask"), IMPLAUSIBLE), "plausible": F.col("__mask") == 0}).drop("__mask")
    return out.drop(*image, *[f"__w{k}" for k in range(4)])
