"""Robust homographies from point correspondences, a pair of images to a row."""

from __future__ import annotations

import functools
import itertools
import math
import os
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METHODS = ("RANSAC", "USAC_MAGSAC")


@dataclass(frozen=True)
class Ransac:
    method: str = "RANSAC"
    threshold: float = 3.0
    confidence: float = 0.999
    max_iters: int = 5000
    seed: int | None = 0

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}; there are {METHODS}")


def _normaliser(p: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Moves the weighted centroid to the origin and the mean distance to sqrt(2)."""
    total = w.sum()
    mid = w @ p / total
    far = w @ np.hypot(*(p - mid).T) / total
    s = math.sqrt(2) / far if far > 0 else 1.0
    return np.array([[s, 0, -s * mid[0]], [0, s, -s * mid[1]], [0, 0, 1.0]])


def _move(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p * t[0, 0] + t[:2, 2]


def _back(t: np.ndarray) -> np.ndarray:
    """The inverse of a normaliser."""
    s = t[0, 0]
    return np.array([[1 / s, 0, -t[0, 2] / s], [0, 1 / s, -t[1, 2] / s], [0, 0, 1.0]])


def fit(p: np.ndarray, q: np.ndarray, w: np.ndarray | None = None) -> np.ndarray | None:
    """The homography that takes ``p`` to ``q`` with the least algebraic error, weighted."""
    n, one = len(p), np.ones(len(p))
    tp, tq = (_normaliser(x, one if w is None else w) for x in (p, q))
    x, image = np.empty((n, 3)), _move(tq, q)
    x[:, :2], x[:, 2] = _move(tp, p), one
    a = np.zeros((2 * n, 9))
    a[:n, :3] = a[n:, 3:6] = x
    np.multiply(x, -image[:, :1], out=a[:n, 6:])
    np.multiply(x, -image[:, 1:], out=a[n:, 6:])
    if w is not None:
        a *= np.sqrt(np.concatenate([w, w]))[:, None]
    # the smallest eigenvector of a 9 x 9 matrix, however many points there are
    _, vectors = np.linalg.eigh(a.T @ a)
    return _scaled(_back(tq) @ vectors[:, 0].reshape(3, 3) @ tp)


def _scaled(h: np.ndarray) -> np.ndarray | None:
    if not np.isfinite(h).all() or abs(h[2, 2]) < 1e-12:
        return None
    return h / h[2, 2]


def errors(h: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    m = p @ h[:, :2].T + h[:, 2]
    w = m[:, 2:]
    flat = np.abs(w) < np.finfo(float).eps
    if flat.any():
        w = np.where(flat, np.inf, w)
    off = m[:, :2] / w - q
    return np.hypot(off[:, 0], off[:, 1])


def _areas(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Twice the signed areas (4, k) of the triangles that three of four points (4, k) make: with the fourth in place of each of the first three, and those three."""
    x, y = x[1:] - x[0], y[1:] - y[0]
    out = np.empty((4, x.shape[1]))
    for k, (i, j) in enumerate(((2, 1), (0, 2), (0, 1)), 1):
        np.subtract(x[i] * y[j], y[i] * x[j], out=out[k])
    np.subtract(out[3] - out[1], out[2], out=out[0])
    return out


#: Twice the area up to which a triangle is flat.
FLAT = 1e-3


def _sound(s: np.ndarray, t: np.ndarray, flat: tuple[float, float] = (FLAT, FLAT)) -> np.ndarray:
    """Which samples have no flat triangle, and turn either all triangles around or none."""
    turned = s * t
    alike = (turned.min(axis=0) > 0) | (turned.max(axis=0) < 0)
    return alike & (np.abs(s).min(axis=0) > flat[0]) & (np.abs(t).min(axis=0) > flat[1])


def _from_four(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, s: np.ndarray | None = None, t: np.ndarray | None = None) -> np.ndarray:
    """Homographies (k, 3, 3), each of some scale, that take k samples of four points x, y (4, k) to u, v, whose areas may be given.

    The areas of the triangles are the coefficients of the fourth point in the basis of
    the others, on either side, and the homography takes one basis to the other.
    """
    s, t = _areas(x, y) if s is None else s, _areas(u, v) if t is None else t
    i, j = [1, 2, 0], [2, 0, 1]
    # the planes through two points of the basis, as rows
    rows = np.stack([y[i] - y[j], x[j] - x[i], x[i] * y[j] - x[j] * y[i]], axis=1)
    # the basis change, without divisions: a coefficient on the right times the others on the left
    scale = t[:3] * s[i] * s[j]
    images = np.stack([u[:3] * scale, v[:3] * scale, scale])
    h = images[:, 0, None] * rows[0]
    for k in (1, 2):
        h += images[:, k, None] * rows[k]
    h /= np.abs(h).max(axis=(0, 1))
    return np.moveaxis(h, 2, 0)


def _four_of(rng: np.random.Generator, n: int, k: int) -> np.ndarray:
    """``k`` samples (4, k) of four distinct numbers below ``n``: each is drawn from those left, and moved past the ones before it, the smallest first."""
    a, b, c, d = (rng.integers(0, n - j, k) for j in range(4))
    b += b >= a
    low, high = np.minimum(a, b), np.maximum(a, b)
    c += c >= low
    c += c >= high
    low, middle, high = np.minimum(low, c), np.maximum(low, np.minimum(high, c)), np.maximum(high, c)
    for taken in (low, middle, high):
        d += d >= taken
    return np.stack([a, b, c, d])


@functools.lru_cache(maxsize=64)
def _samples(seed: int, sequence: int, n: int, block: int) -> np.ndarray:
    """A block of one of the seed's sequences of samples of ``n`` points; read-only, as pairs share it."""
    out = _four_of(np.random.default_rng([seed, sequence, n, block]), n, FIRST_DRAWS if block == 0 else DRAWS)
    out.flags.writeable = False
    return out


def _point_rows(p: np.ndarray, q: np.ndarray, reach: float) -> np.ndarray:
    """What a homography's nine entries are multiplied by (3n, 9) for the differences of each point's image in x and in y, and ``reach``, all times the denominator."""
    one, zero = np.ones((len(p), 1)), np.zeros((len(p), 3))
    x = np.concatenate([p, one], axis=1)
    return np.concatenate([
        np.concatenate([x, zero, -q[:, :1] * x], axis=1), np.concatenate([zero, x, -q[:, 1:] * x], axis=1), np.concatenate([zero, zero, reach * x], axis=1),
    ]).astype(np.float32)


def _hits(inside: np.ndarray) -> np.ndarray:
    """How many of each column (n, k) of booleans hold; bytes are added as bytes while they can't overflow."""
    flags = inside.view(np.uint8)
    if len(flags) <= 255:
        return np.add.reduce(flags, axis=0, dtype=np.uint8)
    return sum(np.add.reduce(flags[k : k + 255], axis=0, dtype=np.uint8).astype(np.int64) for k in range(0, len(flags), 255))


def _sought(best: list) -> int:
    """What a further sample's points must be above, given the best ones so far: the best's, or what chance brings about and the last's of those kept."""
    return max(best[-1][0] if len(best) == KEPT else 3, min(best[0][0], BY_CHANCE - 1)) if best else 3


def _consensus(h: np.ndarray, rows: np.ndarray, best: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """``best`` and those of ``h`` (k, 3, 3) that are better, each after how many points it takes to within the reach of their images; ``KEPT`` at most.

    No more points are within reach than are in x alone, so only where those are enough
    y is looked at.
    """
    n, given = len(rows) // 3, h
    h = np.ascontiguousarray(np.moveaxis(h, 0, 2).reshape(9, -1), np.float32)
    # the two sides of the reach in x, which is a little widened against rounding
    strip = np.concatenate([rows[:n] - np.float32(1.01) * rows[2 * n :], rows[:n] + np.float32(1.01) * rows[2 * n :]])[:, [0, 1, 2, 6, 7, 8]]
    of_strip, step = h[[0, 1, 2, 6, 7, 8]], max(1, ONE_THREAD // strip.size)
    room, at_once = np.empty(2 * n * step, np.float32), max(1, ONE_THREAD // rows.size)
    for lo in range(0, h.shape[1], step):
        part, most = of_strip[:, lo : lo + step], _sought(best)
        sides = np.matmul(strip, part, out=room[: 2 * n * part.shape[1]].reshape(2 * n, -1))
        sides[:n] *= sides[n:]
        left = lo + np.flatnonzero(_hits(sides[:n] <= 0) > most)
        for some in np.split(left, range(at_once, len(left), at_once)) if len(left) else ():
            far = rows @ h[:, some]
            far *= far
            far[:n] += far[n : 2 * n]
            near = _hits(far[:n] <= far[2 * n :]).astype(np.int64)
            top = [k for k in np.argsort(-near, kind="stable")[:KEPT] if near[k] > most]
            best = sorted([*best, *((int(near[k]), given[some[k]]) for k in top)], key=lambda x: -x[0])[:KEPT]
    return best


#: Multiplications of a matrix product: OpenBLAS starts threads above 2**18 where it may, which tasks on all cores wait for.
ONE_THREAD = 1 << (20 if os.environ.get("OPENBLAS_NUM_THREADS", os.environ.get("OMP_NUM_THREADS")) == "1" else 18)
#: Samples drawn at first, and at a time when they don't suffice.
FIRST_DRAWS, DRAWS = 1 << 9, 7 << 10
#: Sound samples that are gathered before they are compared with all points, and some more.
MOST_SOUND = 1 << 11
#: Sequences of samples of a seed, of which a pair's key takes one.
SEQUENCES = 4


def _may_be_sound(points: np.ndarray, slack: float) -> np.ndarray:
    """Places of the samples (x, y, u, v of four points each, in single precision) that turn all triangles around or none, and of those within rounding of it."""
    d = points[:, 1:] - points[:, :1]
    x, y = d[::2], d[1::2]
    s = np.empty((2, 4, d.shape[2]), np.float32)
    np.multiply(x[:, :2], y[:, 1:], out=s[:, :2])
    s[:, :2] -= y[:, :2] * x[:, 1:]
    np.multiply(x[:, 0], y[:, 2], out=s[:, 2])
    s[:, 2] -= y[:, 0] * x[:, 2]
    np.add(s[:, 0], s[:, 1], out=s[:, 3])
    s[:, 3] -= s[:, 2]
    turned = s[0] * s[1]
    return np.flatnonzero((turned.min(axis=0) > -slack) | (turned.max(axis=0) < slack))


def _refined(samples: list[np.ndarray], p: np.ndarray, q: np.ndarray, config: Ransac, wider: tuple[int, ...]) -> np.ndarray:
    """The refit of the least sum of squared errors, each up to the threshold, among those on the inliers of the one before.

    A sample's few points may draw the refits to some of the inliers only, so they begin
    with each sample, and with the points within ``wider`` thresholds of the best refit.
    """
    soft = config.method != "RANSAC"
    cost = lambda e: (np.minimum(e, config.threshold) ** 2).sum()
    best, nearest, least = samples[0], errors(samples[0], p, q), np.inf
    for start in (*samples, *wider):
        e, far = (nearest, start * config.threshold) if isinstance(start, int) else (errors(start, p, q), config.threshold * (2 if soft else 1))
        last = np.inf
        for _ in range(MOST_REFITS):
            mask = e <= far
            if mask.sum() < 4:
                break
            better = fit(p[mask], q[mask], np.exp(-0.5 * (e[mask] / config.threshold) ** 2) if soft else None)
            if better is None:
                break
            e, far = errors(better, p, q), config.threshold * (2 if soft else 1)
            now = cost(e)
            if now < least:
                best, nearest, least = better, e, now
            if now >= last:
                break
            last = now
    return samples[0] if cost(errors(samples[0], p, q)) < least else best


#: Refits from one start, and the thresholds' multiples that start again.
MOST_REFITS, WIDER = 10, (2, 3)
#: Samples that refits begin with; the best alone while fewer points agree, which chance brings about.
KEPT, BY_CHANCE = 4, 12


def estimate(p: np.ndarray, q: np.ndarray, config: Ransac = Ransac(), key: str = "") -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """Homography, inlier mask and errors of all points; no homography below four points or without consensus.

    Sound samples of four, drawn alike for any number of points, until the confidence or
    the most iterations are reached, then refits on the inliers; the mask is that of the
    final homography. The samples depend on the seed, ``key`` and the number of points
    alone; draws that aren't sound are no iterations, but ten times as many draws are the
    end. Consensus is counted in single precision about the points' middle, all else in
    double. USAC_MAGSAC weighs the refits' points by their errors, softly, which
    approximates it.
    """
    n = len(p)
    nothing = None, np.zeros(n, bool), np.full(n, np.nan)
    if n < 4:
        return nothing
    if config.seed is None:
        rng = np.random.default_rng()
        blocks = (_four_of(rng, n, DRAWS if k else FIRST_DRAWS) for k in itertools.count())
    else:
        sequence = zlib.crc32(key.encode()) % SEQUENCES
        blocks = (_samples(config.seed, sequence, n, k) for k in itertools.count())
    one = np.ones(n)
    tp, tq = _normaliser(p, one), _normaliser(q, one)
    a, b = _move(tp, p), _move(tq, q)
    flat = FLAT * tp[0, 0] ** 2, FLAT * tq[0, 0] ** 2
    rows = _point_rows(a, b, config.threshold * tq[0, 0])
    coords = np.concatenate([a.T, b.T])
    single = coords.astype(np.float32)
    # products of areas are off by less, after some roundings of at most the sides' squares
    slack = 64 * np.finfo(np.float32).eps * float(np.prod(np.ptp(coords, axis=1).reshape(2, 2).max(axis=1) ** 2))
    best, need, tried, drawn = [], config.max_iters, 0, 0
    while tried < need and drawn < 10 * config.max_iters:
        want, found = min(need - tried, MOST_SOUND) if drawn else 1, []
        while want > 0 and drawn < 10 * config.max_iters:
            sample = next(blocks)
            drawn += sample.shape[1]
            found.append(sample.take(_may_be_sound(single.take(sample, axis=1, mode="clip"), slack), axis=1))
            want -= found[-1].shape[1]
        x, y, u, v = coords.take(np.concatenate(found, axis=1), axis=1, mode="clip")
        s, t = _areas(x, y), _areas(u, v)
        sound = np.flatnonzero(_sound(s, t, flat))[: need - tried]
        if not len(sound):
            continue
        tried += len(sound)
        h = _from_four(*(c.take(sound, axis=1) for c in (x, y, u, v, s, t)))
        best = _consensus(h, rows, best)
        if best:
            miss = 1 - (best[0][0] / n) ** 4
            need = 0 if miss <= 0 else min(config.max_iters, math.ceil(math.log(1 - config.confidence) / math.log(miss)))
    many = bool(best) and best[0][0] >= BY_CHANCE
    samples = [_scaled(_back(tq) @ h @ tp) for _, h in best[: KEPT if many else 1]]
    samples = [h for h in samples if h is not None]
    if not samples:
        return nothing
    best = _refined(samples, p, q, config, WIDER if many and config.method == "RANSAC" else ())
    e = errors(best, p, q)
    return best, e <= config.threshold, e


POINTS = ["x0", "y0", "x1", "y1"]
FOUND = "h array<double>, matches long, inliers long, reproj_mean double, reproj_median double, reproj_rmse double, reproj_max double, inlier_mask array<boolean>, time_ransac double"


def solve(pairs: DataFrame, by: list[str], config: Ransac = Ransac(), with_mask: bool = False) -> DataFrame:
    """Each row's columns but its points (arrays ``x0 y0 x1 y1``), and ``FOUND`` (the mask if wanted).

    A row is the matches of two images, some thousands at most; ``by`` names what it is
    known by, which seeds its samples. Many rows are solved in an Arrow batch, where they
    are: nothing is shuffled. Errors are those of the inliers; nulls where nothing was
    found, null points are none, and an empty table gives no rows.
    """
    kept = [c for c in pairs.columns if c not in POINTS]
    found = pa.schema([
        ("h", pa.list_(pa.float64())), ("matches", pa.int64()), ("inliers", pa.int64()), *[(f"reproj_{x}", pa.float64()) for x in ("mean", "median", "rmse", "max")],
        ("inlier_mask", pa.list_(pa.bool_())), ("time_ransac", pa.float64()),
    ])

    def arrays(column: pa.ListArray) -> list[np.ndarray]:
        ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        return np.split(column.flatten().to_numpy(zero_copy_only=False).astype(float), ends[:-1])

    def solved(key: str, points: list[np.ndarray]) -> dict:
        p0, p1, q0, q1 = points
        began = time.perf_counter()
        h, mask, e = estimate(np.column_stack([p0, p1]), np.column_stack([q0, q1]), config, key)
        took, own = time.perf_counter() - began, e[mask]
        stats = [float(x) for x in (own.mean(), np.median(own), np.sqrt((own**2).mean()), own.max())] if len(own) else [None] * 4
        row = [None if h is None else h.ravel().tolist(), len(p0), int(mask.sum()), *stats, mask.tolist() if with_mask else None, took]
        return dict(zip(found.names, row, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
            points = zip(*(arrays(batch.column(c)) for c in POINTS), strict=True)
            rows = [solved(repr(tuple(map(str, k))), x) for k, x in zip(keys, points, strict=True)]
            out = pa.RecordBatch.from_pylist(rows, schema=found)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *out.columns], [*kept, *found.names])

    schema = ", ".join([*(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in kept), FOUND])
    out = pairs.select(*[f"`{c}`" for c in kept], *POINTS).mapInArrow(run, schema)
    return out if with_mask else out.drop("inlier_mask")


def homographies(points: DataFrame, by: list[str], config: Ransac = Ransac()) -> DataFrame:
    """``solve`` for a table of single correspondences (``by``, ``idx``, ``x0 y0 x1 y1``): a group is the matches of two images."""
    struct = F.struct(F.col("idx"), *POINTS)
    rows = points.groupBy(*by).agg(F.sort_array(F.collect_list(struct)).alias("points"))
    rows = rows.select(*by, *[F.col(f"points.{c}").alias(c) for c in POINTS])
    return solve(rows, by, config)
