import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skylocus import catalog
from skylocus.functions import geometry as G
from skylocus.operators import homography, integrity, matching, scoring, tiling


def similarity(s, deg, tx, ty):
    a = math.radians(deg)
    return np.array([[s * math.cos(a), -s * math.sin(a), tx], [s * math.sin(a), s * math.cos(a), ty], [0, 0, 1.0]])


def image(h, p):
    m = p @ h[:, :2].T + h[:, 2]
    return m[:, :2] / m[:, 2:]


def test_grid(spark):
    tiles = tiling.grid(spark, 6200, 4320).toPandas()
    assert len(tiles) == 384 and tiles.tile_id.iloc[0] == "tile_0001.png"
    assert sorted(set(tiles.x_origin))[-2:] == [5632, 5688] and sorted(set(tiles.y_origin))[-2:] == [3584, 3808]
    roi = tiling.grid(spark, 2000, 2000, 256, 0.5, (912, 1409, 768, 512)).toPandas()
    assert (roi.x_origin.iloc[0], roi.y_origin.iloc[0]) == (912, 1409)
    assert (roi.x_origin + roi.width).max() == 1680 and (roi.y_origin + roi.height).max() == 1921
    assert tiling.grid(spark, 1280, 1024).count() == 12
    with pytest.raises(ValueError):
        tiling.grid(spark, 300, 4000)
    assert tiling.stride(10, 0.9) == 1


def test_steps():
    assert [tiling.step_of(30, 1), tiling.step_of(29.97, 1), tiling.step_of(30, 2), tiling.step_of(30, every_n=7)] == [30, 30, 15, 7]
    assert tiling.step_of(25, 2) == 12  # half to even
    for bad in ({"fps": 30, "target_fps": 60}, {"fps": 0, "target_fps": 1}, {"fps": 30, "every_n": 0}):
        with pytest.raises(ValueError):
            tiling.step_of(**bad)


def test_sampling(spark):
    raw = spark.range(95).select(F.col("id").alias("source_frame_idx"), F.lit(320).alias("width"), F.lit(180).alias("height"))
    rows = tiling.sample_frames(raw, 30.0).orderBy("frame_ord").collect()
    assert [(r.source_frame_idx, r.timestamp_sec) for r in rows] == [(0, 0.0), (30, 1.0), (60, 2.0), (90, 3.0)]
    assert tiling.sample_frames(raw, 30.0, limit=2).count() == 2


def test_pool(spark):
    tiles = tiling.grid(spark, 1280, 1024)
    assert tiling.select_tiles(tiles, (600, 600, 700, 700)).count() == 4
    some = tiling.select_tiles(tiles, None, 2).toPandas()
    assert set(some.x_origin) == {0, 512} and set(some.y_origin) <= {0, 512}
    # touching edges don't meet
    assert tiling.select_tiles(tiles, (1280, 0, 1300, 10)).count() == 0


def test_coverage(spark):
    row = tiling.coverage(tiling.grid(spark, 6200, 4320), 6200, 4320).first()
    assert (row.min_cover, row.max_cover, row.uncovered_px) == (1, 9, 0)
    thin = tiling.select_tiles(tiling.grid(spark, 6200, 4320), None, 2)
    assert tiling.coverage(thin, 6200, 4320).first().uncovered_px == 1618176
    assert tiling.coverage(thin.limit(0), 10, 20).first().uncovered_px == 200


def test_scaled_sides(spark):
    row = spark.range(1).select(
        G.scaled_side(F.lit(1920), F.lit(0.27)).alias("a"), G.scaled_side(F.lit(1080), F.lit(0.27)).alias("b"),
        G.scaled_side(F.lit(1920), F.lit(0.27), 8).alias("c"), G.scaled_side(F.lit(1080), F.lit(0.27), 8).alias("d"),
    ).first()
    assert tuple(row) == (518, 292, 520, 288)


def test_point_at_infinity(spark):
    h = F.array(*[F.lit(v) for v in (1.0, 0, 0, 0, 1.0, 0, 0.01, 0, -1.0)]).cast("array<double>")
    x, y = G.project(h, F.lit(100.0), F.lit(5.0))
    u, v = G.project_or_origin(h, F.lit(100.0), F.lit(5.0))
    assert tuple(spark.range(1).select(x, y, u, v).first()) == (None, None, 0.0, 0.0)


def test_plausibility(spark):
    matrices = {
        "good": similarity(0.27, 5, 20, 110), "mirror": np.diag([-0.27, 0.27, 1]), "flat": np.diag([0.27, 0.1, 1]),
        "small": similarity(0.05, 0, 0, 0), "horizon": np.array([[0.27, 0, 0], [0, 0.27, 0], [-1e-3, 0, 1]]),
    }
    df = spark.createDataFrame([(k, m.ravel().tolist()) for k, m in matrices.items()] + [("none", None)], "name string, h array<double>")
    got = {r.name: r for r in G.diagnose(df, F.col("h"), F.lit(1920), F.lit(1080)).collect()}
    assert [n for n in matrices if got[n].plausible] == ["good"]
    assert got["none"].plausible is None or not got["none"].plausible
    assert abs(got["good"].h_scale - 0.27) < 1e-9 and abs(got["good"].h_rotation_deg - 5) < 1e-9
    assert "reflection" in got["mirror"].reasons and "anisotropy" in got["flat"].reasons and "infinity" in got["horizon"].reasons


CANDIDATE = dict(homography_found=True, plausible=True, matches=200, inliers=80, reproj_mean=1.5, center_x=250.0, center_y=250.0, tile_w=512, tile_h=512, center_in_map=True)


def evaluated(spark, *changes):
    schema = "homography_found boolean, plausible boolean, matches long, inliers long, reproj_mean double, center_x double, center_y double, tile_w int, tile_h int, center_in_map boolean, frame_id string, tile_ord int"
    names = [x.split()[0] for x in schema.split(", ")]
    rows = [{**CANDIDATE, "frame_id": "f", "tile_ord": k, **c} for k, c in enumerate(changes)]
    return scoring.evaluate(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema))


def test_gate(spark):
    rows = evaluated(
        spark, {}, {"homography_found": False}, {"plausible": False}, {"matches": 20, "inliers": 14}, {"inliers": 20}, {"reproj_mean": 3.6},
        {"center_x": -31.0}, {"center_in_map": False}, {"matches": 100, "inliers": 15}, {"reproj_mean": 3.5}, {"center_x": -30.0}, {"center_x": 541.0}, {"center_x": 541.01}, {"reproj_mean": None},
    ).orderBy("tile_ord").collect()
    want = [[], ["no_homography"], ["implausible"], ["few_inliers"], ["low_ratio"], ["high_error"], ["center_off_tile"], ["center_off_map"], [], [], [], [], ["center_off_tile"], ["high_error"]]
    assert [r.gate_reasons for r in rows] == want
    assert abs(rows[0].score - 80 * 0.4 * math.exp(-0.75)) < 1e-9 and all(r.score == 0 for r in rows if r.gate_reasons)


def test_ranks(spark):
    e = evaluated(spark, {"inliers": 40}, {"inliers": 120}, {"inliers": 180, "plausible": False}, {"inliers": 80}, {"inliers": 80})
    assert [r.tile_ord for r in scoring.rank(e, ["frame_id"], ["tile_ord"]).orderBy("rank").collect()] == [1, 3, 4, 0, 2]
    assert [r.tile_ord for r in scoring.winners(e, ["frame_id"], ["tile_ord"]).collect()] == [1]
    assert scoring.margin(e, ["frame_id"], ["tile_ord"]).first().margin == pytest.approx((120 * 0.6) / (80 * 0.4))
    assert scoring.winners(evaluated(spark, {"plausible": False}), ["frame_id"], ["tile_ord"]).count() == 0


def noisy(n, outliers, seed, sigma=0.3):
    r = np.random.default_rng(seed)
    h = similarity(0.27, 5, 20, 110)
    p = r.random((n, 2)) * [1919, 1079]
    q = image(h, p) + r.normal(0, sigma, (n, 2))
    stray = r.random(n) < outliers
    q[stray] = r.random((stray.sum(), 2)) * 511
    return h, p, q, stray


@pytest.mark.parametrize("method", homography.METHODS)
def test_robust_fit(method):
    true, p, q, stray = noisy(400, 0.25, 1)
    h, mask, e = homography.estimate(p, q, homography.Ransac(method))
    corners = np.array([[0, 0], [1919, 0], [1919, 1079], [0, 1079.0]])
    assert (mask & stray).sum() < 5 and mask[~stray].mean() > 0.95 and e[mask].max() <= 3 and np.median(e[mask]) < 1
    assert np.abs(image(h, corners) - image(true, corners)).max() < 1
    again = homography.estimate(p, q, homography.Ransac(method))
    assert (again[1] == mask).all()


def test_no_fit():
    _, p, q, _ = noisy(200, 0.6, 2)
    assert homography.estimate(p, q)[1].sum() > 60
    assert homography.estimate(p[:3], q[:3])[0] is None
    line = np.column_stack([np.arange(50.0), np.arange(50.0)])
    assert homography.estimate(line, line)[0] is None
    r = np.random.default_rng(3)
    assert homography.estimate(r.random((100, 2)) * 1900, r.random((100, 2)) * 511)[1].sum() < 15
    with pytest.raises(ValueError):
        homography.Ransac("LMEDS")


def test_samples_are_four_distinct_points_drawn_alike():
    r = np.random.default_rng(5)
    assert (np.sort(homography._four_of(r, 4, 500), axis=0) == np.arange(4)[:, None]).all()
    drawn = homography._four_of(r, 600, 60_000)
    assert drawn.shape == (4, 60_000) and (np.diff(np.sort(drawn, axis=0), axis=0) > 0).all()
    counts = np.bincount(drawn.ravel(), minlength=600)
    assert abs(counts.mean() - 400) < 1e-9 and counts.std() < 30
    for place in homography._four_of(r, 6, 60_000):
        assert abs(np.bincount(place, minlength=6) - 10_000).max() < 500


def test_homography_of_four_points():
    r = np.random.default_rng(6)
    h = np.array([[0.3, -0.02, 20], [0.05, 0.25, 100], [1e-5, -2e-5, 1]])
    p = r.random((4, 50, 2)) * [1919, 1079]
    (x, y), (u, v) = (np.moveaxis(z, 2, 0) for z in (p, image(h, p.reshape(-1, 2)).reshape(p.shape)))
    sound = homography._sound(homography._areas(x, y), homography._areas(u, v))
    assert sound.sum() > 45
    for m in homography._from_four(*(c[:, sound] for c in (x, y, u, v))):
        assert np.allclose(m / m[2, 2], h, rtol=1e-6)
    # all triangles turn around in a mirror, and some but not all in a twist
    assert homography._sound(homography._areas(x, y), homography._areas(-u, v))[sound].all()
    twist = [1, 0, 2, 3]
    assert not homography._sound(homography._areas(x, y), homography._areas(u[twist], v[twist]))[sound].all()


@pytest.mark.parametrize("n", [100, 511, 512, 2000])
def test_consensus_is_that_of_all_samples(n):
    """The homography found has as many inliers as the best of plain samples, one after the other."""
    _, p, q, _ = noisy(n, 0.5, n)
    _, mask, _ = homography.estimate(p, q)
    r, best = np.random.default_rng(9), 0
    for _ in range(200):
        four = r.choice(n, 4, replace=False)
        h = homography.fit(p[four], q[four])
        if h is not None:
            best = max(best, int((homography.errors(h, p, q) <= 3).sum()))
    assert mask.sum() >= 0.99 * best


def test_pairs_share_their_samples(monkeypatch):
    """Noise takes all iterations; drawing for them is done once for many pairs of as many points."""
    r = np.random.default_rng(8)
    pairs = [(r.random((90, 2)) * [1919, 1079], r.random((90, 2)) * 511) for _ in range(3)]
    found = [homography.estimate(p, q)[1].sum() for p, q in pairs]
    drawn, draw = [], homography._four_of
    monkeypatch.setattr(homography, "_four_of", lambda *a: drawn.append(a) or draw(*a))
    assert [homography.estimate(p, q)[1].sum() for p, q in pairs] == found
    assert not drawn
    homography.estimate(*pairs[0], homography.Ransac(seed=None))
    assert drawn


@pytest.mark.parametrize("n", [40, 300])
def test_consensus_counts_points_within_reach(n):
    """Looking at strips first leaves out none of the best."""
    _, p, q, _ = noisy(n, 0.5, n)
    r = np.random.default_rng(n)
    h = []
    while len(h) < 700:
        four = r.choice(n, 4, replace=False)
        m = homography.fit(p[four], q[four])
        h += [m] if m is not None else []
    a, b = p / 1000, q / 1000
    scaled = np.array([np.diag([1e-3, 1e-3, 1]) @ m @ np.diag([1e3, 1e3, 1]) for m in h])
    got = homography._consensus(scaled / np.abs(scaled).max(axis=(1, 2), keepdims=True), homography._point_rows(a, b, 0.003), [])
    want = sorted((int((homography.errors(m, p, q) <= 3).sum()) for m in h), reverse=True)
    assert [count for count, _ in got] == [w for w in want[: homography.KEPT] if w >= homography.BY_CHANCE or w == want[0]]


@pytest.mark.parametrize("seed", [5830, 4987])
def test_refits_reach_all_true_points(seed):
    """The best sample's inliers are some of the true points only, and refits on those alone stay there."""
    true, p, q, _ = noisy(60, 0.4, seed, 1.0)
    h, _, _ = homography.estimate(p, q)
    corners = np.array([[480, 270], [1440, 270], [1440, 810], [480, 810.0]])
    assert np.abs(image(h, corners) - image(true, corners)).max() < 2


def test_refit_may_lose_a_stray():
    """A sample that a stray agrees with by chance isn't kept for that."""
    true, p, q, _ = noisy(100, 0.25, 4882)
    h, _, _ = homography.estimate(p, q)
    centre = np.array([[959.5, 539.5]])
    assert np.abs(image(h, centre) - image(true, centre)).max() < 0.5


def test_groups_and_rows_agree(spark):
    _, p, q, _ = noisy(60, 0.3, 4)
    rows = [("f", f"t{t}", k, *p[k].tolist(), *q[k].tolist()) for t in range(3) for k in range(60 if t < 2 else 3)]
    names = ["frame_id", "tile_id", "idx", "x0", "y0", "x1", "y1"]
    points = spark.createDataFrame(rows, names)
    by = ["frame_id", "tile_id"]
    got = {r.tile_id: r for r in homography.homographies(points.repartition(5), by).collect()}
    assert got["t0"].matches == 60 and got["t2"].h is None and got["t2"].matches == 3
    arrays = points.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("idx", "x0", "y0", "x1", "y1"))).alias("z")).select(*by, *[F.col(f"z.{c}").alias(c) for c in homography.POINTS])
    again = {r.tile_id: r for r in homography.solve(arrays, by, with_mask=True).collect()}
    assert again["t1"].h == got["t1"].h and sum(again["t1"].inlier_mask) == got["t1"].inliers
    assert homography.solve(arrays.limit(0), by).collect() == []
    nothing = homography.solve(arrays.limit(1).withColumn("x0", F.lit(None).cast("array<double>")).withColumn("y0", F.col("x0")).withColumn("x1", F.col("x0")).withColumn("y1", F.col("x0")), by).first()
    assert nothing.h is None and nothing.matches == 0


def test_made_matches_have_the_share_of_strays(spark):
    true = np.array([[0.27, -0.02, 20], [0.02, 0.27, 110], [0, 0, 1.0]])
    pairs = spark.range(40).select(F.concat(F.lit("f"), "id").alias("frame_id"), F.lit("t").alias("tile_id"), F.col("id").alias("noise"), F.array(*[F.lit(x) for x in true.ravel().tolist()]).alias("h"))
    for r in matching.oracle(pairs, n_points=100, outliers=0.25).collect():
        off = np.abs(image(true, np.column_stack([r.x0, r.y0])) - np.column_stack([r.x1, r.y1])).max(axis=1)
        assert (off < 1e-9).sum() == 75


def test_mutual_nn(spark):
    r = np.random.default_rng(4)
    a, b = r.normal(size=(40, 8)), r.normal(size=(50, 8))
    df = lambda m: spark.createDataFrame([(0, k, v.tolist()) for k, v in enumerate(m)], "label int, id long, descriptor array<double>")
    got = {(x.id0, x.id1) for x in matching.mutual_nearest(df(a), df(b), ["label"]).collect()}
    s = a @ b.T
    assert got == {(i, j) for i in range(40) for j in range(50) if s[i].argmax() == j and s[:, j].argmax() == i}
    assert matching.mutual_nearest(df(a).limit(0), df(b), ["label"]).count() == 0


def test_mutual_ties_and_near_ties(monkeypatch):
    a = np.array([[1.0, 0], [1.0, 0], [0, 1 + 1e-6]])
    b = np.array([[1.0, 0], [0, 1.0], [0, 1 + 1e-7]])
    for block in (1 << 22, 1):
        monkeypatch.setattr(matching, "BLOCK", block)
        i, j, _ = matching.mutual(a, b)
        assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (2, 2)]


class Counting(matching.ImageMatcher):
    """Finds nothing but counts; a frame of one colour is an error."""

    name = "counting"
    size_multiple = 8

    def _extract(self, image):
        return {"points": np.zeros((0, 2)), "scores": np.zeros(0), "descriptors": np.zeros((0, 4))}

    def _match(self, first, second):
        return np.zeros((0, 2)), np.zeros((0, 2)), np.zeros(0)


def test_matcher_protocol():
    matching.register(Counting)
    m = matching.create("COUNTING")
    assert m.config() == {"name": "counting", "device": "cpu", "size_multiple": 8}
    with pytest.raises(ValueError):
        m.extract(np.zeros((10, 16, 3), np.uint8))
    with pytest.raises(ValueError):
        m.extract(np.zeros((16, 16), np.uint8))
    with pytest.raises(ValueError):
        m.extract(np.zeros((16, 16, 3)))
    p, q, conf, took = m.match(np.zeros((16, 16, 3), np.uint8), np.zeros((8, 8, 3), np.uint8))
    assert p.shape == q.shape == (0, 2) and conf.dtype == np.float32 and took >= 0
    m.warmup((16, 8), (8, 8), 1)
    with pytest.raises(ValueError):
        matching.create("nothing")
    assert matching.create("Corners", max_keypoints=5).config()["max_keypoints"] == 5


@pytest.mark.parametrize(("k", "multiple"), [(1, 1), (1.5, 1), (1, 8), (0.75, 8)])
def test_matches_are_in_original_pixels(spark, k, multiple):
    """Whatever the working scale and the sides' multiples, a known homography comes back at the corners."""
    from skylocus.operators import imaging

    true, size = similarity(0.27, 5, 20, 110), (1920, 1080)
    r = np.random.default_rng(7)
    p = r.random((300, 2)) * [1919, 1079]
    q = image(true, p)
    q[:90] = r.random((90, 2)) * 511
    (fw, fh), (tw, th) = imaging.scaled_size(*size, 0.27 * k, multiple), imaging.scaled_size(512, 512, k, multiple)

    class Oracle(matching.ImageMatcher):
        name = "oracle"

        def _extract(self, image):
            raise AssertionError

        def _match(self, first, second):
            to_work = lambda x, sx, sy: (x + 0.5) * [sx, sy] - 0.5
            return to_work(p, fw / 1920, fh / 1080), to_work(q, tw / 512, th / 512), np.ones(300)

    features = lambda i, w, h, ow, oh: spark.createDataFrame([(i, [0.0], [0.0], [1.0], [1.0], 1, w, h, ow, oh, 0.5)], matching.FEATURES)
    pairs = spark.createDataFrame([("f", "t", 9)], "frame_id string, tile_id string, extra int")
    out = matching.match(pairs, features("f", fw, fh, *size), features("t", tw, th, 512, 512), Oracle(), cached=True)
    row = homography.solve(out, ["frame_id", "tile_id"]).first()
    corners = np.array([[0, 0], [1919, 0], [1919, 1079], [0, 1079.0]])
    assert np.abs(image(np.array(row.h).reshape(3, 3), corners) - image(true, corners)).max() < 1e-3
    assert (row.extra, row.frame_w, row.time_extract_frame, row.time_extract_tile) == (9, 1920, 0.5, 0.0)
    with pytest.raises(Exception, match="no features"):
        matching.match(pairs.withColumn("tile_id", F.lit("u")), features("f", fw, fh, *size), features("t", tw, th, 512, 512), Oracle()).collect()


def test_outcome(spark):
    rows = [(None, 3, 0, None, []), (None, 4, 0, None, []), ([1.0], 20, 14, True, []), ([1.0], 20, 15, False, ["scale", "anisotropy"]), ([1.0], 20, 15, True, [])]
    df = spark.createDataFrame(rows, "h array<double>, matches long, inliers long, plausible boolean, reasons array<string>")
    cols = [F.col(c) for c in df.columns]
    got = [tuple(r) for r in df.select(*scoring.outcome(*cols)).collect()]
    assert got == [(False, "fewer than 4 matches"), (False, "no homography"), (False, "inliers 14 < 15"), (False, "scale; anisotropy"), (True, "")]
    assert df.select(scoring.outcome(*cols, check_plausibility=False)[0]).collect()[3][0]


def test_unknown_tile_raises(spark):
    from skylocus.plans import localize

    tiles = tiling.grid(spark, 1280, 1024)
    pairs = spark.createDataFrame([("tile_0001.png",), ("tile_9999.png",)], "tile_id string")
    assert localize.with_tiles(pairs.limit(1), tiles).first().x_origin == 0
    with pytest.raises(Exception, match="unknown tile tile_9999.png"):
        localize.with_tiles(pairs, tiles).select("tile_id").collect()


def test_reason_codes(spark):
    names = ["a", "b", "c"]
    df = spark.range(9).select(G.reason_codes(F.col("id").cast("int"), names, "alone").alias("r"))
    assert [r.r for r in df.collect()] == [[n for k, n in enumerate(names) if m >> k & 1] for m in range(8)] + [["alone"]]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 30_001])
def test_medians_are_exact(spark, n):
    from skylocus.operators import quantiles

    r = np.random.default_rng(n)
    values = {"x": np.round(r.normal(size=n), 2), "y": r.normal(size=n), "z": np.where(np.arange(n) % 3 == 0, 7.0, r.normal(size=n))}
    rows = [("g", *(float(values[c][k]) for c in "xyz"), None) for k in range(n)] + [("h", 1.0, 2.0, None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double, w double").repartition(7)
    got = {r.g: r for r in quantiles.medians(df, ["g"], ["x", "y", "z", "w"]).collect()}
    assert [got["g"][f"{c}_median"] for c in "xyz"] == [float(np.median(values[c])) for c in "xyz"]
    assert got["g"].w_median is None and got["h"].y_median == 2.0 and got["h"].z_median is None
    assert quantiles.medians(df.limit(0), ["g"], ["x"]).collect() == []


def test_tile_violations(spark):
    good = tiling.grid(spark, 1280, 1024)
    assert integrity.tiles(good, 1280, 1024).count() == 0
    bad = good.unionByName(good.filter("tile_ord = 1").withColumn("width", F.lit(500)))
    assert sorted(r.check for r in integrity.tiles(bad, 1280, 1024).collect()) == ["duplicate_id", "duplicate_origin", "size"]


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.tile_id == "tile_0007.png" for r in rows)
    h = np.array([[0.2696, -0.0141, -40], [0.0141, 0.2696, 100], [0, 0, 1]])
    x, y = image(h, np.array([[959.5, 539.5]]))[0] + [512, 256]
    assert all(abs(r.x_map - x) < 1 and abs(r.y_map - y) < 1 for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    index = {d[0]: k for k, d in enumerate(want.description)}
    rows = lambda found: sorted((tuple(map(str, r)) for r in found))
    want = rows([tuple(r[index[c]] for c in columns) for r in want.fetchall()])
    got = catalog.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    assert rows(tuple(r[c] for c in columns) for r in got.collect()) == want


def test_flagship_samples_as_often_as_the_default(spark, sf_dir, monkeypatch):
    from skylocus import catalog
    from skylocus.operators import homography

    used = []
    monkeypatch.setattr(catalog.localize, "candidates", lambda points, tiles, frame, size, ransac: used.append(ransac))
    monkeypatch.setattr(catalog.localize, "positions", lambda x: x)
    catalog.flagship(spark, sf_dir)
    assert used == [homography.Ransac()]
