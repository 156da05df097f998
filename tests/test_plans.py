import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylocus import cli
from skylocus.operators import imaging, matching, scoring, tiling
from skylocus.plans import experiment, figures, localize, report
from skylocus.sources import storage, tables

MAP_W, MAP_H, SIZE, SCALE = 640, 512, 256, 0.27
FRAME_W, FRAME_H = 960, 540
#: Where the frame's first pixel lies on the map.
OX, OY = 210, 170


def ground():
    """A map of patches of many sizes, so that there are corners everywhere."""
    r = np.random.default_rng(0)
    picture = np.full((MAP_H, MAP_W, 3), 120.0)
    for _ in range(2500):
        x, y, w, h = r.integers(0, MAP_W), r.integers(0, MAP_H), r.integers(4, 30), r.integers(4, 30)
        picture[y : y + h, x : x + w] = r.integers(0, 256, 3)
    return picture.astype(np.uint8)


def seen(picture, ox=OX, oy=OY):
    """What a camera above sees: every pixel looked up on the map, between its pixels."""
    y, x = np.mgrid[0:FRAME_H, 0:FRAME_W]
    u, v = (x + 0.5) * SCALE - 0.5 + ox, (y + 0.5) * SCALE - 0.5 + oy
    i, j = np.clip(u.astype(int), 0, MAP_W - 2), np.clip(v.astype(int), 0, MAP_H - 2)
    a, b = np.clip(u - i, 0, 1)[..., None], np.clip(v - j, 0, 1)[..., None]
    p = picture.astype(float)
    out = (1 - b) * ((1 - a) * p[j, i] + a * p[j, i + 1]) + b * ((1 - a) * p[j + 1, i] + a * p[j + 1, i + 1])
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """A map cut into tiles, and two frames of it, one of another place."""
    folder = str(tmp_path_factory.mktemp("place"))
    picture = ground()
    storage.write(f"{folder}/map.png", imaging.png(picture))
    storage.write(f"{folder}/frames/frame_0001.png", imaging.png(seen(picture)))
    noise = np.random.default_rng(1).integers(0, 256, (FRAME_H, FRAME_W, 3)).astype(np.uint8)
    storage.write(f"{folder}/frames/frame_0002.png", imaging.png(noise))
    cli.run(spark, cli.parser().parse_args(["prepare-map", "--map", f"{folder}/map.png", "--output", f"{folder}/tiles", "--metadata", f"{folder}/tiles.csv", "--run-info", f"{folder}/tiles.json", "--tile-size", str(SIZE)]))
    return folder


def command(spark, *words):
    return cli.run(spark, cli.parser().parse_args([str(w) for w in words]))


def centre():
    return [(FRAME_W / 2) * SCALE - 0.5 + OX, (FRAME_H / 2) * SCALE - 0.5 + OY]


def test_check_command(spark, place, capsys):
    words = ["check", "--map", f"{place}/map.png", "--tiles-dir", f"{place}/tiles", "--tiles-csv", f"{place}/tiles.csv", "--tiles-info", f"{place}/tiles.json", "--skip-frames"]
    assert command(spark, *words) == 0 and "[TILES] OK" in capsys.readouterr().out
    storage.write(f"{place}/tiles/tile_0999.png", storage.read(f"{place}/tiles/tile_0001.png"))
    assert command(spark, *words) == 1 and "stale: tile_0999.png" in capsys.readouterr().out
    storage.clean(f"{place}/tiles", "tile_0999.png")


def localized(spark, place, name, *more):
    words = ["localize", "--frame", name, "--frames-dir", f"{place}/frames", "--tiles-csv", f"{place}/tiles.csv", "--tiles-dir", f"{place}/tiles", "--tiles-info", f"{place}/tiles.json",
             "--output", f"{place}/out.json", "--rankings-dir", f"{place}/rankings", *more]
    assert command(spark, *words) == 0
    return json.loads(storage.read(f"{place}/out.json"))


def test_frame_is_located_from_its_pixels(spark, place):
    found = localized(spark, place, "frame_0001.png", "--map", f"{place}/map.png", "--figures-dir", f"{place}/figures")
    winner = found["winner"]
    assert found["success"] and np.abs(np.array(winner["center_map"]) - centre()).max() < 2 and abs(winner["h_scale"] - SCALE) < 0.01
    assert winner["gate_reasons"] == [] and winner["success_stage2"] and winner["inliers"] >= 15
    corners = [[(x + 0.5) * SCALE - 0.5 + OX, (y + 0.5) * SCALE - 0.5 + OY] for x, y in ((0, 0), (FRAME_W - 1, 0), (FRAME_W - 1, FRAME_H - 1), (0, FRAME_H - 1))]
    assert np.abs(np.array(winner["footprint_map"]) - corners).max() < 4
    space = found["search_space"]
    assert (space["tiles_checked"], space["tiles_total"]) == (12, 12) and 1 <= space["tiles_passed"] <= 12 and len(found["top_k"]) == 5
    assert found["top_k"][0]["tile_id"] == winner["tile_id"] and found["frame_size"] == [FRAME_W, FRAME_H] and found["map_size"] == [MAP_W, MAP_H]
    times = found["timings_sec"]
    assert times["per_tile_mean"] == pytest.approx((times["tile_extract_sum"] + times["match_sum"] + times["ransac_sum"]) / 12)
    # the ranking as written: the gate's columns, then the 27 of a pair
    rows = spark.read.option("header", True).csv(found["candidates_csv"])
    assert rows.columns == ["rank", "tile_id", "x_origin", "y_origin", "passed", "score", "gate_reasons", "center_x_local", "center_y_local", *scoring.PAIR_ROW][1:]
    listed = [r.tile_id for r in rows.collect()]
    assert len(listed) == 12 and listed[:5] == [c["tile_id"] for c in found["top_k"]]
    picture = storage.read(f"{place}/figures/frame_0001_global_loc.svg").decode()
    assert picture.startswith("<svg") and picture.count("<rect") >= 13 and "<polygon" in picture
    assert storage.names(f"{place}/figures") == ["frame_0001_global_loc.svg", "frame_0001_global_loc_zoom.svg"]


def test_noise_is_not_located(spark, place):
    found = localized(spark, place, f"{place}/frames/frame_0002.png", "--roi", "0", "0", "300", "300", "--top-k", "2")
    assert not found["success"] and found["winner"] is None and len(found["top_k"]) == 2 and found["search_space"]["tiles_checked"] < 12
    with pytest.raises(ValueError):
        localized(spark, place, "frame_0002.png", "--roi", "10000", "0", "10001", "1")
    with pytest.raises(FileNotFoundError):
        localized(spark, place, "frame_0009.png")


def test_cached_features_find_the_same(spark, place):
    plain = localized(spark, place, "frame_0001.png")
    command(spark, "build-cache", "--tiles-csv", f"{place}/tiles.csv", "--tiles-dir", f"{place}/tiles", "--tiles-info", f"{place}/tiles.json", "--cache-dir", f"{place}/cache")
    manifest = json.loads(storage.read(f"{place}/cache/manifest.json"))
    assert manifest["tiles"] == 12 and 0 < manifest["keypoints"]["min"] <= manifest["keypoints"]["mean"] <= manifest["keypoints"]["max"] <= 1024
    cached = localized(spark, place, "frame_0001.png", "--cache-dir", f"{place}/cache")
    assert cached["feature_cache"]["used"] and cached["timings_sec"]["tile_extract_sum"] == 0
    assert cached["winner"]["tile_id"] == plain["winner"]["tile_id"] and cached["winner"]["homography"] == pytest.approx(plain["winner"]["homography"])
    with pytest.raises(RuntimeError):
        localized(spark, place, "frame_0001.png", "--cache-dir", f"{place}/cache", "--work-scale", "0.5")

    class NoCache(matching.Corners):
        name, supports_feature_cache = "nocache", False

    with pytest.raises(ValueError):
        report.build_cache(spark, f"{place}/tiles.csv", f"{place}/tiles", f"{place}/c2", NoCache())


def test_experiment(spark, place):
    true = next(t for t in tiling.grid(spark, MAP_W, MAP_H, SIZE).collect() if t.x_origin <= centre()[0] < t.x_origin + SIZE and t.y_origin <= centre()[1] < t.y_origin + SIZE)
    pairs = [(1, "frame_0001.png", true.tile_id, "town"), (2, "frame_0002.png", true.tile_id, None), (3, "frame_0001.png", "tile_0012.png", "town")]
    tables.write_registry(spark.createDataFrame(pairs, tables.EVAL_PAIRS), f"{place}/pairs.csv")

    class Failing(matching.Corners):
        name = "failing"

        def _match(self, first, second):
            raise ArithmeticError("no luck")

    matching.register(Failing)
    rows = experiment.evaluate(spark, f"{place}/pairs.csv", f"{place}/tiles.csv", f"{place}/frames", f"{place}/tiles", f"{place}/raw/results.csv", ["corners", "failing"], repeats=3, figures_dir=f"{place}/pairs")
    assert storage.names(f"{place}/pairs/pair_001") == [f"corners_{x}.svg" for x in ("footprint", "inliers", "matches")]
    assert "fail: " in storage.read(f"{place}/pairs/pair_002/corners_matches.svg").decode()
    assert rows.columns == [*experiment.KEYS, *scoring.PAIR_ROW]
    got = {(r.method, r.pair_id): r for r in rows.collect()}
    assert len(got) == 6 and got["corners", 1].success and not got["corners", 2].success and got["corners", 1].repeats == 3
    assert got["corners", 2].failure_reason in ("no homography", "fewer than 4 matches") or got["corners", 2].failure_reason.startswith("inliers")
    good, bad = got["corners", 1], got["failing", 1]
    assert good.inlier_ratio == pytest.approx(good.inliers / good.matches) and good.time_matcher_total > 0 and good.reproj_mean <= good.reproj_rmse <= good.reproj_max <= 3
    assert abs(good.center_x_map - centre()[0]) < 2 and 0.7 <= good.mean_confidence <= 1 and (good.frame_work_w, good.frame_work_h) == (259, 146)
    assert not bad.success and bad.failure_reason == "error: no luck" and bad.scene_type is None and bad.matches is None and bad.time_match is None
    info = json.loads(storage.read(f"{place}/raw/results_info.json"))
    assert info["methods"] == ["corners", "failing"] and info["matchers"]["corners"]["max_keypoints"] == 1024 and info["pipeline"]["ransac"]["max_iters"] == 5000
    made = experiment.summarize(spark, f"{place}/raw/results.csv", f"{place}/summary")
    assert [m.rpartition("/")[2] for m in made] == ["results_summary.csv", "results_by_scene.csv"]
    table = {r.method: r for r in spark.read.option("header", True).option("inferSchema", True).csv(made[0]).collect()}
    assert table["corners"].pairs == 3 and table["corners"].success_rate == pytest.approx(sum(got["corners", k].success for k in (1, 2, 3)) / 3) and table["failing"].success_rate == 0
    assert table["corners"].mean_matches == pytest.approx(sum(got["corners", k].matches for k in (1, 2, 3)) / 3) and table["failing"].mean_h_scale_success is None
    assert table["corners"].median_inliers == sorted(got["corners", k].inliers for k in (1, 2, 3))[1]
    scenes = [(r.scene_type, r.method, r.pairs) for r in spark.read.option("header", True).option("inferSchema", True).csv(made[1]).collect()]
    assert scenes == [("town", "corners", 2)]
    # no scene, no second file
    tables.write_registry(rows.withColumn("scene_type", F.lit(None).cast("string")), f"{place}/raw/bare.csv")
    assert len(experiment.summarize(spark, f"{place}/raw/bare.csv", f"{place}/summary")) == 1
    with pytest.raises(FileNotFoundError):
        experiment.images(spark, f"{place}/frames", spark.createDataFrame([("none.png",)], "frame string"), "frame")


def test_figures_of_a_pair(spark, place):
    picture = ground()
    frame = seen(picture)
    m = matching.Corners()
    tile = picture[128:384, 192:448]
    work, scales = imaging.resize_by_scale(frame, SCALE)
    p, q, conf, _ = m.match(work, tile)
    points = imaging.to_original(p, *scales)
    pairs = spark.createDataFrame([("f", "t", points[:, 0].tolist(), points[:, 1].tolist(), q[:, 0].tolist(), q[:, 1].tolist(), FRAME_W, FRAME_H)],
                                  "frame_id string, tile_id string, x0 array<double>, y0 array<double>, x1 array<double>, y1 array<double>, frame_w int, frame_h int")
    registry = spark.createDataFrame([("t", 192, 128, 256, 256)], tables.TILES)
    row = localize.verify(pairs, registry, (F.col("frame_w"), F.col("frame_h")), with_mask=True).first().asDict()
    assert row["success"], row["failure_reason"]
    row |= dict(zip(("x0", "y0", "x1", "y1"), (points[:, 0], points[:, 1], q[:, 0], q[:, 1]), strict=True)) | {"pair_id": 7}
    made = figures.of_pair(row, (MAP_W, MAP_H), "Corners")
    assert sorted(made) == ["corners_footprint.svg", "corners_inliers.svg", "corners_matches.svg"]
    n_in, n = sum(row["inlier_mask"]), len(points)
    assert made["corners_inliers.svg"].count("<line") == min(200, n_in) and made["corners_matches.svg"].count("<line") == min(200, n_in) + min(200, n - n_in)
    assert "pair 7 | Corners" in made["corners_matches.svg"] and "<polygon" in made["corners_footprint.svg"]
    lost = figures.of_pair(row | {"h": None, "success": False, "failure_reason": "a < b"}, (MAP_W, MAP_H), "Corners")
    assert sorted(lost) == ["corners_inliers.svg", "corners_matches.svg"] and "fail: a &lt; b" in lost["corners_matches.svg"]
    shown = figures.matches([(0, 0, 1, 1)] * 500, [True] * 500, (10, 10), (10, 10), frame=np.zeros((10, 10, 3), np.uint8))
    assert shown.count("<line") == 200 and "data:image/png;base64," in shown
    assert figures.some(list(range(500)), 200, 3) == figures.some(list(range(500)), 200, 3)


def test_small_commands(spark, place, capsys):
    command(spark, "region", 10, 20, 30, 41, "--scale", "0.5")
    assert capsys.readouterr().out.split() == ["20", "40", "60", "82"]
    command(spark, "audit", "--map", f"{place}/map.png")
    assert "640" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["prepare-frames", "--output", "o", "--metadata", "m", "--fps", "1", "--every-n", "2"])
    assert tables.git_commit("/") is None and tables.now().endswith("+00:00")
    assert tables.environment(spark)["spark"] == spark.version
