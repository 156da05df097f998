import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylocus.operators import imaging, integrity, tiling
from skylocus.plans import prepare
from skylocus.sources import storage, tables, video


def test_blend():
    row = np.array([[[10, 20, 30, 255], [1, 2, 3, 0], [0, 0, 0, 128]]], np.uint8)
    assert imaging.blend(row).tolist() == [[[10, 20, 30], [255, 255, 255], [127, 127, 127]]]
    with pytest.raises(ValueError):
        imaging.blend(row[..., :3])


def test_resize():
    image = np.random.default_rng(0).integers(0, 256, (40, 60, 3)).astype(np.uint8)
    assert imaging.resize(image, 60, 40) is image
    half = imaging.resize(image, 30, 20)
    want = np.rint(image.reshape(20, 2, 30, 2, 3).mean((1, 3)))
    assert np.abs(half - want).max() <= 1
    assert imaging.resize(np.full((4, 4, 3), 9, np.uint8), 9, 7).tolist() == np.full((7, 9, 3), 9).tolist()


def test_tiles_are_crops(spark, tmp_path):
    pixels = np.random.default_rng(0).integers(0, 256, (90, 130, 3)).astype(np.uint8)
    tiles = tiling.grid(spark, 130, 90, 64)
    for row in imaging.cut_tiles(tiles, pixels.tobytes(), 130, 90).collect():
        (tmp_path / row.tile_id).write_bytes(row.png)
    back = {r.origin.rpartition("/")[2]: r for r in imaging.read_images(spark, str(tmp_path)).collect()}
    rows = tiles.collect()
    assert len(back) == len(rows)
    for t in rows:
        crop = pixels[t.y_origin : t.y_origin + 64, t.x_origin : t.x_origin + 64]
        assert bytes(back[t.tile_id].rgb) == crop.tobytes()


def test_strips_give_the_same_crops(spark, monkeypatch):
    pixels = np.random.default_rng(1).integers(0, 256, (700, 300, 3)).astype(np.uint8)
    tiles = tiling.grid(spark, 300, 700, 128)
    image = spark.createDataFrame([(300, 700, bytearray(pixels.tobytes()))], "width int, height int, rgb binary")
    whole = {r.tile_id: r.rgb for r in imaging.crops(tiles, image).collect()}
    monkeypatch.setattr(imaging, "BROADCAST_MAP", 1)
    assert {r.tile_id: r.rgb for r in imaging.crops(tiles, image).collect()} == whole and len(whole) == tiles.count()
    for changed in (tiles.withColumn("x_origin", F.col("x_origin") + 1), tiles.withColumn("y_origin", F.col("y_origin") - 1)):
        with pytest.raises(RuntimeError):
            imaging.crops(changed, image)


def test_channels(spark, tmp_path):
    r = np.random.default_rng(2)
    rgb, gray = r.integers(0, 256, (5, 7, 3)).astype(np.uint8), r.integers(0, 256, (5, 7)).astype(np.uint8)
    alpha = np.dstack([rgb, np.full((5, 7), 255, np.uint8)])
    clear = alpha.copy()
    clear[0, 0, 3] = 0
    for name, pixels in (("rgb", rgb), ("gray", gray), ("opaque", alpha), ("clear", clear)):
        (tmp_path / f"{name}.png").write_bytes(imaging.png(pixels))
    raw = {x.name: x for x in imaging.read_raw(spark, str(tmp_path)).collect()}
    assert [raw[f"{n}.png"].channels for n in ("rgb", "gray", "opaque", "clear")] == [3, 1, 4, 4]
    assert bytes(raw["rgb.png"].pixels) == rgb[..., ::-1].tobytes() and bytes(raw["gray.png"].pixels) == gray.tobytes()
    read = {x.name: x for x in imaging.read_images(spark, str(tmp_path)).collect()}
    assert [read[f"{n}.png"].alpha_fully_opaque for n in ("rgb", "opaque", "clear")] == [None, True, False]
    assert bytes(read["opaque.png"].rgb) == rgb.tobytes() and bytes(read["gray.png"].rgb) == np.repeat(gray[..., None], 3, 2).tobytes()
    assert bytes(read["clear.png"].rgb)[:3] == b"\xff\xff\xff"
    with pytest.raises(ValueError):
        imaging.to_rgb(np.zeros((2, 2, 5), np.uint8))


def test_files_that_are_no_images_raise(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        imaging.read_images(spark, f"{tmp_path}/none.png").collect()
    (tmp_path / "bad.png").write_bytes(b"not a picture")
    with pytest.raises(Exception, match="can't decode"):
        imaging.read_raw(spark, f"{tmp_path}/bad.png").collect()
    deep = bytearray(imaging.png(np.zeros((2, 2), np.uint8)))
    deep[24] = 16
    (tmp_path / "deep.png").write_bytes(bytes(deep))
    with pytest.raises(ValueError):
        imaging.read_images(spark, f"{tmp_path}/deep.png")


def test_scales_and_tensors():
    assert imaging.scaled_size(1920, 1080, 0.27) == (518, 292) and imaging.scaled_size(1920, 1080, 0.27, 8) == (520, 288) and imaging.scaled_size(512, 512, 1.0) == (512, 512)
    with pytest.raises(ValueError):
        imaging.scaled_size(10, 10, 0)
    image = np.random.default_rng(3).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    small, scales = imaging.resize_by_scale(image, 0.5, 4)
    assert small.shape == (8, 16, 3) and scales == (16 / 30, 8 / 20)
    points = np.array([[0.0, 0.0], [15.0, 7.0]])
    assert np.allclose((imaging.to_original(points, *scales) + 0.5) * scales - 0.5, points)
    tensor = imaging.to_tensor(image)
    assert tensor.shape == (1, 3, 20, 30) and tensor.dtype == np.float32 and tensor.max() <= 1 and np.allclose(tensor[0, 1] * 255, image[..., 1])
    assert imaging.to_tensor(image[..., 0]).shape == (1, 1, 20, 30)
    with pytest.raises(ValueError):
        imaging.to_tensor(image.astype(float))


def test_names():
    assert [storage.stem(n) for n in ("a/tile_0001.png", "x.tar.gz", ".hidden", "plain")] == ["tile_0001", "x.tar", ".hidden", "plain"]
    assert [storage.suffix(n) for n in ("a/tile_0001.PNG", "x.tar.gz", ".hidden", "plain")] == [".PNG", ".gz", "", ""]
    assert storage.portable("/a/b/c.png", "/a") == "b/c.png" and storage.portable("/x/c.png", "/a") == "/x/c.png" and storage.portable("/ab/c", "/a") == "/ab/c"


def test_files(tmp_path):
    storage.write(f"{tmp_path}/d/tile_1.png", b"one")
    storage.write(f"file://{tmp_path}/d/tile_1.png", b"two")
    storage.write(f"{tmp_path}/d/other.txt", b"x")
    assert storage.read(f"{tmp_path}/d/tile_1.png") == b"two" and storage.names(f"{tmp_path}/d") == ["other.txt", "tile_1.png"]
    assert storage.clean(f"{tmp_path}/d", "tile_*.png") == 1 and storage.names(f"{tmp_path}/d") == ["other.txt"] and storage.names(f"{tmp_path}/none") == []
    assert storage.sha256(f"{tmp_path}/d/other.txt") == hashlib.sha256(b"x").hexdigest()
    with pytest.raises(FileNotFoundError):
        storage.read(f"{tmp_path}/none")


def test_registry(spark, tmp_path):
    tiles = tiling.grid(spark, 1280, 1024)
    path = f"{tmp_path}/tiles.csv"
    tables.write_registry(tiles.filter("tile_ord < 3"), path, "tile_ord")
    tables.write_registry(tiles.repartition(5), path, "tile_ord")
    assert storage.names(str(tmp_path), "*") == ["tiles.csv"] and (tmp_path / "tiles.csv").read_text().splitlines()[:2] == ["tile_id,x_origin,y_origin,width,height", "tile_0001.png,0,0,512,512"]
    back = tables.with_ordinal(tables.read_registry(spark, path, tables.TILES), "tile_ord", "tile_id")
    assert sorted(map(tuple, back.select(tiles.columns).collect())) == sorted(map(tuple, tiles.collect()))
    assert tables.map_size(back) == (1280, 1024) and tables.map_size(back, {"map_width": 1, "map_height": 2}) == (1, 2)
    assert tables.read_run_info(f"{tmp_path}/none.json") == {}
    tables.write_json({"a": [1, None]}, f"{tmp_path}/info.json")
    assert tables.read_run_info(f"{tmp_path}/info.json") == {"a": [1, None]}


def test_feature_cache(spark, tmp_path):
    tiles = tiling.grid(spark, 1280, 1024)
    features = tiles.selectExpr("tile_id AS image_id", "array(1f) AS x", "array(2f) AS y", "array(1f) AS scores", "array(1f, 2f) AS descriptors", "CAST(tile_ord AS INT) AS n_keypoints", "0.5D AS time_extract")
    sign = tables.signature({"name": "corners", "device": "cpu"}, 1.0, "a", None)
    folder = f"{tmp_path}/cache"
    with pytest.raises(FileNotFoundError):
        tables.read_cache(spark, folder, sign, tiles)
    manifest = tables.write_cache(features, folder, sign)
    assert manifest["tiles"] == 12 and manifest["keypoints"] == {"min": 1, "mean": 6.5, "max": 12} and manifest["extract_time_sec"] == {"total": 6.0, "mean": 0.5} and manifest["size_bytes"] > 0
    assert tables.read_cache(spark, folder, sign, tiles.filter("tile_ord < 4")).count() == 3
    other = sign | {"work_scale": 0.5}
    for refused in (lambda: tables.write_cache(features, folder, other), lambda: tables.read_cache(spark, folder, other, tiles)):
        with pytest.raises(RuntimeError):
            refused()
    with pytest.raises(FileNotFoundError):
        tables.read_cache(spark, folder, sign, tiles.withColumn("tile_id", F.lit("tile_9999.png")))
    assert tables.write_cache(features.withColumn("n_keypoints", F.lit(None).cast("int")), folder, other, overwrite=True)["keypoints"] is None
    with pytest.raises(ValueError):
        tables.write_cache(features.limit(0), f"{tmp_path}/empty", sign)


def avi(frames, fps, fourcc, width, height):
    """An AVI file of one video stream, as cameras write it."""
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    listed = lambda name, data: chunk(b"LIST", name + data)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", fourcc if fourcc != b"DIB " else b"\0\0\0\0", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, fourcc, 0, 0, 0, 0, 0)
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    hdrl = listed(b"hdrl", chunk(b"avih", avih) + listed(b"strl", chunk(b"strh", strh) + chunk(b"strf", strf)))
    movi = listed(b"movi", b"".join(chunk(b"00dc", f) for f in frames))
    body = b"AVI " + hdrl + chunk(b"JUNK", b"123") + movi
    return b"RIFF" + struct.pack("<I", len(body)) + body


def jpeg(spark, pixels):
    """Encoded by the JVM, which is what decodes it."""
    jvm, (h, w) = spark._jvm, pixels.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            image.setRGB(x, y, int.from_bytes(pixels[y, x].tobytes(), "big"))
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def coded(k):
    """A picture that says its number, in eight squares."""
    return np.repeat(np.repeat(np.array([[255 * (k >> b & 1) for b in range(8)]], np.uint8), 16, 0), 16, 1)[..., None].repeat(3, 2)


def test_video_headers(spark, tmp_path):
    (tmp_path / "a.avi").write_bytes(avi([b"x" * 11, b"y"], 30, b"MJPG", 320, 180))
    box = lambda name, *data: struct.pack(">I4s", 8 + sum(map(len, data)), name) + b"".join(data)
    entry = struct.pack(">I4s6xH16xHH", 86, b"avc1", 1, 1920, 1080) + bytes(50)
    stbl = box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1), entry), box(b"stts", struct.pack(">IIII", 0, 1, 95, 1001)))
    mdia = box(b"mdia", box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, 30_000, 95 * 1001)), box(b"hdlr", bytes(8) + b"vide" + bytes(12)), box(b"minf", stbl))
    sound = box(b"trak", box(b"mdia", box(b"hdlr", bytes(8) + b"soun" + bytes(12))))
    (tmp_path / "b.mp4").write_bytes(box(b"ftyp", b"isom", bytes(4)) + box(b"mdat", bytes(100)) + box(b"moov", box(b"mvhd", bytes(100)), sound, box(b"trak", mdia)))
    videos = spark.createDataFrame([(f"{tmp_path}/a.avi",), (f"{tmp_path}/b.mp4",)], "video string")
    got = {r.video[-5:]: r for r in video.probe(videos).collect()}
    assert (got["a.avi"].fps, got["a.avi"].frame_count_header, got["a.avi"].width, got["a.avi"].height, got["a.avi"].fourcc) == (30.0, 2, 320, 180, "MJPG")
    assert (got["b.mp4"].fps, got["b.mp4"].frame_count_header, got["b.mp4"].width, got["b.mp4"].fourcc) == (pytest.approx(30_000 / 1001), 95, 1920, "avc1")
    audit = [(r.target_fps, r.frames) for r in video.audit(video.probe(videos)).filter("video LIKE '%b.mp4'").orderBy("target_fps").collect()]
    assert audit == [(1, 3), (2, 6), (5, 15), (10, 31)]
    (tmp_path / "c.mkv").write_bytes(b"no video at all")
    with pytest.raises(RuntimeError):
        video.header(f"{tmp_path}/c.mkv")
    with pytest.raises(RuntimeError):
        video.default_video(str(tmp_path))
    (tmp_path / "a.avi").unlink()
    (tmp_path / "c.mkv").unlink()
    assert video.default_video(str(tmp_path)) == f"{tmp_path}/b.mp4" == video.default_video("elsewhere", f"{tmp_path}/b.mp4")
    (tmp_path / "b.mp4").unlink()
    with pytest.raises(FileNotFoundError):
        video.default_video(str(tmp_path))


@pytest.mark.parametrize("codec", [b"DIB ", b"MJPG"])
def test_frames_of_a_coded_video(spark, tmp_path, codec):
    pictures = {k: coded(k) for k in range(95)}
    if codec == b"MJPG":
        kept = {k: jpeg(spark, pictures[k]) for k in (0, 30, 60, 90)}
        frames = [kept.get(k, b"never read") for k in range(95)]
    else:
        frames = [pictures[k][::-1, :, ::-1].tobytes() for k in range(95)]
    (tmp_path / "v.avi").write_bytes(avi(frames, 30, codec, 128, 16))
    out, csv, info = f"{tmp_path}/frames", f"{tmp_path}/frames.csv", f"{tmp_path}/info.json"
    storage.write(f"{out}/frame_0009.png", b"old")
    prepare.prepare_frames(spark, f"{tmp_path}/v.avi", out, csv, info)
    rows = sorted(map(tuple, tables.read_registry(spark, csv, tables.FRAMES).collect()))
    assert rows == [(f"frame_{k + 1:04d}.png", 30 * k, float(k), 128, 16) for k in range(4)]
    assert storage.names(out) == [r[0] for r in rows]
    for image in imaging.read_images(spark, out).collect():
        pixels = np.frombuffer(image.rgb, np.uint8).reshape(16, 128, 3)
        assert sum(int(pixels[8, 16 * b + 8, 0] > 127) << b for b in range(8)) == 30 * (int(image.name[6:10]) - 1)
    record = tables.read_run_info(info)
    assert record["video_fps"] == 30.0 and record["every_n"] == 30 and record["frame_count"] == 4 and record["frames_decoded"] == 95 and record["effective_fps"] == 1.0
    assert integrity.report(prepare.check_frames(spark, out, csv, info, (128, 16))[0]) == ([], 0)
    figures = prepare.check_frames(spark, out, csv, info)[1].first()
    assert (figures.frames, figures.span_sec, figures.images_checked) == (4, 3.0, 4)
    storage.write(f"{out}/frame_0002.png", imaging.png(pictures[1][..., 0]))
    storage.clean(out, "frame_0003.png")
    storage.write(f"{out}/frame_0100.png", imaging.png(pictures[1]))
    lines, _ = integrity.report(prepare.check_frames(spark, out, csv, info, (128, 17))[0])
    assert {x.split(":")[0] for x in lines} == {"channels", "missing", "stale", "size"}
    with pytest.raises(FileNotFoundError):
        prepare.prepare_frames(spark, f"{tmp_path}/none.avi", out, csv)
    with pytest.raises(RuntimeError):
        prepare.prepare_frames(spark, f"{tmp_path}/v.avi", out, csv, start_sec=60.0)


def test_map_tiles_and_their_check(spark, tmp_path):
    r = np.random.default_rng(0)
    pixels = np.dstack([r.integers(0, 256, (300, 420, 3)), np.full((300, 420), 255)]).astype(np.uint8)
    pixels[:50, :50, 3] = 0
    (tmp_path / "map.png").write_bytes(imaging.png(pixels))
    map_path, out, csv, info = (f"{tmp_path}/{x}" for x in ("map.png", "tiles", "tiles.csv", "info.json"))
    storage.write(f"{out}/tile_9999.png", b"old")
    prepare.prepare_map(spark, map_path, out, csv, info, size=128)
    record = tables.read_run_info(info)
    assert record["tile_count"] == record["grid_cols"] * record["grid_rows"] == len(storage.names(out)) and record["x_origins"] == [0, 64, 128, 192, 256, 292]
    assert record["had_alpha"] and not record["alpha_fully_opaque"] and record["map_sha256"] == hashlib.sha256((tmp_path / "map.png").read_bytes()).hexdigest()
    violations, figures = prepare.check_tiles(spark, map_path, out, csv, info)
    assert integrity.report(violations) == ([], 0)
    row = figures.first()
    assert (row.tiles, row.cols, row.rows, row.pixel_checked, row.min_cover) == (24, 6, 4, 24, 1)
    assert prepare.check_tiles(spark, map_path, out, csv, info, sample=5)[1].first().pixel_checked == 5
    blended = imaging.blend(pixels)
    first = np.frombuffer(imaging.read_images(spark, f"{out}/tile_0001.png").first().rgb, np.uint8).reshape(128, 128, 3)
    assert np.array_equal(first, blended[:128, :128]) and first[0, 0].tolist() == [255, 255, 255]
    # every kind of damage is found
    changed = blended[:128, 64:192].copy()
    changed[3, 4, 1] ^= 5
    storage.write(f"{out}/tile_0002.png", imaging.png(changed))
    storage.write(f"{out}/tile_0003.png", imaging.png(blended[:128, 128:255]))
    storage.write(f"{out}/tile_0004.png", imaging.png(blended[:128, 192:320, 0]))
    storage.clean(out, "tile_0005.png")
    storage.write(f"{out}/tile_0100.png", b"")
    storage.clean(out, "tile_0100.png")
    storage.write(f"{out}/tile_0101.png", imaging.png(changed))
    storage.write(map_path, imaging.png(np.ascontiguousarray(pixels)) + b" ")
    rows = tables.with_ordinal(tables.read_registry(spark, csv, tables.TILES), "o", "tile_id").filter("o <> 24").drop("o").collect()
    tables.write_registry(spark.createDataFrame(rows, tables.TILES), csv)
    lines, _ = integrity.report(prepare.check_tiles(spark, map_path, out, csv, info)[0])
    assert {x.split(":")[0] for x in lines} == {"map_changed", "not_covered", "count", "missing", "stale", "pixels", "file_size", "channels"}
    diff = imaging.differences(imaging.crops(spark.createDataFrame(rows, tables.TILES), imaging.read_images(spark, map_path)), imaging.read_raw(spark, f"{out}/tile_000*.png"))
    assert {r.tile_id: r.max_abs_diff for r in diff.collect() if r.tile_id in ("tile_0001.png", "tile_0002.png", "tile_0003.png")} == {"tile_0001.png": 0, "tile_0002.png": int(abs(int(changed[3, 4, 1]) - int(blended[3, 68, 1]))), "tile_0003.png": None}


def test_empty_and_null_registries(spark):
    rows = spark.createDataFrame([("tile_0001.png", None, 0, 512, 512)], tables.TILES)
    assert [tuple(r) for r in integrity.columns(rows, "tiles").collect()] == [("nulls", "x_origin")]
    assert [tuple(r) for r in integrity.columns(rows.limit(0), "tiles").collect()] == [("no_rows", "tiles")]
    many = spark.range(50).selectExpr("'c' AS check", "CAST(id AS STRING) AS subject")
    lines, n = integrity.report(many)
    assert n == 50 and len(lines) == 31 and lines[-1] == "... and 20 more"
