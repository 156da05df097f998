"""The engine's commands: ``python -m skylocus.cli COMMAND --help``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from skylocus.operators import homography, imaging, integrity, matching
from skylocus.plans import experiment, localize, prepare, report
from skylocus.sources import storage, video


def picked_region(x: int, y: int, w: int, h: int, scale: float) -> tuple[int, int, int, int]:
    """A region picked on a picture shown at ``scale``, in pixels of the whole picture."""
    return tuple(int(v / scale) for v in (x, y, w, h))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skylocus", description=__doc__.splitlines()[0])
    commands = p.add_subparsers(dest="command", required=True)

    c = commands.add_parser("prepare-map", help="cut a map into tiles")
    for name in ("--map", "--output", "--metadata"):
        c.add_argument(name, required=True)
    c.add_argument("--run-info")
    c.add_argument("--tile-size", type=int, default=512)
    c.add_argument("--overlap", type=float, default=0.5)
    c.add_argument("--roi", type=int, nargs=4, metavar=("X", "Y", "W", "H"))
    c.add_argument("--background", type=int, nargs=3, default=[255, 255, 255])
    c.add_argument("--keep-existing", action="store_true")

    c = commands.add_parser("prepare-frames", help="sample a video's frames")
    c.add_argument("--video")
    c.add_argument("--video-dir", default=".")
    for name in ("--output", "--metadata"):
        c.add_argument(name, required=True)
    c.add_argument("--run-info")
    rate = c.add_mutually_exclusive_group()
    rate.add_argument("--fps", type=float, default=1.0)
    rate.add_argument("--every-n", type=int)
    c.add_argument("--limit", type=int)
    c.add_argument("--start-sec", type=float, default=0.0)
    c.add_argument("--keep-existing", action="store_true")

    c = commands.add_parser("check", help="whether tiles and frames are whole")
    for name in ("--map", "--tiles-dir", "--tiles-csv", "--tiles-info", "--frames-dir", "--frames-csv", "--frames-info"):
        c.add_argument(name)
    c.add_argument("--frame-size", type=int, nargs=2, metavar=("W", "H"))
    c.add_argument("--sample", type=int)
    c.add_argument("--skip-tiles", action="store_true")
    c.add_argument("--skip-frames", action="store_true")

    c = commands.add_parser("evaluate", help="match pairs by several methods")
    for name in ("--pairs", "--tiles-csv", "--frames-dir", "--tiles-dir", "--output"):
        c.add_argument(name, required=True)
    c.add_argument("--methods", nargs="+", default=["corners"])
    c.add_argument("--device", default="cpu")
    c.add_argument("--frame-scale", type=float, default=0.27)
    c.add_argument("--work-scale", type=float, default=1.0)
    c.add_argument("--ransac-method", choices=homography.METHODS, default="RANSAC")
    c.add_argument("--ransac-threshold", type=float, default=3.0)
    c.add_argument("--min-inliers", type=int, default=15)
    c.add_argument("--repeats", type=int, default=1)
    c.add_argument("--warmup", type=int, default=0)
    c.add_argument("--figures-dir")

    c = commands.add_parser("summarize", help="summaries of an experiment")
    c.add_argument("--input", required=True)
    c.add_argument("--output-dir", required=True)

    for name, text in (("build-cache", "keep the tiles' features"), ("localize", "locate a frame on the map")):
        c = commands.add_parser(name, help=text)
        for flag in ("--tiles-csv", "--tiles-dir"):
            c.add_argument(flag, required=True)
        c.add_argument("--tiles-info")
        c.add_argument("--cache-dir", required=name == "build-cache")
        c.add_argument("--work-scale", type=float, default=1.0)
        c.add_argument("--matcher", default="corners")
        c.add_argument("--device", default="cpu")
        if name == "build-cache":
            c.add_argument("--overwrite", action="store_true")
            continue
        for flag in ("--frame", "--output", "--rankings-dir"):
            c.add_argument(flag, required=True)
        c.add_argument("--frames-dir", default=".")
        c.add_argument("--roi", type=int, nargs=4, metavar=("X_MIN", "Y_MIN", "X_MAX", "Y_MAX"))
        c.add_argument("--grid-step", type=int, default=1)
        c.add_argument("--top-k", type=int, default=5)
        c.add_argument("--warmup", type=int, default=0)
        c.add_argument("--no-cache", action="store_true")
        c.add_argument("--map")
        c.add_argument("--figures-dir")

    c = commands.add_parser("audit", help="what a video and a map are")
    c.add_argument("--video")
    c.add_argument("--map")

    c = commands.add_parser("region", help="a region picked on a smaller picture, in pixels of the whole")
    c.add_argument("picked", type=int, nargs=4, metavar=("X", "Y", "W", "H"))
    c.add_argument("--scale", type=float, required=True)
    return p


def resolve_frame(value: str, frames_dir: str) -> str:
    """A frame's file: as named, or of that name in the frames' folder."""
    for path in (value, f"{frames_dir}/{value.rpartition('/')[2]}"):
        if storage.exists(path):
            return path
    raise FileNotFoundError(f"there is no frame {value}")


def _say(title: str, checked: tuple) -> int:
    violations, figures = checked
    lines, n = integrity.report(violations)
    print(f"[{title}] {'OK' if not n else f'FAILED ({n})'} {figures.first().asDict()}", *lines, sep="\n    ")
    return n


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """Run a command; returns 1 if a check fails, else 0."""
    a = args
    if a.command == "prepare-map":
        tiles = prepare.prepare_map(spark, a.map, a.output, a.metadata, a.run_info, a.tile_size, a.overlap, tuple(a.roi) if a.roi else None, tuple(a.background), not a.keep_existing)
        print(f"{tiles.count()} tiles in {a.output}")
    elif a.command == "prepare-frames":
        path = video.default_video(a.video_dir, a.video) if not a.video else a.video
        frames = prepare.prepare_frames(spark, path, a.output, a.metadata, a.run_info, a.fps, a.every_n, a.limit, a.start_sec, not a.keep_existing)
        print(f"{frames.count()} frames in {a.output}")
    elif a.command == "check":
        n = 0
        if not a.skip_tiles:
            n += _say("TILES", prepare.check_tiles(spark, a.map, a.tiles_dir, a.tiles_csv, a.tiles_info, sample=a.sample))
        if not a.skip_frames:
            n += _say("FRAMES", prepare.check_frames(spark, a.frames_dir, a.frames_csv, a.frames_info, tuple(a.frame_size) if a.frame_size else None))
        return int(n > 0)
    elif a.command == "evaluate":
        config = localize.Pipeline(a.frame_scale, a.work_scale, a.min_inliers, homography.Ransac(a.ransac_method, a.ransac_threshold))
        rows = experiment.evaluate(spark, a.pairs, a.tiles_csv, a.frames_dir, a.tiles_dir, a.output, a.methods, config, a.repeats, a.warmup, a.device, a.figures_dir)
        print(f"{rows.count()} rows in {a.output}")
    elif a.command == "summarize":
        print(*experiment.summarize(spark, a.input, a.output_dir), sep="\n")
    elif a.command == "build-cache":
        config = localize.Pipeline(work_scale=a.work_scale)
        print(json.dumps(report.build_cache(spark, a.tiles_csv, a.tiles_dir, a.cache_dir, matching.create(a.matcher, a.device), a.tiles_info, config, a.overwrite), indent=2))
    elif a.command == "localize":
        found = report.localize_frame(
            spark, resolve_frame(a.frame, a.frames_dir), a.tiles_csv, a.tiles_dir, matching.create(a.matcher, a.device), a.rankings_dir, a.output, tuple(a.roi) if a.roi else None, a.grid_step, a.top_k,
            None if a.no_cache else a.cache_dir, a.tiles_info, a.map, a.figures_dir, localize.Pipeline(work_scale=a.work_scale), warmup=a.warmup)
        print(f"{found['winner']['tile_id']} at {found['winner']['center_map']}" if found["success"] else "no tile passed the gate")
    elif a.command == "audit":
        if a.video:
            video.audit(video.probe(spark.createDataFrame([(a.video,)], "video string"))).show(truncate=False)
        if a.map:
            imaging.read_images(spark, a.map).drop("rgb").show(truncate=False)
    elif a.command == "region":
        print(*picked_region(*a.picked, a.scale))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("skylocus").getOrCreate()
    try:
        return run(spark, args)
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
