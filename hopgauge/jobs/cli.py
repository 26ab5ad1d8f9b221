"""Command line: python -m hopgauge.jobs.cli qc|pathmean|extract ... on Parquet tables."""

from __future__ import annotations

import argparse
import json
import time

from pyspark import StorageLevel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from hopgauge.jobs import satellite
from hopgauge.operators import blocks, geo, quality, rain
from hopgauge.sources import arrays, cubes, scenes, sinks


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    sub = p.add_subparsers(dest="job", required=True)
    qc = sub.add_parser("qc", help="quality flags of links")
    qc.add_argument("--samples", required=True, help="table, or an array file of signals (NPZ, or NetCDF where its library is there), which has links and sublinks, too")
    for name in ("--links", "--sublinks"):
        qc.add_argument(name, help="table")
    qc.add_argument("--proc-line", choices=quality.PROC_LINES, default="full")
    qc.add_argument("--strict", action="store_true", help="complete windows only, gaps by time")
    qc.add_argument("--first-links", type=int, default=0)
    qc.add_argument("--block-rows", type=int, default=0, help="samples of a series in one task at most, for long series (not with --strict)")
    qc.add_argument("--regression", action="store_true", help="attenuation by frequency and polarization as published (ITU-R P.838-3)")
    qc.add_argument("--time-save-apart", action="store_true", help="compute first and save then, to tell the seconds apart")
    mean = sub.add_parser("pathmean", help="path means of satellite scenes")
    for name in ("--pixels", "--weights", "--start", "--end"):
        mean.add_argument(name, required=True)
    ext = sub.add_parser("extract", help="path means of scenes from link geometry and a grid; weights are built once and kept")
    for name in ("--geometry", "--channels", "--weights-folder", "--start", "--end"):
        ext.add_argument(name, required=True, help={"--channels": "names, with commas between", "--geometry": "table, or array file of links"}.get(name))
    given = ext.add_mutually_exclusive_group(required=True)
    given.add_argument("--scenes", help="table: path, scene_time, channels, error")
    given.add_argument("--files", help="folder of scene files (NPZ, or NetCDF where its library is there); goes on where an earlier run stopped")
    ext.add_argument("--grid", help="JSON: x, y, height, lon_0, a, b, sweep; for files it may be left out, then the first scene has it")
    ext.add_argument("--flush", type=int, default=1024, help="scenes in a flush, about")
    for s in (qc, mean, ext):
        s.add_argument("--out", required=True)
        s.add_argument("--overwrite", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.job == "qc":
        if a.samples.endswith((".npz", ".nc")):
            samples, links, sublinks = cubes.read(spark, a.samples)
        elif a.links and a.sublinks:
            samples, links, sublinks = (spark.read.parquet(x) for x in (a.samples, a.links, a.sublinks))
        else:
            raise SystemExit("a table of samples needs --links and --sublinks")
        if a.first_links:
            samples = quality.first_links(samples, links, a.first_links)
        config, began = quality.Config(a.proc_line, a.strict), time.time()
        coefficient = rain.regression if a.regression else quality.attenuation
        given = samples, links.select("cml_id", "length_km"), sublinks, config, coefficient
        found = blocks.run(*given, rows=a.block_rows) if a.block_rows else quality.run(*given)
        computed = None
        if a.time_save_apart:
            found = quality.Result(*(df.persist(StorageLevel.MEMORY_AND_DISK) for df in found))
            for df in found:
                df.count()
            computed = time.time() - began
        for name, df in found._asdict().items():
            sinks.save(df, f"{a.out}/{name}", a.overwrite)
        # Spark computes while it saves, so the seconds without saving are known only if that was done apart
        sinks.save_info(spark, quality.run_info(config, computed) | {"qc_elapsed_seconds": time.time() - began}, f"{a.out}/info", a.overwrite)
    elif a.job == "extract":
        extract(spark, a)
    else:
        pixels = spark.read.parquet(a.pixels).where(F.col("scene_time").between(a.start, a.end))
        sinks.save_means(geo.path_means(pixels, spark.read.parquet(a.weights)), a.out, a.overwrite)


def extract(spark: SparkSession, a: argparse.Namespace) -> None:
    channels = a.channels.split(",")
    if a.geometry.endswith((".npz", ".nc")):
        geometry = arrays.geometry_of(spark, arrays.opened(arrays.content_of(spark, a.geometry)))
    else:
        geometry = spark.read.parquet(a.geometry)
    if a.grid:
        grid = json.loads(a.grid)
        grid = satellite.Grid(**(grid | {"x": tuple(grid["x"]), "y": tuple(grid["y"])}))
    elif a.files:
        grid = satellite.grid_of_first(spark, a.files, a.start, a.end)
    else:
        raise SystemExit("scenes in a table need --grid")
    began = time.time()
    paths = satellite.stored_paths(geometry, grid, a.weights_folder)
    weights, began = time.time() - began, time.time()
    if a.files:
        if a.overwrite:
            for name in satellite.Extraction._fields:
                sinks.remove(spark, f"{a.out}/{name}")
        done = satellite.extract_to(spark, a.files, a.start, a.end, arrays.scene_decoder(channels), geometry, grid, channels, a.weights_folder, a.out, a.flush)
    else:
        found = scenes.require_some(spark.read.parquet(a.scenes).where(F.col("scene_time").between(a.start, a.end)), a.scenes, a.start, a.end)
        done = satellite.extract(found, paths, channels)
        sinks.save_means(done.means, f"{a.out}/means", a.overwrite)
    seconds = time.time() - began
    counts = scenes.outcome_counts(done.outcomes).first().asDict()
    sinks.save(geo.link_coverage(paths), f"{a.out}/links", a.overwrite or bool(a.files))
    info = counts | {"weight_seconds": weights, "extract_seconds": seconds, "scenes_per_second": counts["n_scenes"] / seconds}
    sinks.save_info(spark, info, f"{a.out}/info", a.overwrite or bool(a.files))


if __name__ == "__main__":
    main()
