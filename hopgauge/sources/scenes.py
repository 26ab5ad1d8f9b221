"""Satellite scenes: the catalogue of files by time, and pixels from packed rasters."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgauge.functions.cftime import cf_time

Decoder = Callable[[bytes], tuple[object, dict[str, object]]]
#: Names of scene files.
FILES = "SEVIRI_*.nc"
#: Base names of scene files (fixed format): date and time to the second.
NAME = r"SEVIRI_([0-9]{8})_([0-9]{6})\.nc$"


def scene_time(path: Column) -> Column:
    """Time in a scene's file name; NULL for other names and for dates that do not exist."""
    base = F.element_at(F.split(path, "/"), -1)
    digits = F.concat(F.regexp_extract(base, NAME, 1), F.regexp_extract(base, NAME, 2))
    return F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))


def catalogue(files: DataFrame, start: str, end: str, content_time: Column | None = None) -> DataFrame:
    """path, scene_time of the files within both ends, in order of time; content_time counts where the name has none."""
    time = scene_time(F.col("path"))
    if content_time is not None:
        time = F.coalesce(time, content_time)
    found = files.select("path", time.alias("scene_time"))
    return found.where(F.col("scene_time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).orderBy("scene_time", "path")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path of the scene files in a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", FILES).load(folder).select("path")


def require_some(found: DataFrame, folder: str, start: str, end: str) -> DataFrame:
    if found.isEmpty():
        raise FileNotFoundError(f"no scene in {folder} between {start} and {end}")
    return found


class File(NamedTuple):
    path: str
    date: datetime.date | None


def files_between(spark: SparkSession, folder: str, start: str, end: str, done: DataFrame | None = None) -> list[File]:
    """The files of a folder whose names have a time within both ends, or none; without those in ``done`` (path). In order of time.

    Only names are looked at. The list is what Spark's own listing of the folder holds on the driver anyway.
    """
    named = list_files(spark, folder).withColumn("time", scene_time(F.col("path")))
    named = named.where(F.col("time").isNull() | F.col("time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    named = named if done is None else named.join(done, "path", "left_anti")
    return [File(*r) for r in named.orderBy("time", "path").select("path", F.to_date("time").alias("date")).collect()]


def read_files(spark: SparkSession, paths: Sequence[str], decode: Decoder, channels: Sequence[str] | None = None) -> DataFrame:
    """path, scene_time, channels, error of scene files; no other file is opened, and each is decoded once, in one task.

    decode gives a file's own time (which counts where the name has none: epoch microseconds, or value, units and calendar, or None) and its channels
    (arrays of rows and columns, perhaps masked, perhaps with a first axis of length 1), of which the wanted ones are kept. What goes
    wrong with a file becomes its error.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                time, rasters, error = None, {}, None
                try:
                    time, arrays = decode(batch.column(1)[k].as_py())
                    rasters = {c: flat_raster(a) for c, a in arrays.items() if channels is None or c in channels}
                    time = (time, "us") if isinstance(time, (int, np.integer)) else time
                except Exception as e:  # noqa: BLE001 - one bad file must not stop the job; its error is kept
                    error = f"{type(e).__name__}: {e}"
                value, units, calendar = (*(time or ()), None, None, None)[:3]
                sizes = np.r_[0, np.cumsum([len(v) for v in rasters.values()])].astype(np.int32)
                values = pa.ListArray.from_arrays(sizes, pa.array(np.concatenate([*rasters.values(), np.zeros(0, np.float32)]), pa.float32()))
                maps = pa.MapArray.from_arrays(np.array([0, len(rasters)], np.int32), pa.array(list(rasters), pa.string()), values)
                texts = [pa.array([None if v is None else str(v)], pa.string()) for v in (value, units, calendar, error)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), maps, *texts], ["path", "channels", "value", "units", "calendar", "error"])

    found = files.mapInArrow(opened, "path string, channels map<string,array<float>>, value string, units string, calendar string, error string")
    value = F.col("value").try_cast("decimal(28,9)")
    own = F.when(F.col("units") == "us", F.timestamp_micros(value.cast("long"))).when(value.isNotNull(), cf_time(value, F.col("units"), F.col("calendar")))
    ok = F.col("error").isNull()
    return found.select("path", F.coalesce(scene_time(F.col("path")), own).alias("scene_time"), F.when(ok, F.col("channels")).alias("channels"), "error")


def read(spark: SparkSession, folder: str, start: str, end: str, decode: Decoder, channels: Sequence[str] | None = None) -> DataFrame:
    """``read_files`` of the scenes of a folder within both ends; none is an error. Files whose names tell that they are out of range are never opened."""
    files = files_between(spark, folder, start, end)
    if not files:
        raise FileNotFoundError(f"no scene in {folder} between {start} and {end}")
    found = read_files(spark, [f.path for f in files], decode, channels).where(F.col("scene_time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    # only contents tell whether there is a scene if no name has a time
    return found if any(f.date for f in files) else require_some(found, folder, start, end)


def flat_raster(values: object) -> np.ndarray:
    """A raster's values by pixel number (row * nx + col); masked ones are NaN, a first axis of length 1 is none."""
    filled = np.ma.filled(np.ma.asarray(values, dtype="float32"), np.nan)
    if filled.ndim == 3 and filled.shape[0] == 1:
        filled = filled[0]
    return filled.reshape(-1)


def pixels(rasters: DataFrame) -> DataFrame:
    """scene_time, channel, pix, value from rasters (scene_time, channel, values): the pixel's number is row * nx + col."""
    return rasters.select("scene_time", "channel", F.posexplode("values").alias("pix", "value")).withColumn("pix", F.col("pix").cast("long"))


def outcome_counts(scenes: DataFrame, errors: int = 10) -> DataFrame:
    """One row: scenes, written, failed, and the first errors by path (a top-k report). scenes: path, error (NULL: written)."""
    counts = scenes.agg(F.count(F.lit(1)).alias("n_scenes"), F.count_if(F.col("error").isNull()).alias("n_written"), F.count("error").alias("n_failed"))
    first = scenes.where("error IS NOT NULL").orderBy("path").limit(errors).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "error"))), lambda x: F.concat_ws(": ", x["path"], x["error"])), "; ").alias("first_errors"))
    return counts.crossJoin(F.broadcast(first))  # one row each


def demo(spark: SparkSession, scenes: int = 96, ny: int = 80, nx: int = 100, links: int = 500, channels: int = 8, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Synthetic links (geometry) and pixels, for benchmarks."""
    where = [F.rand(seed + k) for k in range(4)]
    geometry = spark.range(links).select(
        F.col("id").alias("cml_id"), (16 * where[0] - 8).alias("site_a_longitude"), (30 * where[1] + 5).alias("site_a_latitude"), (16 * where[2] - 8).alias("site_b_longitude"), (30 * where[3] + 5).alias("site_b_latitude")
    )
    pix = spark.range(scenes * channels * ny * nx).select(
        F.timestamp_seconds(F.lit(1609459200) + 900 * F.floor(F.col("id") / (channels * ny * nx))).alias("scene_time"),
        F.pmod(F.floor(F.col("id") / (ny * nx)), F.lit(channels)).cast("int").alias("channel"),
        F.pmod("id", F.lit(ny * nx)).alias("pix"),
    )
    x, y = F.pmod("pix", F.lit(nx)) / (nx - 1), F.floor(F.col("pix") / nx) / (ny - 1)
    return geometry, pix.withColumn("value", (250 + 3 * F.col("channel") + 5 * x + 2 * y + 0.5 * F.randn(seed)).cast("float"))
