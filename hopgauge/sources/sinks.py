"""Where results go."""

from __future__ import annotations

import hashlib
import json
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def output_path(source: str, given: str | None = None) -> str:
    """The given path, else the source's with _QC behind its stem."""
    if given:
        return given
    p = PurePosixPath(source)
    return f"{source[: len(source) - len(p.name)]}{p.stem}_QC{p.suffix}"


def save(df: DataFrame, path: str, overwrite: bool = False, by: tuple[str, ...] = ()) -> None:
    """Parquet; an existing result is an error unless it shall be overwritten. Values keep their types."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def save_means(means: DataFrame, path: str, overwrite: bool = False) -> None:
    """Path means (K) by scene date, with the scene's time in nanoseconds since 1970 beside the timestamp (microseconds)."""
    means = means.withColumns({"scene_date": F.to_date("scene_time"), "epoch_ns": F.unix_micros(F.col("scene_time").cast("timestamp")) * 1000})
    save(means.withMetadata("path_mean", {"units": "K"}), path, overwrite, ("scene_date",))


def save_info(spark: SparkSession, info: dict, path: str, overwrite: bool = False) -> None:
    """One JSON row beside a result."""
    spark.createDataFrame([(json.dumps(info, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _fs(spark: SparkSession, path: str):  # noqa: ANN202 - objects of the JVM
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def flushes(spark: SparkSession, folder: str) -> dict[str, bool]:
    """The flushes (tables in folders flush=...) of a folder, and whether they were written to their end."""
    at, fs = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return {n.removeprefix("flush="): complete(spark, f"{folder}/{n}") for n in names if n.startswith("flush=")}


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def read_flushes(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/flush={k}" for k in keys]).drop("flush")


def weights_key(links: DataFrame, edges: tuple[list[float], list[float]]) -> str:
    """Name of a stored table of weights, which depends on the links' geometry and the grid, so that no stale one is used again."""
    row = links.agg(F.sum(F.xxhash64("cml_id", "x0", "y0", "x1", "y1").cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")).first()
    return f"{row['n']}-{hashlib.sha256(repr((str(row['h']), *map(list, edges))).encode()).hexdigest()[:16]}"
