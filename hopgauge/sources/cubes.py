"""Signal cubes: array files with transmit and receive levels by time, sublink and link in any order of the dimensions, as the tables of the link quality job.

A file is opened in one task and turned into a row for each series, which holds its signals as arrays in the order of time; the time axis stays as it is
stored until rows are melted to samples by ``inline``, so no sample is a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopgauge.functions.cftime import cf_time
from hopgauge.sources.arrays import Arrays, opened

DIMS = ("cml_id", "sublink_id", "time")
SIGNALS = (("tsl", "rsl"), ("tx", "rx"))


class Cube(NamedTuple):
    samples: DataFrame
    links: DataFrame
    sublinks: DataFrame


def ordered(found: Arrays, name: str) -> np.ndarray:
    """A variable by link, sublink and time; dimensions that it lacks (as one without sublinks) count as of length 1 or are repeated."""
    v = found.variables[name]
    if unknown := set(v.dims) - set(DIMS):
        raise ValueError(f"{name} has dimensions that signals do not have: {sorted(unknown)}")
    values = np.ma.filled(np.ma.asarray(v.values, dtype=float), np.nan)
    values = np.transpose(values, [v.dims.index(d) for d in DIMS if d in v.dims])
    return values[tuple(slice(None) if d in v.dims else None for d in DIMS)]


def axis(found: Arrays, name: str, size: int) -> list[str]:
    """Coordinates as text; numbered from 0 if the file has none."""
    return [str(x) for x in np.ravel(found.variables[name].values).tolist()] if name in found.variables else [str(k) for k in range(size)]


def signals(found: Arrays) -> tuple[str, str]:
    for pair in SIGNALS:
        if set(pair) <= found.variables.keys():
            return pair
    raise KeyError("a cube needs the variables tsl and rsl, or tx and rx")


def static(found: Arrays, name: str, links: int, sublinks: int) -> np.ndarray:
    """A variable by link and sublink as a flat array; all missing if there is none."""
    if name not in found.variables:
        return np.full(links * sublinks, None)
    v = found.variables[name]
    values = np.transpose(np.ma.filled(v.values, np.nan) if np.ma.isMaskedArray(v.values) else v.values, [v.dims.index(d) for d in DIMS[:2] if d in v.dims])
    values = values[tuple(slice(None) if d in v.dims else None for d in DIMS[:2])]
    return np.broadcast_to(values, (links, sublinks)).ravel()


def read(spark: SparkSession, path: str) -> Cube:
    """The cubes of a file, or of the files of a folder or pattern (each with links of its own): samples (cml_id, sublink_id, time, signals as tsl and rsl),
    links (cml_id, pos, length_km) and sublinks (cml_id, sublink_id, frequency, polarization). NaN and masked values are NULL. A file that can't be read is an error."""
    schema = "cml_id string, sublink_id string, pos long, at array<long>, at_real array<double>, units string, calendar string, tsl array<float>, rsl array<float>, length_km double, frequency double, polarization string"

    def series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("cml_id", pa.string()), ("sublink_id", pa.string()), ("pos", pa.int64()), ("at", pa.list_(pa.int64())), ("at_real", pa.list_(pa.float64())), ("units", pa.string()), ("calendar", pa.string()), ("tsl", pa.list_(pa.float32())), ("rsl", pa.list_(pa.float32())), ("length_km", pa.float64()), ("frequency", pa.float64()), ("polarization", pa.string())])
        for batch in batches:
            for content in batch.column(0):
                found = opened(content.as_py())
                names = signals(found)
                values = np.broadcast_arrays(*[ordered(found, n) for n in names])
                n_links, n_subs, n_times = values[0].shape
                time = found.variables["time"]
                at = np.ravel(np.ma.filled(time.values))
                whole = at.dtype.kind in "iu"
                given = {n: static(found, n, n_links, n_subs) for n in ("length_km", "length", "frequency", "polarization")}
                length = given["length_km"] if "length_km" in found.variables else given["length"]
                links, subs = axis(found, "cml_id", n_links), axis(found, "sublink_id", n_subs)
                number = lambda x: None if x is None or x != x else float(x)
                for i in range(n_links):
                    for j in range(n_subs):
                        k = i * n_subs + j
                        levels = [pa.array([pa.array(v[i, j].astype(np.float32), from_pandas=True)], pa.list_(pa.float32())) for v in values]
                        p = given["polarization"][k]
                        row = [[links[i]], [subs[j]], [i], [at.astype(np.int64)] if whole else [None], [None] if whole else [at.astype(float)], [time.attributes.get("units")], [time.attributes.get("calendar")], *levels, [number(length[k])], [number(given["frequency"][k])], [None if p is None else str(p)]]
                        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(row, types.types, strict=True)], schema=types)

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(series, schema)
    zipped = rows.select("cml_id", "sublink_id", "units", "calendar", F.inline(F.arrays_zip(F.coalesce(F.col("at").cast("array<decimal(28,9)>"), F.col("at_real").cast("array<decimal(28,9)>")).alias("at"), F.col("tsl").alias("tsl"), F.col("rsl").alias("rsl"))))
    zipped = zipped.toDF("cml_id", "sublink_id", "units", "calendar", "at", "tsl", "rsl")
    samples = zipped.select("cml_id", "sublink_id", cf_time(F.col("at"), F.col("units"), F.col("calendar")).alias("time"), "tsl", "rsl")
    links = rows.groupBy("cml_id").agg(F.min("pos").alias("pos"), F.max("length_km").alias("length_km"))
    return Cube(samples, links, rows.select("cml_id", "sublink_id", "frequency", "polarization"))
