"""Self-describing array files: named variables with dimensions and attributes, and what scenes, grids and links are in them.

The kind of a file is told by its first bytes. NPZ (numpy's zip of arrays, with a JSON header beside them) is read and written; NetCDF is
read and written where the netCDF4 library can be imported.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "__header__"
#: Attributes of a scene's file that describe its projection (fixed names), by field of ``satellite.Grid``.
PROJECTION = {"height": "satellite_height_m", "lon_0": "lon_0_deg", "a": "semi_major_axis_m", "b": "semi_minor_axis_m"}
SWEEP = "sweep_angle_axis"


class Variable(NamedTuple):
    dims: tuple[str, ...]
    values: np.ndarray
    attributes: dict[str, object] = {}


class Arrays(NamedTuple):
    variables: dict[str, Variable]
    attributes: dict[str, object] = {}

    def first(self, names: Sequence[str]) -> Variable:
        """The first of several alternative variables that there is."""
        for n in names:
            if n in self.variables:
                return self.variables[n]
        raise KeyError(f"none of {list(names)} is there")


def _read_npz(content: bytes) -> Arrays:
    with np.load(io.BytesIO(content), allow_pickle=False) as found:
        header = json.loads(str(found[HEADER])) if HEADER in found else {"attributes": {}, "variables": {}}
        variables = {}
        for name in found.files:
            if name != HEADER:
                of = header["variables"].get(name, {})
                values = found[name]
                if "missing" in of:
                    values = np.ma.masked_equal(values, of["missing"])
                variables[name] = Variable(tuple(of.get("dims", (f"d{k}" for k in range(values.ndim)))), values, of.get("attributes", {}))
    return Arrays(variables, header["attributes"])


def _write_npz(arrays: Arrays) -> bytes:
    header: dict = {"attributes": arrays.attributes, "variables": {}}
    values = {}
    for name, v in arrays.variables.items():
        header["variables"][name] = {"dims": list(v.dims), "attributes": v.attributes}
        values[name] = v.values
        if np.ma.isMaskedArray(v.values):
            header["variables"][name]["missing"] = v.values.fill_value.item()
            values[name] = v.values.filled()
    out = io.BytesIO()
    np.savez_compressed(out, **{HEADER: np.array(json.dumps(header))}, **values)
    return out.getvalue()


def _read_netcdf(content: bytes) -> Arrays:
    import netCDF4

    with netCDF4.Dataset("memory", memory=content) as ds:
        variables = {n: Variable(tuple(v.dimensions), v[:], {a: v.getncattr(a) for a in v.ncattrs()}) for n, v in ds.variables.items()}
        return Arrays(variables, {a: ds.getncattr(a) for a in ds.ncattrs()})


def _write_netcdf(arrays: Arrays) -> bytes:
    import netCDF4

    ds = netCDF4.Dataset("memory", "w", memory=1 << 20)
    ds.setncatts(arrays.attributes)
    for name, v in arrays.variables.items():
        for d, n in zip(v.dims, v.values.shape, strict=True):
            if d not in ds.dimensions:
                ds.createDimension(d, n)
        text = v.values.dtype.kind in "UO"
        made = ds.createVariable(name, str if text else v.values.dtype, v.dims)
        made.setncatts(v.attributes)
        made[:] = v.values.astype(object) if text else v.values
    return bytes(ds.close())


#: First bytes, reader, writer by suffix.
KINDS: dict[str, tuple[tuple[bytes, ...], Callable[[bytes], Arrays], Callable[[Arrays], bytes]]] = {".npz": ((b"PK",), _read_npz, _write_npz), ".nc": ((b"CDF", b"\x89HDF"), _read_netcdf, _write_netcdf)}


def opened(content: bytes) -> Arrays:
    for first, read, _ in KINDS.values():
        if content.startswith(first):
            return read(content)
    raise ValueError("neither NPZ nor NetCDF")


def packed(arrays: Arrays, suffix: str) -> bytes:
    if suffix not in KINDS:
        raise ValueError(f"no writer for {suffix}")
    return KINDS[suffix][2](arrays)


def scene_decoder(channels: Sequence[str]) -> Callable[[bytes], tuple[object, dict[str, np.ndarray]]]:
    """A decoder for ``scenes.read``: the file's time (value, units, calendar), and those of the wanted channels that it has."""

    def decode(content: bytes) -> tuple[object, dict[str, np.ndarray]]:
        found = opened(content)
        time = None
        if (t := found.variables.get("time")) is not None and np.size(t.values):
            time = np.ravel(t.values)[0].item(), t.attributes.get("units"), t.attributes.get("calendar")
        return time, {c: found.variables[c].values for c in channels if c in found.variables}

    return decode


def grid_of(found: Arrays) -> dict[str, object]:
    """Fields of ``satellite.Grid`` from a scene's file. A missing axis or attribute is an error."""
    axes = {n: tuple(float(v) for v in np.ravel(found.first([n]).values)) for n in ("x", "y")}
    if missing := [a for a in PROJECTION.values() if a not in found.attributes]:
        raise KeyError(f"the scene has no {', '.join(missing)}")
    return axes | {k: float(found.attributes[a]) for k, a in PROJECTION.items()} | {"sweep": str(found.attributes.get(SWEEP, "y"))}


def content_of(spark: SparkSession, path: str) -> bytes:
    """A file's bytes, read by Spark."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def geometry_of(spark: SparkSession, found: Arrays) -> DataFrame:
    """pos, the sites' coordinates and, if the file has it, cml_id of the links in a file. Links are few."""
    names = ["site_a_longitude", "site_a_latitude", "site_b_longitude", "site_b_latitude"]
    columns = {n: np.ma.filled(np.ma.asarray(np.ravel(found.first([n]).values), dtype=float), np.nan) for n in names}
    if "cml_id" in found.variables:
        ids = np.ravel(found.variables["cml_id"].values)
        columns["cml_id"] = ids.astype(np.int64) if ids.dtype.kind in "iu" else ids.astype(str)
    return spark.createDataFrame(pd.DataFrame({"pos": np.arange(len(columns[names[0]]))} | columns))


def _cube(rows: pd.DataFrame, channels: Sequence[str], name: str) -> Arrays:
    """The means of one scene as a cube of time, channel and link."""
    ids = np.sort(rows["cml_id"].unique())
    values = np.full((1, len(channels), len(ids)), np.nan, np.float32)
    values[0, rows["channel"].map({c: k for k, c in enumerate(channels)}), np.searchsorted(ids, rows["cml_id"])] = rows["path_mean"]
    ns = np.array([pd.Timestamp(rows["scene_time"].iloc[0]).value])
    ids = ids if ids.dtype.kind in "iu" else ids.astype(str)
    variables = {
        "seviri_time": Variable(("seviri_time",), ns, {"units": "nanoseconds since 1970-01-01 00:00:00 UTC"}), "seviri_channel": Variable(("seviri_channel",), np.array(channels, str)),
        "cml_id": Variable(("cml_id",), ids), name: Variable(("seviri_time", "seviri_channel", "cml_id"), values, {"units": "K"}),
    }
    return Arrays(variables)


def save_cubes(means: DataFrame, folder: str, channels: Sequence[str], suffix: str = ".npz", name: str = "seviri_path_mean") -> DataFrame:
    """Writes the means (scene_time, channel, cml_id, path_mean) as an array file for each scene; path and scene_time of the files, as rows of one job.

    folder is a place that pyarrow's file systems reach from every executor (a shared mount, or a URI). A file appears under its name
    when it is whole; a task that runs again replaces it.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        time = pd.Timestamp(rows["scene_time"].iloc[0])
        path = f"{at}/means_{time:%Y%m%d_%H%M%S}{suffix}"
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{path}.part") as f:
            f.write(packed(_cube(rows, channels, name), suffix))
        store.move(f"{path}.part", path)
        return pd.DataFrame({"path": [path], "scene_time": [time]})

    rows = means.select("scene_time", F.col("channel").cast("string").alias("channel"), "cml_id", "path_mean")
    return rows.groupBy("scene_time").applyInPandas(one, "path string, scene_time timestamp")


def read_cubes(spark: SparkSession, folder: str, name: str = "seviri_path_mean", pattern: str = "*.*") -> DataFrame:
    """scene_time, channel, cml_id (as text), path_mean of the files of ``save_cubes``; one file a task."""

    def melt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                found = opened(bytes(content))
                cube, time, channel, ids = (found.variables[n].values for n in (name, "seviri_time", "seviri_channel", "cml_id"))
                t, c, i = (x.ravel() for x in np.meshgrid(time, channel.astype(str), ids.astype(str), indexing="ij"))
                yield pd.DataFrame({"ns": t, "channel": c, "cml_id": i, "path_mean": np.ravel(cube)})

    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("content").mapInPandas(melt, "ns long, channel string, cml_id string, path_mean float")
    value = F.col("path_mean")
    return rows.select(F.timestamp_micros(F.floor(F.col("ns") / 1000).cast("long")).alias("scene_time"), "channel", "cml_id", F.when(~F.isnan(value), value).alias("path_mean"))
