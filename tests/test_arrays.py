import datetime as dt
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopgauge.jobs import cli, fixtures, satellite
from hopgauge.operators import geo
from hopgauge.sources import arrays, scenes, sinks
from hopgauge.sources.arrays import Arrays, Variable

G = fixtures.GRID
ATTRIBUTES = {"satellite_height_m": G["height"], "lon_0_deg": G["lon_0"], "semi_major_axis_m": G["a"], "semi_minor_axis_m": G["b"]}
CHANNELS = ["IR", "WV"]


def scene(value, time=None, units=None):
    dims, shape = ("time", "y", "x"), (1, 80, 100)
    masked = np.ma.masked_array(np.full(shape, value, np.float32), fill_value=np.float32(-9))
    masked[0, ::7] = np.ma.masked
    variables = {"x": Variable(("x",), np.array(G["x"])), "y": Variable(("y",), np.array(G["y"])), "IR": Variable(dims, masked, {"units": "K"}), "WV": Variable(dims, np.full(shape, value + 1, np.float32))}
    if time is not None:
        variables["time"] = Variable(("time",), np.array([time]), {"units": units} if units else {})
    return arrays.packed(Arrays(variables, ATTRIBUTES), ".npz")


def links():
    rng = np.random.default_rng(1)
    lon, lat = rng.uniform(-8, 8, (2, 12)), rng.uniform(5, 35, (2, 12))
    names = ("site_a_longitude", "site_a_latitude", "site_b_longitude", "site_b_latitude")
    return Arrays({n: Variable(("link",), v) for n, v in zip(names, (lon[0], lat[0], lon[1], lat[1]), strict=True)} | {"cml_id": Variable(("link",), np.array([f"L{k}" for k in range(12)]))})


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "scenes"
    at.mkdir()
    for k in range(12):  # three days
        time = dt.datetime(2021, 1, 1) + dt.timedelta(hours=6 * k)
        (at / f"SEVIRI_{time:%Y%m%d_%H%M%S}.nc").write_bytes(scene(200 + k))
    (at / "SEVIRI_20210101_030000.nc").write_bytes(b"broken")
    (at / "SEVIRI_20220101_000000.nc").write_bytes(scene(1))
    (at / "SEVIRI_late.nc").write_bytes(scene(300, 36, "hours since 2021-01-01"))
    (at / "SEVIRI_raw.nc").write_bytes(scene(301, 1609470000 * 10**9))
    (at / "SEVIRI_other.nc").write_bytes(scene(302, 1, "days since 2030-01-01"))
    (at / "SEVIRI_none.nc").write_bytes(scene(303))
    (tmp_path / "links.npz").write_bytes(arrays.packed(links(), ".npz"))
    return at


def test_npz_keeps_dimensions_attributes_and_masks():
    found = arrays.opened(scene(5.0, 3, "hours since 2021-01-01"))
    assert found.attributes == ATTRIBUTES and found.variables["IR"].dims == ("time", "y", "x") and found.variables["IR"].attributes == {"units": "K"}
    assert found.variables["IR"].values.mask.sum() == 12 * 100 and not np.ma.isMaskedArray(found.variables["WV"].values)
    assert arrays.grid_of(found)["x"] == tuple(G["x"]) and arrays.grid_of(found)["sweep"] == "y"
    plain = io.BytesIO()
    np.savez(plain, a=np.zeros((2, 3)))
    assert arrays.opened(plain.getvalue()).variables["a"].dims == ("d0", "d1")  # no header
    with pytest.raises(KeyError, match="satellite_height_m"):
        arrays.grid_of(Arrays(found.variables, {}))
    with pytest.raises(ValueError):
        arrays.opened(b"something")
    with pytest.raises(ValueError):
        arrays.packed(found, ".zarr")


def counting(log):
    inner = arrays.scene_decoder(CHANNELS)

    def decode(content):
        (log / f"{np.random.default_rng().integers(1 << 60)}").write_text("broken" if len(content) < 10 else str(np.ravel(arrays.opened(content).variables["WV"].values)[0]))
        return inner(content)

    return decode


def args(spark, tmp_path):
    return arrays.geometry_of(spark, links()), satellite.Grid(**G), CHANNELS, str(tmp_path / "weights")


def means_of(done):
    return {(r.scene_time, r.channel, r.cml_id): r.path_mean for r in done.means.collect()}


def test_files_out_of_range_are_never_opened_and_each_other_once(spark, folder, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    done = satellite.extract_to(spark, str(folder), "2021-01-01 06:00:00", "2021-01-02 12:00:00", counting(log), *args(spark, tmp_path), str(tmp_path / "out"))
    # 6 by name, and the four files whose names tell no time
    assert sorted(f.read_text() for f in log.iterdir()) == sorted(f"{float(v)}" for v in (202, 203, 204, 205, 206, 207, 301, 302, 303, 304))
    got = means_of(done)
    assert {k[0] for k in got} == {dt.datetime(2021, 1, 1, 6) + dt.timedelta(hours=6 * k) for k in range(6)}
    assert {round(v, 3) for (t, c, _), v in got.items() if v is not None and c == "IR" and t == dt.datetime(2021, 1, 1, 6)} == {201.0}
    assert scenes.outcome_counts(done.outcomes).first().n_scenes == 7  # two scenes at noon


def test_a_stopped_run_is_taken_up_again(spark, folder, tmp_path, monkeypatch):
    log = tmp_path / "log"
    log.mkdir()
    span = "2021-01-01 00:00:00", "2021-01-03 23:00:00"
    whole = satellite.extract_to(spark, str(folder), *span, arrays.scene_decoder(CHANNELS), *args(spark, tmp_path), str(tmp_path / "whole"), 3)
    real, saved = sinks.save, []

    def failing(df, path, *rest, **more):
        if "flush=" in path:
            saved.append(path)
            if len(saved) == 6:  # the third flush has means but no outcomes
                raise RuntimeError("stopped")
        return real(df, path, *rest, **more)

    monkeypatch.setattr(sinks, "save", failing)
    with pytest.raises(RuntimeError):
        satellite.extract_to(spark, str(folder), *span, counting(log), *args(spark, tmp_path), str(tmp_path / "out"), 3)
    first = len(list(log.iterdir()))
    half = satellite.extraction(spark, str(tmp_path / "out"))
    assert 0 < half.outcomes.count() < whole.outcomes.count()
    monkeypatch.setattr(sinks, "save", real)
    again = satellite.extract_to(spark, str(folder), *span, counting(log), *args(spark, tmp_path), str(tmp_path / "out"), 3)
    assert means_of(again) == means_of(whole) and len(again.means.collect()) == len(whole.means.collect())
    by = lambda e: {(r.path, (r.error or "").split(":")[0]) for r in e.outcomes.collect()}
    assert by(again) == by(whole) and len(by(whole)) == 15 and sum(bool(e) for _, e in by(whole)) == 1
    total = len(list(log.iterdir()))
    assert total - first == 17 - 4  # the two finished flushes, of four files, are not decoded again
    before = total
    satellite.extract_to(spark, str(folder), *span, counting(log), *args(spark, tmp_path), str(tmp_path / "out"), 3)
    assert len(list(log.iterdir())) == before  # all is finished
    # a wider range takes in what was out of range
    wider = satellite.extract_to(spark, str(folder), "2021-01-01 00:00:00", "2031-01-01 00:00:00", counting(log), *args(spark, tmp_path), str(tmp_path / "out"), 3)
    assert wider.outcomes.count() == 17 and len(list(log.iterdir())) == before + 2


def test_flushes_are_cut_at_dates():
    day = [dt.date(2021, 1, d) for d in (1, 1, 1, 2, 2, 3)]
    files = [scenes.File("u", None), scenes.File("v", None), scenes.File("w", None)] + [scenes.File(f"p{k}", d) for k, d in enumerate(day)]
    assert satellite.in_flushes(files, 2) == [["u", "v"], ["w"], ["p0", "p1", "p2"], ["p3", "p4"], ["p5"]]
    assert satellite.in_flushes(files, 4) == [["u", "v", "w"], ["p0", "p1", "p2", "p3", "p4"], ["p5"]]
    assert satellite.in_flushes([], 4) == []


def test_command_line_takes_grid_and_links_from_files(spark, folder, tmp_path):
    at = lambda name: str(tmp_path / name)
    run = ["extract", "--files", str(folder), "--geometry", at("links.npz"), "--channels", "IR,absent", "--weights-folder", at("w"), "--start", "2021-01-01", "--end", "2021-01-02", "--out", at("out")]
    cli.main(run)
    done = satellite.extraction(spark, at("out"))
    means = done.means.collect()
    assert {r.channel for r in means if r.path_mean is not None} == {"IR"} and {r.channel for r in means} == {"IR", "absent"}
    info = json.loads(spark.read.text(at("out/info")).first().value)
    assert info["n_scenes"] == 7 and info["n_failed"] == 1 and info["scenes_per_second"] > 0
    cli.main(run)  # nothing is left to do
    assert satellite.extraction(spark, at("out")).means.count() == len(means)
    with pytest.raises(FileNotFoundError):
        cli.main([*run[:-1], at("none"), "--start", "2031-01-01", "--end", "2031-02-01"])
    with pytest.raises(SystemExit):
        cli.main(["extract", "--scenes", "x", *run[3:]])


def test_cubes_round_trip(spark, tmp_path):
    paths = satellite.build_paths(arrays.geometry_of(spark, links()), satellite.Grid(**G))
    rasters = spark.createDataFrame([(dt.datetime(2021, 1, d), c, [float(d)] * 8000) for d in (1, 2) for c in CHANNELS], "scene_time timestamp, channel string, values array<float>")
    means = geo.gather_means(rasters, paths)
    files = arrays.save_cubes(means, str(tmp_path / "cubes"), CHANNELS).collect()
    assert sorted(f.path.rsplit("/", 1)[-1] for f in files) == ["means_20210101_000000.npz", "means_20210102_000000.npz"]
    found = arrays.opened((tmp_path / "cubes" / "means_20210101_000000.npz").read_bytes())
    assert found.variables["seviri_path_mean"].dims == ("seviri_time", "seviri_channel", "cml_id") and found.variables["seviri_path_mean"].attributes == {"units": "K"}
    key = lambda df: sorted(((r.scene_time, r.channel, r.cml_id, r.path_mean) for r in df.collect()), key=str)
    assert key(arrays.read_cubes(spark, str(tmp_path / "cubes"))) == key(means)
    assert arrays.save_cubes(means.where(F.lit(False)), str(tmp_path / "none"), CHANNELS).count() == 0
