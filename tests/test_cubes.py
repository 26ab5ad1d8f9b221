import datetime as dt
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopgauge.jobs import cli
from hopgauge.operators import quality
from hopgauge.sources import arrays, cubes
from hopgauge.sources.arrays import Arrays, Variable

N = {"cml_id": 3, "sublink_id": 2, "time": 50}
RNG = np.random.default_rng(1)
LEVELS = {"tsl": RNG.integers(18, 22, (3, 2, 50)).astype(float), "rsl": np.where(RNG.random((3, 2, 50)) < 0.2, np.nan, RNG.normal(-60, 4, (3, 2, 50)))}


def cube(order, names=("tsl", "rsl"), **more):
    put = lambda v: Variable(order, np.ascontiguousarray(np.transpose(v, [cubes.DIMS.index(d) for d in order])))
    variables = {n: put(LEVELS[m]) for n, m in zip(names, ("tsl", "rsl"), strict=True)}
    variables |= {"time": Variable(("time",), np.arange(50) * 60, {"units": "seconds since 2021-01-01"}), "cml_id": Variable(("cml_id",), np.array([5, 6, 7])), "sublink_id": Variable(("sublink_id",), np.array(["a", "b"]))}
    variables |= {"length": Variable(("cml_id",), np.array([1.0, 2.0, np.nan])), "frequency": Variable(("sublink_id", "cml_id"), np.array([[18e9, 23e9, 38e9]] * 2)), "polarization": Variable(("cml_id", "sublink_id"), np.array([["H", "V"]] * 3))}
    return arrays.packed(Arrays(variables | more), ".npz")


def long_form():
    return {(str(5 + i), "ab"[j], dt.datetime(2021, 1, 1, 0, k)): (float(np.float32(LEVELS["tsl"][i, j, k])), None if np.isnan(LEVELS["rsl"][i, j, k]) else float(np.float32(LEVELS["rsl"][i, j, k]))) for i in range(3) for j in range(2) for k in range(50)}


@pytest.mark.parametrize("order", list(itertools.permutations(cubes.DIMS)))
def test_all_orders_of_dimensions_give_the_long_form(spark, tmp_path, order):
    (tmp_path / "c.npz").write_bytes(cube(order, ("tx", "rx") if order[0] == "time" else ("tsl", "rsl")))
    got = cubes.read(spark, str(tmp_path / "c.npz"))
    rows = got.samples.collect()
    assert len(rows) == 300 and {(r.cml_id, r.sublink_id, r.time): (r.tsl, r.rsl) for r in rows} == long_form()
    if order == cubes.DIMS:
        assert {(r.cml_id, r.pos): r.length_km for r in got.links.collect()} == {("5", 0): 1.0, ("6", 1): 2.0, ("7", 2): None}
        assert {(r.cml_id, r.sublink_id): (r.frequency, r.polarization) for r in got.sublinks.collect()} == {(c, s): (f, p) for c, f in (("5", 18e9), ("6", 23e9), ("7", 38e9)) for s, p in (("a", "H"), ("b", "V"))}


def test_odd_cubes(spark, tmp_path):
    (tmp_path / "c.npz").write_bytes(cube(cubes.DIMS, time=Variable(("time",), 1609459200 * 10**9 + np.arange(50) * 10**9), rsl=Variable(("time", "cml_id"), np.zeros((50, 3)))))
    got = cubes.read(spark, str(tmp_path / "c.npz")).samples
    assert got.agg(F.max("time"), F.sum("rsl")).first()[:] == (dt.datetime(2021, 1, 1, 0, 0, 49), 0.0) and got.count() == 300  # one level for both sublinks
    bad = arrays.opened(cube(cubes.DIMS))
    with pytest.raises(ValueError, match="height"):
        cubes.ordered(Arrays({"rsl": Variable(("time", "height"), np.zeros((2, 2)))}), "rsl")
    with pytest.raises(KeyError):
        cubes.signals(Arrays({"tsl": bad.variables["tsl"]}))


def test_command_line_takes_a_cube(spark, tmp_path):
    (tmp_path / "c.npz").write_bytes(cube(("time", "sublink_id", "cml_id")))
    cli.main(["qc", "--samples", str(tmp_path / "c.npz"), "--out", str(tmp_path / "out"), "--block-rows", "20", "--regression", "--time-save-apart"])
    found = cubes.read(spark, str(tmp_path / "c.npz"))
    want = quality.run(found.samples, found.links.select("cml_id", "length_km"), found.sublinks)
    assert {r.cml_id: r.isSane for r in spark.read.parquet(str(tmp_path / "out/links")).collect()}.keys() == {r.cml_id for r in want.links.collect()}
    info = json.loads(spark.read.text(str(tmp_path / "out/info")).first().value)
    assert 0 < info["qc_elapsed_seconds_excluding_save"] < info["qc_elapsed_seconds"]
    assert spark.read.parquet(str(tmp_path / "out/samples")).count() == 300
    with pytest.raises(SystemExit):
        cli.main(["qc", "--samples", "table", "--out", "x"])
