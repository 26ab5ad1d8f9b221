import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopgauge.operators import geo
from hopgauge.sources import scenes, sinks
from hopgauge.streaming.scenes import stream_path_means


def arr(values):
    return F.array(*[F.lit(float(v)) for v in values])


def links(spark, rows):
    return spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "cml_id long, x0 double, y0 double, x1 double, y1 double")


def test_edges(spark):
    assert spark.range(1).select(geo.cell_edges(arr([0, 1, 3]))).first()[0] == [-0.5, 0.5, 2, 4]
    assert spark.range(1).select(geo.cell_edges(arr([0]))).first()[0] is None


@pytest.mark.parametrize(
    "row, want",
    [((0.5, 0.5, 1.5, 0.5), {0: 0.5, 1: 0.5}), ((-1, 0.5, 1.5, 0.5), {0: 2 / 3, 1: 1 / 3}), ((0.5, 0.5, 0.5, 0.5), {}), ((3, 3, 4, 4), {}), ((float("nan"), 0, 1, 1), {}), ((float("inf"), 0, 1, 1), {})],
)
def test_path_weights(spark, row, want):
    one = links(spark, [row])
    paths = geo.paths(one, [0, 1, 2], [0, 1])
    assert {r.pix: pytest.approx(r.wt, rel=1e-6) for r in geo.path_weights(paths).collect()} == want
    cover = geo.link_coverage(paths).first()
    assert (cover.n_pixels, cover.intersects) == (len(want), int(bool(want)))


def test_weights_sum_to_one_and_do_not_depend_on_direction_or_axis_order(spark):
    rng = np.random.default_rng(2)
    rows = rng.uniform(-2, 10, (60, 4))
    there = geo.path_weights(geo.paths(links(spark, rows), range(9), range(9))).toPandas()
    back = geo.path_weights(geo.paths(links(spark, rows[:, [2, 3, 0, 1]]), range(9), range(9))).toPandas()
    flipped = geo.path_weights(geo.paths(links(spark, rows), range(8, -1, -1), range(9))).toPandas()
    flipped["pix"] = flipped.pix // 8 * 8 + 7 - flipped.pix % 8
    assert there.groupby("cml_id").wt.sum().sub(1).abs().max() < 1e-5
    want = there[there.wt > 1e-6].set_index(["cml_id", "pix"]).wt
    for other in (back, flipped):
        assert want.sub(other.set_index(["cml_id", "pix"]).wt).abs().max() < 1e-5


def test_weights_equal_dense_sampling(spark):
    rng = np.random.default_rng(3)
    rows = rng.uniform(-1, 9, (20, 4))
    got = geo.path_weights(geo.paths(links(spark, rows), range(9), range(9))).toPandas()
    t = (np.arange(200_000) + 0.5) / 200_000
    for k, (x0, y0, x1, y1) in enumerate(rows):
        x, y = x0 + t * (x1 - x0), y0 + t * (y1 - y0)
        inside = (x >= 0) & (x < 8) & (y >= 0) & (y < 8)
        share = np.bincount((np.floor(y[inside]) * 8 + np.floor(x[inside])).astype(int), minlength=64) / max(inside.sum(), 1)
        mine = np.zeros(64)
        part = got[got.cml_id == k]
        mine[part.pix] = part.wt
        assert np.abs(mine - share).max() < 1e-3


def test_path_mean_leaves_out_missing_pixels(spark):
    pixels = spark.createDataFrame([(1, 1, 0, None), (1, 1, 1, 10.0), (2, 1, 0, float("nan")), (2, 1, 1, None)], "scene_time int, channel int, pix long, value float")
    paths = spark.createDataFrame([(7, [0, 1], [2 / 3, 1 / 3], 2), (8, [], [], 0)], "cml_id long, pix array<long>, wt array<float>, n_pixels int")
    means = geo.path_means(pixels, geo.path_weights(paths))
    assert [(r.scene_time, r.path_mean) for r in means.collect()] == [(1, 10.0)]
    # no raster, one without a finite pixel, one that is too small
    rasters = spark.createDataFrame([(1, 1, [None, 10.0]), (2, 1, [float("nan"), None]), (3, 1, None), (4, 1, [5.0])], "scene_time int, channel int, values array<float>")
    every = geo.gather_means(rasters, paths)
    assert {(r.scene_time, r.cml_id, r.path_mean) for r in every.collect()} == {(s, c, 10.0 if (s, c) == (1, 7) else None) for s in (1, 2, 3, 4) for c in (7, 8)}
    assert geo.gather_means(rasters, paths.limit(0)).count() == 0 and geo.gather_means(rasters.limit(0), paths).count() == 0


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_gathered_means_do_not_turn_pixels_into_rows_or_keys(spark, monkeypatch, limit):
    """Three blocks of links; broadcast below the limit, dealt by block and scene beyond. Equal to the join on pixels, to the last bit."""
    monkeypatch.setattr(geo, "BROADCAST", limit)
    rng = np.random.default_rng(6)
    rasters = spark.createDataFrame([(k, c, [None if rng.random() < 0.2 else float(v) for v in rng.normal(size=64)]) for k in range(5) for c in ("a", "b")], "scene_time int, channel string, values array<float>")
    links_ = links(spark, rng.uniform(-1, 9, (1300, 4))).withColumn("cml_id", F.concat(F.lit("link"), "cml_id"))
    paths = geo.paths(links_, range(9), range(9))
    out = geo.gather_means(rasters, paths)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "pix" not in plan.split("Join")[1].split("\n")[0] and ("salt" in plan) == (limit == 0)
    got = {(r.scene_time, r.channel, r.cml_id): r.path_mean for r in out.collect()}
    assert len(got) == 10 * 1300
    want = {(r.scene_time, r.channel, r.cml_id): r.path_mean for r in geo.path_means(scenes.pixels(rasters), geo.path_weights(paths)).collect()}
    assert {k for k, v in got.items() if v is not None} == want.keys()
    assert all(math.isclose(got[k], v, rel_tol=1e-5, abs_tol=1e-6) for k, v in want.items())


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_small_rasters_are_dealt_to_all_partitions(spark, monkeypatch, limit):
    """A few kilobytes of rasters make many means: adaptive execution must not join them in one task. Stacks of three; one raster has no data, one too few pixels, one too many."""
    monkeypatch.setattr(geo, "BROADCAST", limit)
    monkeypatch.setattr(geo, "STACK", 3)
    rng = np.random.default_rng(8)
    data = [(k, "c", [None if rng.random() < 0.2 else float(np.float32(v)) for v in rng.normal(size=64)]) for k in range(40)]
    data += [(40, "c", None), (41, "c", [1.0] * 7), (42, None, [2.0] * 90)]
    rasters = spark.createDataFrame(data, "scene_time int, channel string, values array<float>").coalesce(1)
    rows = rng.uniform(-1, 9, (1300, 4))
    paths = geo.paths(links(spark, rows), range(9), range(9))
    out = geo.gather_means(rasters, paths)
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    got = {(r.scene_time, r.cml_id): r.path_mean for r in out.collect()}
    assert len(got) == 43 * 1300 and {r.channel for r in out.where("scene_time = 42").collect()} == {None}
    weights = {r.cml_id: (r.pix, r.wt) for r in paths.collect()}
    for (scene, link), mean in got.items():
        values, total, share = data[scene][2] or [], 0.0, 0.0
        for p, w in zip(*weights[link], strict=True):
            if len(values) >= 64 and values[p] is not None:
                total, share = total + values[p] * w, share + w
        assert mean == (float(np.float32(total / share)) if share else None)


def test_walk_passes_every_cell_once_and_in_order():
    rng = np.random.default_rng(9)
    xs, ys = np.cumsum(rng.uniform(0.1, 2, 30)), np.cumsum(rng.uniform(0.1, 2, 20))[::-1]
    ends = np.r_[rng.uniform(-3, 40, (300, 4)), [[xs[2], ys[3], xs[9], ys[3]], [xs[4], ys[0], xs[4], ys[-1]], [np.nan, 1, 2, 3], [5, 5, 5, 5], [xs[0], ys[0], xs[-1], ys[-1]]]]
    link, row, col, weight = geo.walk(ends, xs, ys)
    assert (np.diff(link) >= 0).all() and (weight > 0).all() and set(link) & {302, 303} == set()
    for k in range(300):
        here = link == k
        cells = list(zip(row[here], col[here], strict=True))
        # slivers aside, neighbours differ by one step and no cell is passed twice
        large = [c for c, w in zip(cells, weight[here], strict=True) if w > 1e-9]
        assert len(set(large)) == len(large) and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(large, large[1:], strict=False))
    t = (np.arange(100_000) + 0.5) / 100_000
    for k in range(0, 300, 17):
        x, y = ends[k, 0] + t * (ends[k, 2] - ends[k, 0]), ends[k, 1] + t * (ends[k, 3] - ends[k, 1])
        inside = (x >= xs[0]) & (x < xs[-1]) & (y >= ys[-1]) & (y < ys[0])
        assert abs(weight[link == k].sum() - inside.mean()) < 1e-4
    assert len(geo.walk(np.zeros((0, 4)), xs, ys)[0]) == 0


def test_constant_raster_gives_its_value(spark):
    weights = geo.path_weights(geo.paths(links(spark, np.random.default_rng(4).uniform(0, 8, (9, 4))), range(9), range(9)))
    raster = spark.createDataFrame([(1, 2, [4.5] * 64)], "scene_time int, channel int, values array<float>")
    assert {round(r.path_mean, 5) for r in geo.path_means(scenes.pixels(raster), weights).collect()} == {4.5}


@pytest.mark.parametrize("lon, lat, want", [(8, 35, (0.01967997, 0.09802330)), (0, 0, (0, 0)), (120, 0, None)])
def test_projection(spark, lon, lat, want):
    h = 35785831.0
    row = spark.range(1).select(*geo.geostationary(F.lit(float(lon)), F.lit(float(lat)), h, 0.0, 6378169.0, 6356583.8)).first()
    assert (row[0] is None and row[1] is None) if want is None else [row[0] / h, row[1] / h] == pytest.approx(want, abs=1e-8)
    assert spark.range(1).select(geo.to_grid_units(F.lit(h), h, 0.1)).first()[0] == 1
    assert spark.range(1).select(geo.to_grid_units(F.lit(h), h, 1e6)).first()[0] == h


def test_catalogue(spark):
    names = ["/a/SEVIRI_20210101_001500.nc", "/a/SEVIRI_20210101_000000.nc", "/a/SEVIRI_2021.nc", "/a/SEVIRI_20211301_000000.nc", "/a/SEVIRI_20210102_000000.nc"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    got = scenes.catalogue(files, "2021-01-01 00:00:00", "2021-01-01 00:15:00").collect()
    assert [(r.path, r.scene_time) for r in got] == [(names[1], dt.datetime(2021, 1, 1)), (names[0], dt.datetime(2021, 1, 1, 0, 15))]
    content = F.when(F.col("path").endswith("2021.nc"), F.lit("2021-01-01 00:10:00").cast("timestamp"))
    assert scenes.catalogue(files, "2021-01-01 00:00:00", "2021-01-01 00:15:00", content).count() == 3


def test_outcomes(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", None)], "path string, error string")
    assert tuple(scenes.outcome_counts(df).first()) == (3, 1, 2, "a: y; b: x")


def test_sinks(spark, tmp_path):
    assert sinks.output_path("/d/x.nc") == "/d/x_QC.nc" and sinks.output_path("/d/x.nc", "/e.nc") == "/e.nc"
    df = spark.createDataFrame([(dt.datetime(2021, 1, 1), 1, 2, 3.0)], "scene_time timestamp, channel int, cml_id long, path_mean float")
    sinks.save_means(df, str(tmp_path / "m"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.save_means(df, str(tmp_path / "m"))
    sinks.save_means(df, str(tmp_path / "m"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1
    key = lambda rows: sinks.weights_key(links(spark, rows), ([0.0, 1.0], [0.0, 1.0]))
    assert key([(0, 0, 1, 1)]) == key([(0, 0, 1, 1)]) != key([(0, 0, 1, 2)])


def test_stream_equals_batch(spark, tmp_path):
    geometry, pixels = scenes.demo(spark, scenes=3, ny=8, nx=8, links=5, channels=2)
    assert geometry.count() == 5 and pixels.count() == 3 * 2 * 64
    weights = geo.path_weights(geo.paths(links(spark, np.random.default_rng(4).uniform(0, 8, (5, 4))), range(9), range(9)))
    pixels.write.parquet(str(tmp_path / "in"))
    pixels = spark.read.parquet(str(tmp_path / "in"))
    # each file holds whole scenes
    pixels.repartition(3, "scene_time").write.parquet(str(tmp_path / "scenes"))
    stream_path_means(spark, str(tmp_path / "scenes"), pixels.schema, weights, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(r.scene_time, r.channel, r.cml_id): r.path_mean for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.scene_time, r.channel, r.cml_id): r.path_mean for r in geo.path_means(pixels, weights).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-6) for k in want)
