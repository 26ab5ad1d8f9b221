"""Blocks with halos against whole series, and the regression against published values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopgauge.functions.columns import SERIES
from hopgauge.jobs import registry
from hopgauge.operators import blocks, quality, rain


def samples(spark, seed, n=900):
    """Two series with runs of missing samples of all lengths, steady low stretches, irregular times and infinities."""
    rng, rows = np.random.default_rng(seed), []
    for sublink in ("a", "b"):
        x, k = [], 0
        while len(x) < n:
            kind = rng.random()
            if kind < 0.3:
                x += [None] * int(rng.choice([1, 3, 5, 6, 20, 59, 60, 61, 62, 150]))
            elif kind < 0.4:
                x += [-90.0] * int(rng.integers(1, 9))
            else:
                x += [float(np.float32(v)) for v in rng.normal(rng.choice([-50, -64, -70]), rng.choice([0.1, 3]), int(rng.integers(1, 80)))]
        for v in x[:n]:
            k += int(rng.integers(1, 4)) * 60
            rows.append((1, sublink, k, float(np.float32(20 + rng.integers(3))) if rng.random() > 0.02 else None, math.inf if rng.random() < 0.003 else v))
    return spark.createDataFrame(rows, "cml_id long, sublink_id string, s long, tsl float, rsl float").withColumn("time", F.timestamp_seconds("s")).drop("s").repartition(3)


def key(df, *names):
    return sorted((tuple(r) for r in df.select(*SERIES, "time", *names).collect()), key=str)


@pytest.mark.parametrize("seed, proc_line, rows", [(1, "full", 37), (2, "full", 400), (3, "graf_2020", 100), (4, "no_filter", 64)])
def test_blocks_equal_whole_series(spark, seed, proc_line, rows):
    c = quality.Config(proc_line)
    df = samples(spark, seed).cache()
    names = ("isSane_plateaus_rsl", "flag_blackout_fill", "tsl", "rsl", "trsl")
    processed = blocks.process_blocks(df, c, rows)
    got, want = key(blocks.whole_series(processed), *names), key(quality.process_samples(df, c), *names)
    assert len(got) == len(want) == 1800
    for g, w in zip(got, want, strict=True):
        assert g[:7] == w[:7] and (g[7] == w[7] or math.isclose(g[7], w[7], rel_tol=1e-5))
    windows = {"long": (300, 2.0), "short": (60, 0.8)}
    counts = lambda d: sorted(tuple(r[c] for c in sorted(d.columns)) for r in d.collect())
    assert counts(blocks.block_counts(processed, "trsl", windows)) == counts(quality.rolling_counts(quality.process_samples(df, c), "trsl", windows))
    assert any(w[4] for w in want) == (proc_line == "full")


def test_strict_needs_a_halo(spark):
    c = quality.Config(strict=True)
    df = samples(spark, 5, 500).cache()
    with pytest.raises(ValueError):
        blocks.process_blocks(df, c)
    names = ("isSane_plateaus_rsl", "flag_blackout_fill", "tsl", "rsl", "trsl")
    got, want = key(blocks.whole_series(blocks.process_blocks(df, c, 80, 300)), *names), key(quality.process_samples(df, c), *names)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(g[7] == w[7] or math.isclose(g[7], w[7], rel_tol=1e-5) for g, w in zip(got, want, strict=True))


def test_no_task_has_a_whole_series_and_samples_are_exchanged_once(spark):
    df = samples(spark, 6).withColumn("idx", (F.row_number().over(blocks.Window.partitionBy(*SERIES).orderBy("time")) - 1).cast("long"))
    df.write.format("noop").mode("overwrite").save()
    numbered = spark.createDataFrame(df.collect(), df.schema)
    dealt = blocks.in_blocks(numbered, 50, 20)
    sizes = dealt.groupBy(*SERIES).count().agg(F.max("count")).first()[0]
    assert sizes <= 50 + 2 * 20 and dealt.where("own").count() == 1800
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = blocks.process_blocks(numbered, quality.Config("graf_2020"), 50)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Exchange hashpartitioning") == 1


def test_no_table_that_grows_is_broadcast_and_both_passes_read_one_exchange(spark):
    """Spark takes the days and samples made from one row for few; as many rows as days of all series went to every executor, and all slots were made in one task."""
    small = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "256k"}  # less than the events' bins at sf0.1
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        plan = registry.QUERIES["win_blocks"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in small:
            spark.conf.unset(k)
    assert "Broadcast" not in plan and "ReusedExchange" in plan
    assert "REPARTITION_BY_NUM" in plan  # the links, before they become slots


def test_series_without_a_name_are_kept(spark):
    c = quality.Config()
    df = samples(spark, 8, 300).withColumns({"cml_id": F.when(F.col("sublink_id") == "a", F.col("cml_id")), "sublink_id": F.when(F.col("sublink_id") == "a", F.col("sublink_id"))}).cache()
    names = ("isSane_plateaus_rsl", "flag_blackout_fill", "tsl", "rsl", "trsl")
    got, want = key(blocks.whole_series(blocks.process_blocks(df, c, 37)), *names), key(quality.process_samples(df, c), *names)
    assert len(got) == len(want) == 600 and any(w[4] for w in want)
    assert all(g[:7] == w[:7] and (g[7] == w[7] or math.isclose(g[7], w[7], rel_tol=1e-5)) for g, w in zip(got, want, strict=True))


def test_numbers_and_cases(spark):
    df = samples(spark, 7).drop("idx")
    got = {(r.sublink_id, r.idx): r.time for r in blocks.numbered(df, 3600).collect()}
    for s in ("a", "b"):
        times = [got[s, k] for k in range(900)]
        assert times == sorted(times)
    empty = df.where("false")
    assert blocks.process_blocks(empty).count() == 0
    odd = spark.createDataFrame([(1, "a", None, 20.0, -50.0), (1, "a", None, 20.0, None)], "cml_id long, sublink_id string, time timestamp, tsl float, rsl float")
    assert blocks.whole_series(blocks.process_blocks(odd)).count() == 2


#: Published values of k and a by frequency and polarization.
KNOWN = [(1.0, "H", 0.0000259, 0.9691), (1.0, "V", 0.0000308, 0.8592), (10.0, "H", 0.01217, 1.2571), (10.0, "V", 0.01129, 1.2156), (20.0, "H", 0.09164, 1.0568), (20.0, "V", 0.09611, 0.9847), (40.0, "H", 0.4431, 0.8673), (40.0, "V", 0.4274, 0.8421), (100.0, "H", 1.3671, 0.6815), (100.0, "V", 1.3680, 0.6765)]


def test_regression_gives_the_published_values(spark):
    df = spark.createDataFrame([(f, p) for f, p, *_ in KNOWN], "f double, p string")
    for (f, p, k, a), r in zip(KNOWN, df.select(*rain.k_and_a(F.col("f"), F.col("p"))).collect(), strict=True):
        assert r[0] == pytest.approx(k, rel=3e-3) and r[1] == pytest.approx(a, abs=1e-3), (f, p)


def test_regression_cases(spark):
    df = spark.createDataFrame([(20.0, "horizontal"), (20.0, "v"), (20.0, "45"), (20.0, None), (20.0, "?"), (0.5, "H"), (None, "H")], "f double, p string")
    k = [r[0] for r in df.select(rain.regression(F.col("f"), F.col("p"))).collect()]
    assert k[0] < k[2] < k[1] and k[3:] == [None] * 4
    rate = df.limit(1).select(rain.rain_rate(F.lit(3.0), F.lit(2.0), F.col("f"), F.col("p")), rain.rain_rate(F.lit(-1.0), F.lit(2.0), F.col("f"), F.col("p")), rain.rain_rate(F.lit(1.0), F.lit(0.0), F.col("f"), F.col("p"))).first()
    assert 0.09164 * rate[0] ** 1.0568 == pytest.approx(1.5, rel=3e-3) and rate[1] == 0 and rate[2] is None
    level, steep = (df.limit(1).select(*rain.k_and_a(F.col("f"), F.col("p"), F.lit(e))).first() for e in (0.0, 90.0))
    assert level[0] == pytest.approx(k[0]) and steep[0] == pytest.approx((k[0] + k[1]) / 2)
