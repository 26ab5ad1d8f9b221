"""Hand-made series through every operator of the link quality job, and random ones against a plain version."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopgauge.functions.columns import first_present, gigahertz, gigahertz_of_table, require, signal_names
from hopgauge.operators import gaps, quality, rolling

NAN = float("nan")


def series(spark, rsl, tsl=None, step=60):
    rows = [(1, "a", k * step, None if tsl is None else tsl[k], v) for k, v in enumerate(rsl)]
    df = spark.createDataFrame(rows, "cml_id long, sublink_id string, s long, tsl float, rsl float")
    df = df.withColumn("time", F.timestamp_seconds("s")).drop("s")
    return df if tsl is not None else df.withColumn("tsl", F.lit(20.0).cast("float"))


def column(df, name):
    return [r[0] for r in df.orderBy("time").select(name).collect()]


@pytest.mark.parametrize("n, rows", [(300, (-150, 149)), (60, (-30, 29)), (5, (-2, 2)), (3, (-1, 1))])
def test_frames(spark, n, rows):
    df = series(spark, [float(k) for k in range(400)])
    low, high = (column(df.withColumn("x", f("rsl").over(rolling.centered(n))), "x")[200] for f in (F.min, F.max))
    assert (low - 200, high - 200) == rows


@pytest.mark.parametrize("strict, want", [(False, [1, 1.633, 1]), (True, [None, 1.633, None])])
def test_rolling_deviation_both_forms(spark, strict, want):
    df = series(spark, [1.0, 3.0, 5.0])
    by_frame = column(df.withColumn("v", F.sqrt(rolling.rolling_variance(F.col("rsl"), 3, strict))), "v")
    by_sums = column(rolling.with_rolling_variance(df, "rsl", {"v": 3}, strict).withColumn("v", F.sqrt("v")), "v")
    for got in (by_frame, by_sums):
        assert [None if x is None else round(x, 3) for x in got] == want


def test_running_sums_equal_frames_on_random_series(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(-60, 3, 700)
    values = [None if u < 0.2 else float("inf") if u < 0.22 else float(np.float32(v)) for u, v in zip(rng.random(700), x)]
    df = series(spark, values)
    for n in (3, 60, 300):
        got = column(rolling.with_rolling_variance(df, "rsl", {"v": n}), "v")
        for k, v in enumerate(got):
            part = [y for y in values[max(0, k - n // 2) : k + n - n // 2] if y is not None and math.isfinite(y)]
            assert (v is None) == (not part) and (v is None or abs(v - np.var(part)) < 1e-4)


@pytest.mark.parametrize("strict, bad", [(False, {0, 1, 2, 8, 9, 10, 11, 12}), (True, {8, 9, 10, 11, 12})])
def test_plateaus(spark, strict, bad):
    rsl = [-90.0 if k in (0, 1, 9, 10, 11) else -60.0 for k in range(16)]
    sane = column(quality.with_plateaus(series(spark, rsl), "rsl", quality.Config(strict=strict)), "isSane_plateaus_rsl")
    assert {k for k, ok in enumerate(sane) if not ok} == bad


@pytest.mark.parametrize(
    "rsl, masked",
    [([-60, None, -70], 1), ([-70, None, -60], 1), ([None, -70], 1), ([-70, None], 1), ([-60, None, -60], 0), ([-65, None, -65], 0), ([-70, *[None] * 61, -70], 0), ([-70, *[None] * 60, -70], 60)],
)
def test_blackouts_and_their_mirror(spark, rsl, masked):
    for values in (rsl, rsl[::-1]):
        values = [None if v is None else float(v) for v in values]
        flags = column(gaps.with_blackouts(series(spark, values), "rsl"), "flag_blackout_fill")
        assert sum(flags) == masked and all(values[k] is None for k, f in enumerate(flags) if f)


def test_blackout_fill_takes_extremes_and_needs_both_signals(spark):
    filled = lambda tsl, strict: gaps.fill_blackouts(gaps.with_blackouts(series(spark, [-70.0, None, -80.0], tsl), "rsl"), "tsl", "rsl", strict=strict)
    assert column(filled([18.0, 19.0, 22.0], False), "tsl") == [18, 22, 22]
    assert column(filled([18.0, 19.0, 22.0], False), "rsl") == [-70, -80, -80]
    assert column(filled([None] * 3, False), "rsl") == [-70, None, -80]
    assert column(filled([None] * 3, True), "rsl") == [-70, -80, -80]


@pytest.mark.parametrize("x, want", [([1, *[None] * 5, 7], [1, 2, 3, 4, 5, 6, 7]), ([1, *[None] * 6, 8], None), ([None, 1], None), ([1, None], None)])
def test_interpolation_by_number(spark, x, want):
    x = [None if v is None else float(v) for v in x]
    assert column(gaps.interpolate(series(spark, x), "rsl"), "rsl") == (want or x)


def test_interpolation_by_time(spark):
    assert column(gaps.interpolate_by_time(series(spark, [1.0, *[None] * 5, 7.0]), "rsl"), "rsl") == [1, *[None] * 5, 7]
    assert column(gaps.interpolate_by_time(series(spark, [1.0, *[None] * 4, 6.0]), "rsl"), "rsl") == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("ghz, km, limit, ok", [(18, 5, 1.43715, True), (18, 3, 2.39525, False), (38, 1, 1.17803, True), (80, 0.5, 0.388852, True), (7, 10, 7.06471, False), (18, 0, None, False), (18, None, None, False)])
def test_detection_limit(spark, ghz, km, limit, ok):
    row = spark.createDataFrame([(float(ghz), None if km is None else float(km))], "f double, l double").select(quality.detection_limit(F.col("l"), F.col("f")).alias("d")).first()
    assert row.d == pytest.approx(limit, rel=1e-4) if limit else row.d is None
    assert bool(row.d is not None and row.d < 2) == ok


def test_units_by_value_and_by_table(spark):
    df = spark.createDataFrame([(18.0,), (38e9,)], "frequency double")
    assert [r[0] for r in df.select(gigahertz(F.col("frequency"))).collect()] == [18, 38]
    assert sorted(r[0] for r in gigahertz_of_table(df).collect()) == [18e-9, 38]


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "tx int, rx int")
    assert signal_names(df) == ("tx", "rx")
    with pytest.raises(KeyError):
        signal_names(df.drop("tx"))
    with pytest.raises(KeyError):
        first_present(df, ["a", "b"])
    with pytest.raises(ValueError, match="time"):
        require(df, ["tx", "time"])


def run(spark, rsl, tsl=None, **c):
    links = spark.createDataFrame([(1, 5.0)], "cml_id long, length_km double")
    sub = spark.createDataFrame([(1, "a", 18.0, b"V")], "cml_id long, sublink_id string, frequency double, polarization binary")
    return quality.run(series(spark, rsl, tsl), links, sub, quality.Config(**c))


def test_availability_is_strict_and_verdicts(spark):
    quiet = [-50.0, -50.1] * 40
    assert run(spark, quiet).links.first().isSane
    half = [v if k % 2 else None for k, v in enumerate([-50.0] * 80)]
    for proc_line, want in (("no_filter", False), ("full", True)):  # full closes single gaps first
        assert run(spark, half, proc_line=proc_line).sublinks.first().isSane_available is want
    wild = [-50.0, -20.0] * 40
    assert not run(spark, wild, proc_line="graf_2020").links.first().isSane
    assert run(spark, wild, proc_line="no_filter").links.first().isSane
    with pytest.raises(ValueError):
        quality.Config(proc_line="other")


def test_missing_and_empty_inputs(spark):
    assert not run(spark, [None] * 10).links.first().isSane
    assert run(spark, [NAN] * 10).sublinks.first().isSane_std_long is False
    assert run(spark, []).links.count() == 0
    meant = run(spark, [-50.0]).samples.schema["trsl"].metadata
    assert "meaning" in meant


def plain(rsl, tsl):
    """The whole fast chain on one series, in plain Python."""
    n, missing = len(rsl), lambda v: v is None
    window = lambda x, k, w: [v for v in x[max(0, k - w // 2) : k + w - w // 2] if v is not None and math.isfinite(v)]
    core = []
    for k in range(n):
        part = [v for v in rsl[max(0, k - 1) : k + 2] if v is not None]
        fin = window(rsl, k, 3)
        core.append(bool(part) and max(part) < -85 and bool(fin) and np.float32(np.var(fin)) < 0.25)
    sane = [not any(core[max(0, k - 2) : k + 3]) for k in range(n)]
    rsl, tsl = [v if s else None for v, s in zip(rsl, sane)], [v if s else None for v, s in zip(tsl, sane)]
    flag = [False] * n
    for k in range(n):
        if missing(rsl[k]) and (k == 0 or not missing(rsl[k - 1])):
            e = k
            while e < n and missing(rsl[e]):
                e += 1
            if e - k <= 60 and ((k > 0 and rsl[k - 1] < -65) or (e < n and rsl[e] < -65)):
                flag[k:e] = [True] * (e - k)
    if any(flag) and window(tsl, n // 2, 2 * n) and window(rsl, n // 2, 2 * n):
        high, low = max(v for v in tsl if v is not None), min(v for v in rsl if v is not None)
        tsl, rsl = [high if f else v for v, f in zip(tsl, flag)], [low if f else v for v, f in zip(rsl, flag)]
    loss = [None if a is None or b is None else float(np.float32(a) - np.float32(b)) for a, b in zip(tsl, rsl)]
    ok, out = [v is not None and math.isfinite(v) for v in loss], list(loss)
    for k in range(1, n):
        if not ok[k] and ok[k - 1]:
            e = k
            while e < n and not ok[e]:
                e += 1
            if e < n and e - k <= 5:
                for i in range(k, e):
                    out[i] = float(np.float32(loss[k - 1] + (loss[e] - loss[k - 1]) * (i - k + 1) / (e - k + 1)))
    return sane, flag, out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chain_equals_plain_version_on_random_series(spark, seed):
    rng = np.random.default_rng(seed)
    level = rng.choice([-50.0, -66.0, -90.0], 400)
    level = np.repeat(level[::8], 8)
    rsl = [None if u < 0.25 else float(np.float32(v + e)) for u, v, e in zip(rng.random(400), level, rng.normal(0, 0.2, 400))]
    tsl = [None if u < 0.05 else float(np.float32(20 + v)) for u, v in zip(rng.random(400), rng.random(400))]
    got = run(spark, rsl, tsl).samples
    sane, flag, loss = plain(rsl, tsl)
    assert column(got, "isSane_plateaus_rsl") == sane and column(got, "flag_blackout_fill") == flag
    for a, b in zip(column(got, "trsl"), loss):
        assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-5)


def test_one_exchange_for_all_windows(spark):
    df = quality.process_samples(series(spark, [-50.0, None, -70.0] * 5))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_levels_are_compared_as_floats(spark):
    """-65.0000001 is -65 as a float, which is not below -65."""
    df = series(spark, [-65.0000001, None, -65.0000001])
    assert column(gaps.with_blackouts(df, "rsl"), "flag_blackout_fill") == [False] * 3
    df = series(spark, [-65.00001, None, -60.0])
    assert column(gaps.with_blackouts(df, "rsl"), "flag_blackout_fill") == [False, True, False]


def test_rolling_maximum_keeps_infinities(spark):
    inf = math.inf
    df = series(spark, [-inf, -inf, None, None, -inf, inf, -60.0, None, None, None, -70.0])
    assert column(df.withColumn("x", rolling.rolling_max(F.col("rsl"), 3)), "x") == [-inf, -inf, -inf, -inf, inf, inf, inf, -60, None, -70, -70]
    steady = quality.with_plateaus(series(spark, [-inf] * 9), "rsl")  # no finite value, no deviation: no plateau
    assert all(column(steady, "isSane_plateaus_rsl"))


def test_even_windows_lie_half_before_and_half_less_one_after(spark):
    values = [5.0, 1.0, 2.0, 9.0, 3.0, 4.0]
    want = [max(values[max(0, k - 2) : k + 2]) for k in range(6)]
    assert column(series(spark, values).withColumn("x", rolling.rolling_max(F.col("rsl"), 4)), "x") == want
    strict = column(series(spark, values).withColumn("x", rolling.rolling_max(F.col("rsl"), 4, True)), "x")
    assert strict == [None, None, *want[2:5], None]


def test_windows_with_any_value_are_valid_even_if_their_deviation_overflows(spark):
    df = series(spark, [3e38, -3e38, None, None, None, 1.0])
    got = quality.rolling_counts(df, "rsl", {"w": (2, 1.0)}).first()
    assert (got.w_valid, got.w_high) == (4, 1)
