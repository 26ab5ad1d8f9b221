import datetime as dt

import pytest
from pyspark.sql import functions as F

from hopgauge.functions.cftime import cf_time

CASES = [
    (0.0, "days since 1970-01-01", None, "1970-01-01 00:00:00"),
    (1.5, "days since 2000-02-28", "gregorian", "2000-02-29 12:00:00"),
    (366.0, "days since 2000-01-01 00:00:00", "standard", "2001-01-01 00:00:00"),
    (366.0, "Days Since 2000-1-1", "noleap", "2001-01-02 00:00:00"),
    (59.0, "days since 2001-01-01", "365_day", "2001-03-01 00:00:00"),
    (59.0, "days since 2000-01-01", "noleap", "2000-03-01 00:00:00"),
    (59.0, "days since 2000-01-01", "all_leap", "2000-02-29 00:00:00"),
    (59.0, "days since 2001-01-01", "366_day", None),
    (359.0, "days since 2001-01-01", "360_day", "2001-12-30 00:00:00"),
    (59.0, "days since 2001-01-01", "360_day", None),
    (60.25, "days since 2001-01-01", "360_day", "2001-03-01 06:00:00"),
    (3.0, "hours since 2021-01-01 00:00:00 +02:00", None, "2021-01-01 01:00:00"),
    (3.0, "hr since 2021-01-01T10Z", None, "2021-01-01 13:00:00"),
    (90.0, "minutes since 2021-01-01 10:30 -0130", None, "2021-01-01 13:30:00"),
    (-1.0, "s since 2021-01-01 00:00:00 UTC", None, "2020-12-31 23:59:59"),
    (1609459200.25, "seconds since 1970-01-01 00:00:00", "proleptic_gregorian", "2021-01-01 00:00:00.250000"),
    (1609459200123.0, "milliseconds since 1970-01-01", None, "2021-01-01 00:00:00.123000"),
    (5.0, "ms since 2021-01-01 00:00:00.5", None, "2021-01-01 00:00:00.505000"),
    (7.0, "microseconds since 2021-01-01", None, "2021-01-01 00:00:00.000007"),
    (1500.0, "nanoseconds since 2021-01-01", None, "2021-01-01 00:00:00.000001"),
    (737791.0, "days since 0001-01-01", "standard", "2020-12-31 00:00:00"),
    (737789.0, "days since 0001-01-01", "proleptic_gregorian", "2020-12-31 00:00:00"),
    (1.0, "days since 1582-10-04", "standard", "1582-10-15 00:00:00"),
    (13.0, "days since 2021-01-01", "julian", "2021-01-27 00:00:00"),
    (1609459200 * 1e9, None, None, "2021-01-01 00:00:00"),
    (1.0, "months since 2021-01-01", None, None),
    (1.0, "days after 2021-01-01", None, None),
    (1.0, "days since 2021-13-01", None, None),
    (1.0, "days since 2021-01-01", "martian", None),
    (float("nan"), "days since 2021-01-01", None, None),
    (None, "days since 2021-01-01", None, None),
]


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(CASES)], "k int, v double, u string, c string, want string")
    return {r.k: r.t for r in df.select("k", cf_time(F.col("v"), F.col("u"), F.col("c")).alias("t")).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_cases(got, k):
    assert got[k] == (CASES[k][3] and dt.datetime.fromisoformat(CASES[k][3]))


def test_exact_nanoseconds(spark):
    row = spark.sql("SELECT 1609459200123456789L AS v, CAST(NULL AS string) AS u").select(cf_time(F.col("v"), F.col("u"))).first()
    assert row[0] == dt.datetime(2021, 1, 1, 0, 0, 0, 123456)


def test_against_the_calendar_of_the_library(spark):
    days = list(range(-200_000, 200_000, 997))
    df = spark.createDataFrame([(float(d),) for d in days], "v double")
    got = [r[0] for r in df.select(cf_time(F.col("v"), F.lit("days since 2000-03-01"), F.lit("proleptic_gregorian"))).collect()]
    assert got == [dt.datetime(2000, 3, 1) + dt.timedelta(d) for d in days]
