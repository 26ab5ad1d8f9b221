"""Missing values: NaN counts as missing at ingest and is NULL afterwards; infinities are values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def finite(x: Column) -> Column:
    """x where it is a finite number, else NULL."""
    return F.when(F.abs(x) < float("inf"), x)


def holds(predicate: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(predicate, F.lit(False))


def clean_signals(samples: DataFrame, *names: str) -> DataFrame:
    return samples.withColumns({n: nan_to_null(F.col(n).cast("float")) for n in names})
