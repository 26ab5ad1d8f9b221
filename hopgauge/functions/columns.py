"""Names and units of the inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERIES = ("cml_id", "sublink_id")


def signal_names(df: DataFrame) -> tuple[str, str]:
    """The transmit and receive column: tsl and rsl, else tx and rx."""
    for pair in (("tsl", "rsl"), ("tx", "rx")):
        if set(pair) <= set(df.columns):
            return pair
    raise KeyError("samples need the columns tsl and rsl, or tx and rx")


def require(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of several alternative columns that there is."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    raise KeyError(f"none of {list(names)} is there")


def polarization(x: Column) -> Column:
    return x.cast("string")


def gigahertz(frequency: Column) -> Column:
    """Each value over 1000 is in Hz."""
    return F.when(frequency > 1000, frequency / 1e9).otherwise(frequency)


def gigahertz_of_table(sublinks: DataFrame, name: str = "frequency") -> DataFrame:
    """All values are in Hz if the largest is over 1000. The largest is one row, hence the broadcast."""
    largest = sublinks.agg(F.max(name).alias("_largest"))
    return sublinks.crossJoin(F.broadcast(largest)).withColumn(name, F.when(F.col("_largest") > 1000, F.col(name) / 1e9).otherwise(F.col(name))).drop("_largest")
