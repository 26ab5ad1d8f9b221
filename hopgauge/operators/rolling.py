"""Centered rolling windows over the samples of a series (rows, never time ranges).

Everything is partitioned by series and ordered by time or, for what comes next, by time descending, so a chain of these
operators needs one exchange. Windows of more than a few rows use differences of running sums, whose cost does not depend on the
window's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from hopgauge.functions.columns import SERIES
from hopgauge.functions.nulls import finite


def whole() -> WindowSpec:
    return Window.partitionBy(*SERIES)


def forward() -> WindowSpec:
    return whole().orderBy("time")


def so_far() -> WindowSpec:
    return forward().rowsBetween(Window.unboundedPreceding, 0)


def from_here() -> WindowSpec:
    """The rest of the series, as a running frame of the reversed order."""
    return whole().orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)


def centered(n: int) -> WindowSpec:
    """Rows -n//2 to n - n//2 - 1 around each; cut at the ends of the series."""
    return forward().rowsBetween(-(n // 2), n - n // 2 - 1)


def rolling_max(x: Column, n: int, strict: bool = False) -> Column:
    """NULLs are skipped; strict: NULL unless all n are there."""
    frame = centered(n)
    return F.when(F.count(x).over(frame) == n, F.max(x).over(frame)) if strict else F.max(x).over(frame)


def rolling_variance(x: Column, n: int, strict: bool = False) -> Column:
    """Population variance (float) of the finite values by frames, for small n; strict: NULL unless all n are there."""
    frame, value = centered(n), finite(x).cast("double")
    found = F.var_pop(value).over(frame).cast("float")
    return F.when(F.count(value).over(frame) == n, found) if strict else found


def with_rolling_variance(df: DataFrame, x: str, windows: dict[str, int], strict: bool = False) -> DataFrame:
    """df with a column of rolling population variances (float) for each name and length, by running sums.

    Values are shifted by the series' largest one, which keeps the sums of squares precise.
    """
    value = F.col("_value")
    df = df.withColumn("_value", finite(F.col(x)).cast("double"))
    df = df.withColumn("_value", value - F.max(value).over(whole()))
    sums = {"_n": F.count(value), "_s": F.sum(value), "_q": F.sum(value * value)}
    df = df.withColumns({k: F.coalesce(f.over(so_far()), F.lit(0)) for k, f in sums.items()} | {f"{k}_all": F.coalesce(f.over(whole()), F.lit(0)) for k, f in sums.items()})
    for name, n in windows.items():
        part = {}
        for k in sums:
            high = F.coalesce(F.lead(k, n - n // 2 - 1).over(forward()), F.col(f"{k}_all"))
            part[f"{k}_in"] = high - F.coalesce(F.lag(k, n // 2 + 1).over(forward()), F.lit(0))
        mean = F.col("_s_in") / F.col("_n_in")
        variance = F.greatest(F.col("_q_in") / F.col("_n_in") - mean * mean, F.lit(0.0)).cast("float")
        df = df.withColumns(part).withColumn(name, F.when(F.col("_n_in") >= (n if strict else 1), variance)).drop(*part)
    return df.drop("_value", *sums, *[f"{k}_all" for k in sums])
