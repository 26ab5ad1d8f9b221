"""Runs of missing samples: what is before and after, blackout masks and fills, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgauge.functions.nulls import finite, holds
from hopgauge.operators.rolling import forward, from_here, so_far, whole


def with_index(df: DataFrame) -> DataFrame:
    """df with idx, the sample's number in its series from 0."""
    return df if "idx" in df.columns else df.withColumn("idx", (F.row_number().over(forward()) - 1).cast("long"))


def with_neighbours(df: DataFrame, x: Column) -> DataFrame:
    """df with before_idx, before, after_idx, after (the nearest samples where x is not NULL, the sample itself included) and gap (missing run's length)."""
    df = with_index(df).withColumn("_x", x)
    seen = F.when(F.col("_x").isNotNull(), F.struct("idx", "time", "_x"))
    df = df.withColumn("_before", F.last(seen, ignorenulls=True).over(so_far())).withColumn("_after", F.last(seen, ignorenulls=True).over(from_here()))
    df = df.withColumns({f"{k}{end}": F.col(f"_{k}.{name}") for k in ("before", "after") for end, name in (("_idx", "idx"), ("_time", "time"), ("", "_x"))})
    gap = F.coalesce("after_idx", F.count(F.lit(1)).over(whole())) - F.coalesce("before_idx", F.lit(-1)) - 1
    return df.withColumn("gap", F.when(F.col("_x").isNull(), gap).otherwise(0).cast("int")).drop("_x", "_before", "_after")


NEIGHBOURS = ("before_idx", "before_time", "before", "after_idx", "after_time", "after", "gap")


def with_blackouts(df: DataFrame, rsl: str, below: float = -65.0, longest: int = 60, name: str = "flag_blackout_fill") -> DataFrame:
    """df with the flag of missing samples in a run of at most longest, next to which on either side the signal is below."""
    kept = df.columns
    df = with_neighbours(df, F.col(rsl))
    mask = F.col(rsl).isNull() & (F.col("gap") <= longest) & (holds(F.col("before") < below) | holds(F.col("after") < below))
    return df.withColumn(name, mask).select(*kept, "idx", name) if "idx" not in kept else df.withColumn(name, mask).select(*kept, name)


def fill_blackouts(df: DataFrame, tsl: str, rsl: str, flag: str = "flag_blackout_fill", strict: bool = False) -> DataFrame:
    """Flagged samples get the series' largest transmit and least receive level.

    If a series has no finite value in one of the two, it is left as it is; strict: each signal is filled on its own.
    """
    able = F.lit(True) if strict else (F.count(finite(F.col(tsl))).over(whole()) > 0) & (F.count(finite(F.col(rsl))).over(whole()) > 0)
    high, low = F.max(tsl).over(whole()), F.min(rsl).over(whole())
    return df.withColumns({"_able": able, "_high": high, "_low": low}).withColumns({
        tsl: F.when(F.col(flag) & F.col("_able"), F.col("_high")).otherwise(F.col(tsl)),
        rsl: F.when(F.col(flag) & F.col("_able"), F.col("_low")).otherwise(F.col(rsl)),
    }).drop("_able", "_high", "_low")


def interpolate(df: DataFrame, x: str, longest: int = 5) -> DataFrame:
    """Runs of at most longest samples without finite x between two finite ones are filled linearly by sample number."""
    kept = df.columns
    df = with_neighbours(df, finite(F.col(x)))
    before, after = F.col("before").cast("double"), F.col("after").cast("double")
    line = before + (after - before) * (F.col("idx") - F.col("before_idx")) / (F.col("after_idx") - F.col("before_idx"))
    fits = holds((F.col("gap") > 0) & (F.col("gap") <= longest) & F.col("before").isNotNull() & F.col("after").isNotNull())
    return df.withColumn(x, F.when(fits, line.cast("float")).otherwise(F.col(x))).select(*kept)


def interpolate_by_time(df: DataFrame, x: str, longest_seconds: int = 300) -> DataFrame:
    """Missing samples between two others at most longest_seconds apart are filled linearly by time."""
    kept = df.columns
    df = with_neighbours(df, F.col(x))
    before, after = F.col("before").cast("double"), F.col("after").cast("double")
    at = {k: F.unix_micros(F.col(k)) for k in ("time", "before_time", "after_time")}
    line = before + (after - before) * (at["time"] - at["before_time"]) / F.nullif(at["after_time"] - at["before_time"], F.lit(0))
    fits = holds((F.col("gap") > 0) & (at["after_time"] - at["before_time"] <= longest_seconds * 1_000_000))
    return df.withColumn(x, F.when(fits, line.cast(df.schema[x].dataType)).otherwise(F.col(x))).select(*kept)
