"""The link quality job on long series: a series is cut into blocks of samples, each with the samples around it that its windows reach (a halo).

A series is one window partition elsewhere; here a block is, so that tasks are bounded however long a series is. Samples are numbered first, unless they
carry ``idx``, from counts by stretches of time. Each then goes to its own block and to those whose halo it is in, in one exchange, and the
operators on series run on blocks as they are: the block is made part of the series' key. What concerns a whole series (the extremes that fill blackouts)
is carried as one row a block from a first pass over the blocks; counts of windows are summed over blocks.

The halo adds up what the steps reach: a plateau's window and pad, a blackout's longest run, an interpolation's longest run, half the longest
window. A run of missing samples that leaves the halo is longer than any that a step acts on. Interpolation by time (strict) has no such bound in
samples; for it the halo must be given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopgauge.functions.columns import SERIES, require, signal_names
from hopgauge.functions.nulls import clean_signals, finite
from hopgauge.operators import quality
from hopgauge.operators.gaps import interpolate, interpolate_by_time, with_blackouts

#: Samples of a block, and seconds of a stretch in which samples are counted.
ROWS, STRETCH = 1 << 16, 86_400


def halo_of(c: quality.Config) -> int:
    """Samples on either side that the steps of a configuration reach."""
    if c.strict:
        raise ValueError("interpolation by time reaches any number of samples: give a halo")
    return c.plateau_window + c.plateau_pad + c.blackout_longest + 1 + c.interpolate_samples + 1 + max(c.long_window, c.short_window) // 2 + 1


def numbered(df: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """df with idx, the sample's number in its series from 0; no task has more than one stretch of a series."""
    if "idx" in df.columns:
        return df
    none = -(1 << 40)  # samples without a time come first, as in any order by time
    at = F.coalesce(F.floor(F.unix_micros(F.col("time").cast("timestamp")) / (stretch * 1_000_000)).cast("long"), F.lit(none).cast("long"))
    df = df.withColumn("_at", F.struct(*SERIES, at.alias("stretch")))  # one key, so that series without a name are joined, too
    before = F.sum("_n").over(Window.partitionBy("_at.cml_id", "_at.sublink_id").orderBy("_at.stretch").rowsBetween(Window.unboundedPreceding, -1))
    first = df.groupBy("_at").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.coalesce(before, F.lit(0))).drop("_n")
    here = F.row_number().over(Window.partitionBy("_at").orderBy("time")) - 1
    # there are as many rows as days of all series: never broadcast, whatever size is estimated for them
    return df.withColumn("_here", here).join(first.hint("merge"), "_at").withColumn("idx", F.col("_first") + F.col("_here")).drop("_at", "_here", "_first")


def in_blocks(df: DataFrame, rows: int, halo: int) -> DataFrame:
    """df (with idx) by blocks: sublink_id is a struct of sublink_id and block and cml_id one of cml_id (joined where it is NULL, too), idx counts from the block's first sample, position from the series'; own tells the samples of the block itself."""
    block = F.explode(F.sequence(F.floor(F.greatest(F.col("idx") - halo, F.lit(0)) / rows), F.floor((F.col("idx") + halo) / rows))).alias("_block")
    dealt = df.select("*", block).withColumns({"cml_id": F.struct("cml_id"), "sublink_id": F.struct("sublink_id", F.col("_block").alias("block"))}).drop("_block")
    # the exchange carries idx alone; what follows from it is added behind, so that all passes over the blocks read one exchange
    dealt = dealt.withColumnRenamed("idx", "position").repartition(*SERIES)
    of = F.col("sublink_id.block")
    return dealt.withColumns({"own": F.floor(F.col("position") / rows) == of, "idx": (F.col("position") - F.greatest(of * rows - halo, F.lit(0))).cast("long")})


def whole_series(df: DataFrame) -> DataFrame:
    """The samples of blocks as series again."""
    return df.where("own").withColumns({"cml_id": F.col("cml_id.cml_id"), "sublink_id": F.col("sublink_id.sublink_id"), "idx": F.col("position")}).drop("own", "position")


def _filled(df: DataFrame, tsl: str, rsl: str, strict: bool) -> DataFrame:
    """``gaps.fill_blackouts`` with the extremes of whole series: of blocks first, then of a series' blocks, with a row a block again, which is joined where the block is. Samples are not exchanged for it."""
    count = lambda x: F.count(finite(F.col(x))).alias(f"_{x}")
    series = Window.partitionBy("cml_id", "sublink_id.sublink_id")
    able = F.lit(True) if strict else (F.sum(f"_{tsl}").over(series) > 0) & (F.sum(f"_{rsl}").over(series) > 0)
    each = df.where("own").groupBy(*SERIES).agg(F.max(tsl).alias("_high"), F.min(rsl).alias("_low"), count(tsl), count(rsl))
    extremes = each.select(*SERIES, F.max("_high").over(series).alias("_high"), F.min("_low").over(series).alias("_low"), able.alias("_able"))
    put = lambda x, fill: F.when(F.col("flag_blackout_fill") & F.col("_able"), F.col(fill)).otherwise(F.col(x))
    return df.join(extremes.hint("merge"), list(SERIES), "left").withColumns({tsl: put(tsl, "_high"), rsl: put(rsl, "_low")}).drop("_high", "_low", "_able")


def process_blocks(samples: DataFrame, c: quality.Config = quality.Config(), rows: int = ROWS, halo: int | None = None) -> DataFrame:
    """``quality.process_samples`` by blocks (see ``in_blocks``), halos included."""
    tsl, rsl = signal_names(samples)
    df = in_blocks(numbered(clean_signals(require(samples, [*SERIES, "time"]), tsl, rsl)), rows, halo_of(c) if halo is None else halo)
    if c.proc_line == "full":
        df = quality.with_plateaus(df, rsl, c)
        df = df.withColumns({n: F.when(F.col("isSane_plateaus_rsl"), F.col(n)) for n in (tsl, rsl)})
        df = _filled(with_blackouts(df, rsl, c.blackout_below, c.blackout_longest), tsl, rsl, c.strict)
    else:
        df = df.withColumns({"isSane_plateaus_rsl": F.lit(True), "flag_blackout_fill": F.lit(False)})
    df = df.withColumn("trsl", quality.total_loss(F.col(tsl), F.col(rsl)))
    if c.proc_line != "no_filter":
        df = interpolate_by_time(df, "trsl", c.interpolate_seconds) if c.strict else interpolate(df, "trsl", c.interpolate_samples)
    return df


def block_counts(df: DataFrame, x: str, windows: dict[str, tuple[int, float]], strict: bool = False) -> DataFrame:
    """``quality.rolling_counts`` of whole series from blocks."""
    counts = quality.rolling_counts(df, x, windows, strict, F.col("own"))
    names = [c for c in counts.columns if c not in SERIES]
    return counts.groupBy(F.col("cml_id.cml_id").alias("cml_id"), F.col("sublink_id.sublink_id").alias("sublink_id")).agg(*[F.sum(n).alias(n) for n in names])


def run(samples: DataFrame, links: DataFrame, sublinks: DataFrame, config: quality.Config = quality.Config(), coefficient=quality.attenuation, rows: int = ROWS, halo: int | None = None) -> quality.Result:
    """``quality.run`` with no more than rows samples and their halo in a task."""
    blocks = process_blocks(samples, config, rows, halo)
    windows = {"long": (config.long_window, config.long_std), "short": (config.short_window, config.short_std)}
    judged = quality.judged(block_counts(blocks, "trsl", windows, config.strict), links, sublinks, config, coefficient)
    return quality.Result(*(quality.with_meanings(df, config.proc_line) for df in (whole_series(blocks), judged, quality.judge_links(judged))))

