"""Link quality: plateaus, temporal checks, availability, detection limit, verdicts; the whole job in run()."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopgauge.functions.columns import SERIES, gigahertz, gigahertz_of_table, polarization, require, signal_names
from hopgauge.functions.nulls import clean_signals, holds
from hopgauge.operators.gaps import fill_blackouts, interpolate, interpolate_by_time, with_blackouts
from hopgauge.operators.rolling import centered, rolling_max, rolling_variance, with_rolling_variance

PROC_LINES = ("no_filter", "graf_2020", "full")
#: What each flag means (stored as column metadata).
MEANINGS = {
    "isSane_plateaus_rsl": "False where the receive level is low and steady; such samples are missing afterwards.",
    "flag_blackout_fill": "True where a short gap next to a low receive level was filled.",
    "trsl": "Transmit minus receive level after masks, fills and interpolation.",
    "detection_limit": "Least detectable rain rate of the sublink in mm/h.",
    "isSane_detection_limit": "True where the detection limit is small enough.",
    "isSane_std_long": "True where few long windows vary much.",
    "isSane_std_short": "True where few short windows vary much.",
    "isSane_available": "True where less than the given share of samples is missing.",
    "isSane_sublink": "The verdict of the processing line on the sublink.",
    "isSane": "True where any sublink of the link passes.",
}


@dataclass(frozen=True)
class Config:
    """Fixed values of the method; strict selects the complete-window variant of the operators."""

    proc_line: str = "full"
    strict: bool = False
    plateau_window: int = 3
    plateau_below: float = -85.0
    plateau_std: float = 0.5
    plateau_pad: int = 5
    blackout_below: float = -65.0
    blackout_longest: int = 60
    interpolate_samples: int = 5
    interpolate_seconds: int = 300
    long_window: int = 300
    long_std: float = 2.0
    long_share: float = 0.1
    short_window: int = 60
    short_std: float = 0.8
    short_share: float = 0.33
    missing_share: float = 0.5
    quantization_db: float = 0.33
    detectable_below: float = 2.0

    def __post_init__(self) -> None:
        if self.proc_line not in PROC_LINES:
            raise ValueError(f"proc_line must be one of {PROC_LINES}")


class Result(NamedTuple):
    samples: DataFrame
    sublinks: DataFrame
    links: DataFrame


def with_plateaus(df: DataFrame, rsl: str, c: Config = Config(), name: str = "isSane_plateaus_rsl") -> DataFrame:
    """df with the flag that is False on and around low, steady stretches.

    Two samples around a core are flagged, too (plateau_pad = 5); strict: only where that whole window is in the series.
    """
    low = rolling_max(F.col(rsl), c.plateau_window, c.strict) < c.plateau_below
    variance = rolling_variance(F.col(rsl), c.plateau_window, c.strict)
    steady = F.sqrt(variance).cast("float") < c.plateau_std if c.strict else variance < c.plateau_std**2
    df = df.withColumn("_core", holds(low) & holds(steady))
    bad = F.col("_core")
    if c.plateau_pad > 1:
        frame = centered(c.plateau_pad)
        bad = F.max("_core").over(frame)
        if c.strict:
            bad = bad & (F.count(F.lit(1)).over(frame) == c.plateau_pad)
    return df.withColumn(name, ~bad).drop("_core")


def total_loss(tsl: Column, rsl: Column) -> Column:
    return tsl - rsl


def rolling_counts(df: DataFrame, x: str, windows: dict[str, tuple[int, float]], strict: bool = False, only: Column | None = None) -> DataFrame:
    """One row a series: for each name <name>_high and <name>_valid, numbers of windows with more deviation than the limit and of valid ones. only: samples that are counted."""
    only = F.lit(True) if only is None else only
    df = with_rolling_variance(df, x, {f"_v_{k}": n for k, (n, _) in windows.items()}, strict)
    counts = []
    for k, (_, limit) in windows.items():
        v = F.col(f"_v_{k}")
        high = F.sqrt(v).cast("float") > limit if strict else v > limit**2
        counts += [F.count_if(holds(high) & only).alias(f"{k}_high"), F.count_if(v.isNotNull() & only).alias(f"{k}_valid")]
    return df.groupBy(*SERIES).agg(*counts, F.count_if(F.col(x).isNull() & only).alias("missing"), F.count_if(only).alias("samples"))


def few_high(name: str, share: float) -> Column:
    return holds(F.try_divide(F.col(f"{name}_high"), F.col(f"{name}_valid")) <= share)


def attenuation(frequency_ghz: Column, polarization: Column | None = None) -> Column:
    """Specific attenuation by a power of the frequency, alike for all polarizations."""
    return F.lit(4.21e-5) * F.pow(frequency_ghz.cast("double"), F.lit(2.42))


def detection_limit(length_km: Column, frequency_ghz: Column, quantization_db: float = 0.33, coefficient=attenuation, polarized: Column | None = None) -> Column:
    """Least detectable rain rate in mm/h (float); NULL without a positive, finite sensitivity. coefficient: of frequency and polarization."""
    s = coefficient(frequency_ghz, F.lit(None).cast("string") if polarized is None else polarized) * length_km.cast("double")
    return F.when((s > 0) & (s < float("inf")), F.lit(quantization_db) / s).cast("float")


def verdict(c: Config) -> Column:
    if c.proc_line == "no_filter":
        return F.lit(True)
    both = F.col("isSane_std_long") & F.col("isSane_std_short")
    return both if c.proc_line == "graf_2020" else both & F.col("isSane_detection_limit") & F.col("isSane_available")


def process_samples(samples: DataFrame, c: Config = Config()) -> DataFrame:
    """samples with masked and filled signals, isSane_plateaus_rsl, flag_blackout_fill and trsl."""
    tsl, rsl = signal_names(samples)
    df = clean_signals(require(samples, [*SERIES, "time"]), tsl, rsl)
    if c.proc_line == "full":
        df = with_plateaus(df, rsl, c)
        df = df.withColumns({n: F.when(F.col("isSane_plateaus_rsl"), F.col(n)) for n in (tsl, rsl)})
        df = with_blackouts(df, rsl, c.blackout_below, c.blackout_longest)
        df = fill_blackouts(df, tsl, rsl, strict=c.strict)
    else:
        df = df.withColumns({"isSane_plateaus_rsl": F.lit(True), "flag_blackout_fill": F.lit(False)})
    df = df.withColumn("trsl", total_loss(F.col(tsl), F.col(rsl)))
    if c.proc_line != "no_filter":
        df = interpolate_by_time(df, "trsl", c.interpolate_seconds) if c.strict else interpolate(df, "trsl", c.interpolate_samples)
    return df


def judge_sublinks(processed: DataFrame, links: DataFrame, sublinks: DataFrame, c: Config = Config(), coefficient=attenuation) -> DataFrame:
    """One row a series with the detection limit, all flags and isSane_sublink. links: cml_id, length_km; sublinks: SERIES, frequency, polarization."""
    return judged(rolling_counts(processed, "trsl", {"long": (c.long_window, c.long_std), "short": (c.short_window, c.short_std)}, c.strict), links, sublinks, c, coefficient)


def judged(counts: DataFrame, links: DataFrame, sublinks: DataFrame, c: Config = Config(), coefficient=attenuation) -> DataFrame:
    """``judge_sublinks`` from the counts of windows."""
    statics = gigahertz_of_table(sublinks) if c.strict else sublinks.withColumn("frequency", gigahertz(F.col("frequency")))
    if "polarization" in statics.columns:
        statics = statics.withColumn("polarization", polarization(F.col("polarization")))
    df = counts.join(statics, list(SERIES), "left").join(links, "cml_id", "left")
    df = df.withColumn("detection_limit", detection_limit(F.col("length_km"), F.col("frequency"), c.quantization_db, coefficient, F.col("polarization") if "polarization" in df.columns else None)).withColumns({
        "isSane_detection_limit": holds(F.col("detection_limit") < c.detectable_below),
        "isSane_std_long": few_high("long", c.long_share),
        "isSane_std_short": few_high("short", c.short_share),
        "isSane_available": holds(F.try_divide(F.col("missing"), F.col("samples")) < c.missing_share),
    })
    return df.withColumn("isSane_sublink", verdict(c))


def judge_links(judged: DataFrame) -> DataFrame:
    return judged.groupBy("cml_id").agg(F.bool_or("isSane_sublink").alias("isSane"))


def with_meanings(df: DataFrame, proc_line: str) -> DataFrame:
    for name in set(df.columns) & MEANINGS.keys():
        df = df.withMetadata(name, {"meaning": MEANINGS[name]})
    return df.withColumn("proc_line", F.lit(proc_line))


def run(samples: DataFrame, links: DataFrame, sublinks: DataFrame, config: Config = Config(), coefficient=attenuation) -> Result:
    """The link quality job: samples, sublinks and links with their flags. coefficient: specific attenuation of frequency (GHz) and polarization, as columns."""
    processed = process_samples(samples, config)
    verdicts = judge_sublinks(processed, links, sublinks, config, coefficient)
    return Result(*(with_meanings(df, config.proc_line) for df in (processed, verdicts, judge_links(verdicts))))


def coefficients(rows: dict[tuple[float, str], float]):
    """A coefficient function from known values by frequency (GHz) and polarization: that of the nearest frequency with the polarization, else ``attenuation``."""

    def of(frequency_ghz: Column, polarized: Column) -> Column:
        known = F.array(*[F.struct(F.lit(float(f)).alias("f"), F.lit(p).alias("p"), F.lit(float(k)).alias("k")) for (f, p), k in sorted(rows.items())])
        alike = F.filter(known, lambda x: x["p"] == polarized)
        nearest = F.array_min(F.transform(alike, lambda x: F.struct(F.abs(x["f"] - frequency_ghz).alias("d"), x["k"].alias("k"))))
        return F.coalesce(nearest["k"], attenuation(frequency_ghz))

    return of


def run_info(config: Config, seconds: float | None) -> dict[str, str | float | None]:
    """What is stored beside the results of a run. seconds: of computing without saving, if known."""
    steps = "plateaus, blackout fills, interpolation of the total loss, detection limit, deviations in long and short windows, availability"
    return {"qc_processing_line": config.proc_line, "qc_elapsed_seconds_excluding_save": seconds, "qc_notes": f"Flags follow {steps}."} | {f"qc_{k}": v for k, v in vars(config).items() if k != "proc_line"}


def first_links(df: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """df of the first n links by their stored position (links: cml_id, pos)."""
    return df.join(links.orderBy("pos").limit(n).select("cml_id"), "cml_id", "left_semi")
