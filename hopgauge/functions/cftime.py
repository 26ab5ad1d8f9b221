"""Times that array files store as numbers: `days since 2000-01-01 00:00 +02:00`, by calendar."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of a unit (fixed values); plurals too. Months and years have no length of their own and are refused (NULL).
UNITS = {86_400_000_000: ("d", "day"), 3_600_000_000: ("h", "hr", "hour"), 60_000_000: ("min", "minute"), 1_000_000: ("s", "sec", "second"), 1_000: ("ms", "msec", "millisecond"), 1: ("us", "µs", "microsecond"), "0.001": ("ns", "nanosecond")}
#: Days of a year before each month, without a leap day.
_BEFORE = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)
CALENDARS = {"standard": ("standard", "gregorian", ""), "proleptic": ("proleptic_gregorian",), "julian": ("julian",), "noleap": ("noleap", "365_day"), "all_leap": ("all_leap", "366_day"), "360": ("360_day",)}
DAY = 86_400_000_000
_SINCE = r"(?i)^\s*([a-zµ]+)\s+since\s+([+-]?\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ]\s*(\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:\.(\d*))?)?)?)?\s*(Z|UTC|GMT|[+-]\d{1,2}(?::?\d{2})?)?\s*$"


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def _day_number(y: Column, m: Column, d: Column, gregorian: bool) -> Column:
    """Days since 1970-01-01 of a date in the (proleptic) Gregorian or the Julian calendar."""
    early = F.when(m < 3, 1).otherwise(0)  # years begin in March, so that leap days end them
    year, month = y - early, m + 12 * early - 3
    days = 365 * year + _div(year, 4) + _div(153 * month + 2, 5) + d
    return days - _div(year, 100) + _div(year, 400) - 719_469 if gregorian else days - 719_471


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _named(days: Column, of_year: int, before: tuple[int, ...]) -> Column:
    """Days since 1970-01-01 of the date that a day number names in a calendar whose years all have of_year days; NULL where there is no such date."""
    starts = F.array(*[F.lit(b) for b in before])

    def of(x: Column) -> Column:
        month = F.size(F.filter(starts, lambda b: b <= x["rest"])).cast("long")
        return let(F.struct(x["y"].alias("y"), month.alias("m"), (x["rest"] - F.element_at(starts, month.cast("int")) + 1).alias("d")), there)

    def there(x: Column) -> Column:
        end = _day_number(x["y"] + _div(x["m"], 12), x["m"] % 12 + 1, F.lit(1), True)
        return let(_day_number(x["y"], x["m"], x["d"], True), lambda n: F.when(n < end, n))

    return let(let(_div(days, of_year), lambda y: F.struct(y.alias("y"), (days - y * of_year).alias("rest"))), of)


def _same_label(of_year: int, before: tuple[int, ...]) -> Callable[[Column], Column]:
    """From microseconds in a calendar whose years all have of_year days to those since 1970 of the time that they name."""
    return lambda t: _named(F.floor(t / DAY).cast("long"), of_year, before) * DAY + F.pmod(t, F.lit(DAY))


def cf_time(value: Column, units: Column, calendar: Column | None = None) -> Column:
    """Timestamp of a number with its units and calendar (NULL or empty: standard). Without units the number is nanoseconds since 1970.

    Fractions count, to the microsecond. In calendars with years of other lengths a time is the one that its date and time of day
    name; NULL where the usual calendar has no such date (30 February), for units or calendars that are not known, and for NaN.
    """
    part = lambda k: F.regexp_extract(units, _SINCE, k)
    whole = lambda k: F.coalesce(part(k).try_cast("long"), F.lit(0).cast("long"))
    unit = F.regexp_replace(F.lower(part(1)), r"(?<=..)s$", "")  # no plural of s, ms, us, ns
    unit = F.when(F.lower(part(1)).isin("ms", "us", "µs", "ns"), F.lower(part(1))).otherwise(unit)
    size = F.lit(None).cast("decimal(14,3)")
    for micros, names in UNITS.items():
        size = F.when(unit.isin(*names), F.lit(str(micros)).cast("decimal(14,3)")).otherwise(size)
    size = F.when(units.isNull(), F.lit("0.001").cast("decimal(14,3)")).otherwise(size)
    number = F.when(~F.isnan(value.cast("double")), value).try_cast("decimal(28,9)")
    offset = F.round(number * size - F.when(size < 1, F.lit("0.4995").cast("decimal(14,4)")).otherwise(F.lit(0).cast("decimal(14,4)")), 0).cast("long")  # nanoseconds are cut
    zone = F.regexp_replace(part(9), "(?i)^(Z|UTC|GMT)$", "")
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.when(zone == "", 0).when(F.length(digits) > 2, _div(digits.try_cast("long"), 100) * 60 + digits.try_cast("long") % 100).otherwise(digits.try_cast("long") * 60)
    minutes = F.coalesce(F.when(zone.startswith("-"), -minutes).otherwise(minutes), F.lit(0)).cast("long")
    fraction = F.rpad(F.substring(part(8), 1, 6), 6, "0").try_cast("long")
    time = ((whole(5) * 60 + whole(6) - minutes) * 60 + whole(7)) * 1_000_000 + F.coalesce(fraction, F.lit(0)) + offset
    kind = F.lower(F.coalesce(calendar if calendar is not None else F.lit(None).cast("string"), F.lit("")))
    leap = tuple(b + (k > 1) for k, b in enumerate(_BEFORE))

    def instant(x: Column) -> Column:
        y, m, d = x["y"], x["m"], x["d"]
        gregorian, julian = _day_number(y, m, d, True), _day_number(y, m, d, False)
        days = F.when(x["kind"].isin(*CALENDARS["proleptic"]), gregorian).when(x["kind"].isin(*CALENDARS["julian"]), julian)
        days = days.when(x["kind"].isin(*CALENDARS["standard"]), F.when(y * 10_000 + m * 100 + d < 15_821_015, julian).otherwise(gregorian))
        found = days * DAY + x["time"]
        for name, of_year, before in (("noleap", 365, _BEFORE), ("all_leap", 366, leap), ("360", 360, tuple(range(0, 360, 30)))):
            total = (y * of_year + F.element_at(F.array(*[F.lit(b) for b in before]), m.cast("int")) + d - 1) * DAY + x["time"]
            found = F.when(x["kind"].isin(*CALENDARS[name]), let(total, _same_label(of_year, before))).otherwise(found)
        return F.when(m.between(1, 12) & d.between(1, 31), found)

    parsed = F.struct(whole(2).alias("y"), F.when(whole(3).between(1, 12), whole(3)).alias("m"), whole(4).alias("d"), time.alias("time"), kind.alias("kind"))
    return F.timestamp_micros(F.when(units.isNull(), offset).when(size.isNotNull(), let(parsed, instant)))
