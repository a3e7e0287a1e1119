"""Clock times, service dates and lenient numbers as Column expressions. Times are seconds, not timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLOCK = r"^(\d+):([0-5]\d)(?::([0-5]\d)(\.\d+)?)?$"  # fixed grammar: hours may pass 24


def lenient_int(value: Column, default: int | None = None) -> Column:
    got = F.trim(value).try_cast("int")
    return got if default is None else F.coalesce(got, F.lit(default))


def lenient_double(value: Column, default: float | None = None) -> Column:
    got = F.trim(value).try_cast("double")
    return got if default is None else F.coalesce(got, F.lit(default))


def timetable_seconds(value: Column) -> Column:
    """H:MM:SS of a timetable as int seconds; blank is null."""
    part = lambda i: F.get(F.split(F.trim(value), ":"), F.lit(i)).try_cast("int")
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", F.lit(None).cast("int")).otherwise(part(0) * 3600 + F.coalesce(part(1), F.lit(0)) * 60 + F.coalesce(part(2), F.lit(0)))


def clock_or_seconds(value: Column, strict: bool = False) -> Column:
    """A clock text or plain seconds as double seconds; null if neither, or an error if strict."""
    text = F.trim(value)
    group = lambda i: F.regexp_extract(text, CLOCK, i)
    clock = group(1).cast("double") * 3600 + group(2).cast("double") * 60 + F.when(group(3) == "", 0.0).otherwise(group(3).try_cast("double")) + F.when(group(4) == "", 0.0).otherwise(F.concat(F.lit("0"), group(4)).try_cast("double"))
    plain = text.try_cast("double")
    bad = F.raise_error(F.concat(F.lit("not a time: "), text)).cast("double") if strict else F.lit(None).cast("double")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None).cast("double")).when(text.rlike(CLOCK), clock).when(plain.isNotNull(), plain).otherwise(bad)


def format_clock(seconds: Column) -> Column:
    """HH:MM:SS; null and NaN are null."""
    s = F.floor(seconds).cast("long")
    return F.when(seconds.isNull() | F.isnan(seconds.cast("double")), F.lit(None).cast("string")).otherwise(F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))))


def compact_clock(seconds: Column) -> Column:
    """HHMMSS, the suffix of a departure id."""
    s = seconds.cast("long")
    return F.format_string("%02d%02d%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def service_date(value: Column) -> Column:
    """YYYYMMDD (first eight characters) as a date, null if it is none."""
    return F.try_to_date(F.substring(F.trim(value), 1, 8), "yyyyMMdd")
