"""Date and time functions as Column expressions (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts(value: str | Column) -> Column:
    return F.lit(value).cast("timestamp") if isinstance(value, str) else value


def span(days: int = 0, hours: int = 0) -> Column:
    """A fixed day-time interval."""
    return F.make_dt_interval(F.lit(days), F.lit(hours))


def acquisition(date: Column, hhmm: Column) -> Column:
    """Date plus HHMM that may lack leading zeros."""
    return F.try_to_timestamp(F.concat(date, F.lit(" "), F.lpad(hhmm, 4, "0")), F.lit("yyyy-MM-dd HHmm"))


def iso(col: Column) -> Column:
    """ISO-8601 with offset or Z; anything else is null."""
    return F.when(col.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.trim(col).try_cast("timestamp"))


def plan_phase(col: Column) -> Column:
    return F.coalesce(
        F.try_to_timestamp(col, F.lit("dd/MM/yyyy HH:mm")),
        F.try_to_timestamp(col, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
        F.try_to_timestamp(col, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")),
    )


def rfc2822(col: Column) -> Column:
    bare = F.trim(F.regexp_replace(col, r"^[A-Za-z]{3},\s*", ""))
    numeric = F.regexp_replace(bare, r"\b(GMT|UTC|UT|Z)$", "+0000")
    return F.coalesce(
        F.try_to_timestamp(numeric, F.lit("d MMM yyyy HH:mm:ss xx")),
        F.try_to_timestamp(numeric, F.lit("d MMM yyyy HH:mm:ss")),
    )


def feed_date(col: Column, fallback: Column) -> Column:
    return F.coalesce(iso(col), rfc2822(col), fallback)


def published_in_text(text: Column, fallback: Column) -> Column:
    """First d/m/y date in a text; impossible dates give the fallback."""
    pattern = r"\b([0-3]?\d)[/-]([01]?\d)[/-](20\d{2}|\d{2})\b"
    day, month, year = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    full_year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    made = F.try_to_timestamp(F.concat_ws("/", day, month, full_year), F.lit("d/M/yyyy"))
    return F.when(day == "", fallback).otherwise(F.coalesce(made, fallback))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, truncated toward zero."""
    return F.try_divide(F.unix_micros(end) - F.unix_micros(start), F.lit(1_000_000)).cast("long")


def age_seconds(observed: Column, as_of: Column) -> Column:
    return seconds_between(observed, as_of)


def delay_seconds(observed: Column, published: Column, received: Column) -> Column:
    """Reception delay from publication, else from observation, never negative."""
    start = F.coalesce(published, observed)
    return F.when(
        received.isNotNull() & start.isNotNull(), F.greatest(F.lit(0).cast("long"), seconds_between(start, received))
    )


def duration_seconds(start: Column, end: Column, as_of: Column) -> Column:
    return F.when(
        start.isNotNull(), F.greatest(F.lit(0).cast("long"), seconds_between(start, F.coalesce(end, as_of)))
    )


def forecast_hour(day: Column, period: Column) -> Column:
    """Start of the forecast hour named by the first two digits of a period."""
    hour = F.coalesce(F.substring(period, 1, 2).try_cast("int"), F.lit(0))
    return F.date_trunc("day", day) + F.make_dt_interval(F.lit(0), hour)


def horizon_hours(issued: Column, target: Column) -> Column:
    hours = F.floor(F.try_divide(seconds_between(issued, target), F.lit(3600)))
    return F.coalesce(F.greatest(F.lit(0).cast("long"), hours), F.lit(0).cast("long")).cast("int")


def madrid_day(observed: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(observed, "Europe/Madrid"))


def day_label(day: Column) -> Column:
    return F.date_format(day, "dd MMMM yyyy")
