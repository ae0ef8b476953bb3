"""Date expressions. ``as_of`` is always given; nothing reads the clock."""

from __future__ import annotations

import calendar
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def named_range(name: str, today: date) -> tuple[date | None, date | None]:
    """Bounds of past, upcoming, this-week and this-month; a week ends 7 - (day of week, Sunday 0) days on."""
    if name == "past":
        return None, today - timedelta(days=1)
    if name == "upcoming":
        return today, None
    if name == "this-week":
        return today, today + timedelta(days=7 - today.isoweekday() % 7)
    if name == "this-month":
        return today, today.replace(day=calendar.monthrange(today.year, today.month)[1])
    raise ValueError(f"no range is named {name}")


def within(column: Column, bounds: tuple[date | None, date | None]) -> Column:
    lo, hi = bounds
    out = F.lit(True)
    if lo:
        out &= column >= F.lit(lo)
    if hi:
        out &= column <= F.lit(hi)
    return out


def overlaps(start: Column, end: Column, bounds: tuple[date | None, date | None]) -> Column:
    """An event with a nullable end that is not over before the range and starts inside it."""
    lo, hi = bounds
    out = F.lit(True)
    if lo:
        out &= F.when(end.isNotNull(), end >= F.lit(lo)).otherwise(start >= F.lit(lo))
    if hi:
        out &= F.coalesce(start, end) <= F.lit(hi)
    return out


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(b) - micros(a)) / F.lit(1e6)


def local(as_of: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(as_of.cast("timestamp"), zone)


def previous_week(as_of: Column) -> tuple[Column, Column]:
    """Monday and Sunday of the week before."""
    monday = F.date_sub(F.date_trunc("week", as_of).cast("date"), 7)
    return monday, F.date_add(monday, 6)


def deadline_bucket(deadline: Column, as_of: Column) -> Column:
    """past, Today (under 12 h), hours left, soon (3 days), week (7 days), later; null without one."""
    hours = seconds_between(as_of, deadline) / 3600
    return (
        F.when(deadline.isNull(), F.lit(None))
        .when(hours < 0, "past")
        .when(hours < 12, "Today")
        .when(hours < 24, F.concat(F.floor(hours).cast("string"), F.lit("h left")))
        .when(hours < 72, "soon")
        .when(hours < 168, "week")
        .otherwise("later")
    )


def event_status(start: Column, end: Column, as_of: Column) -> Column:
    """Past, Live, Tomorrow, In n days (to a week) or Upcoming."""
    days = F.ceil(seconds_between(as_of, start) / 86400)
    return (
        F.when(F.coalesce(end, start) < as_of, "Past")
        .when(start <= as_of, "Live")
        .when(days <= 1, "Tomorrow")
        .when(days <= 7, F.concat(F.lit("In "), days.cast("string"), F.lit(" days")))
        .otherwise("Upcoming")
    )


def time_ago(then: Column, as_of: Column) -> Column:
    s = seconds_between(then, as_of)
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, "just now").when(s < 3600, part(60, "m")).when(s < 86400, part(3600, "h")).otherwise(part(86400, "d"))


def iso_date(text: Column, as_of: Column) -> Column:
    """A date that is more than a year and at most two days ahead; null otherwise."""
    parsed = F.to_date(F.try_to_timestamp(F.when(~text.rlike(r"^\s*\d{4}\s*$"), text)))
    return F.when(parsed <= F.date_add(as_of.cast("date"), 2), parsed)


def range_text(start: Column, end: Column) -> Column:
    """``5 Mar 2024``, ``5 - 7 Mar 2024`` or both in full."""
    full = lambda c: F.date_format(c, "d MMM yyyy")
    same_month = F.date_trunc("month", start) == F.date_trunc("month", end)
    return (
        F.when(end.isNull() | (start == end), full(start))
        .when(same_month, F.concat(F.date_format(start, "d"), F.lit(" - "), full(end)))
        .otherwise(F.concat(full(start), F.lit(" - "), full(end)))
    )


def latest_year(text: Column, as_of_year: int, first: int = 1990) -> Column:
    """The latest year of the text between ``first`` and ``as_of_year``."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!\d)((?:19|20)\d\d)(?!\d)")), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: (y >= first) & (y <= as_of_year)))


def seconds_to_midnight(as_of: Column) -> Column:
    return (F.lit(86400) - (F.hour(as_of) * 3600 + F.minute(as_of) * 60 + F.second(as_of))).cast("long")
