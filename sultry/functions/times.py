"""Time column functions; all timestamps are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_date(ts: Column, offset_s: Column) -> Column:
    """Date of a UTC time at a fixed offset in seconds."""
    return F.to_date(F.timestamp_add("SECOND", offset_s, ts))


def next_hour(ts: Column) -> Column:
    """First full hour after ts; a full hour is followed by the next."""
    return F.timestamp_add("HOUR", F.lit(1), F.date_trunc("HOUR", ts))


def covering_steps(first: Column, last: Column, most: int = 240) -> Column:
    """Three-hourly steps that bracket a window of hours; null where they end after `most`."""
    a, b = (F.floor(first / 3) * 3).cast("int"), (F.ceil(last / 3) * 3).cast("int")
    return F.when(b <= most, F.sequence(a, b, F.lit(3)))


def hourly_steps(first: Column, count: int = 24, most: int = 120) -> Column:
    """Hourly leads from first; null unless all lie in 0..most."""
    last = first + count - 1
    return F.when((first >= 0) & (last <= most), F.sequence(first.cast("int"), last.cast("int")))


def candidate_cycles(now: Column, published: Column, delay_h: int = 5, lookback_h: int = 30) -> Column:
    """Six-hourly runs, newest first: available `delay_h` hours after their time, at most lookback_h old, newer than the published one."""
    newest = F.timestamp_add("HOUR", F.lit(-delay_h), now)
    floor = F.timestamp_add("HOUR", (F.floor(F.hour(newest) / 6) * 6).cast("int"), F.date_trunc("DAY", newest))
    runs = F.transform(F.sequence(F.lit(0), F.lit(lookback_h // 6)), lambda i: F.timestamp_add("HOUR", -6 * i, floor))
    return F.filter(runs, lambda r: (r >= F.timestamp_add("HOUR", F.lit(-lookback_h), now)) & (published.isNull() | (r > published)))


def lead_hour_bin(hours: Column) -> Column:
    h = F.floor(hours)
    return F.when(h <= 6, "0-6").when(h <= 12, "7-12").when(h <= 18, "13-18").otherwise("19+")


def complete_week(day: Column) -> Column:
    """Struct (first, last): the Monday to Sunday before a date's own week."""
    monday = F.date_sub(day, F.weekday(day))
    return F.struct(F.date_sub(monday, 7).alias("first"), F.date_sub(monday, 1).alias("last"))


def resolve_run_init(run: Column, available: Column, requested: Column, minutes: int = 10) -> Column:
    """The run, if it was available at least `minutes` before the request."""
    return F.when(F.timestamp_add("MINUTE", F.lit(minutes), available) <= requested, run)


def whole_second(ts: Column) -> Column:
    return F.date_trunc("SECOND", ts)
