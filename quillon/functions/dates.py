"""Period, window and age arithmetic as column expressions; the clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(hours: int) -> Column:
    return F.lit(hours * 3_600)


def period_start(at: Column, hours: int) -> Column:
    """the start of the grid period around a time, as seconds since the epoch."""
    return F.floor(at / seconds(hours)) * seconds(hours)


def published_period(at: Column, hours: int) -> Column:
    """(start, end] of the newest period all days of which are over: two widths back to one, in epoch seconds."""
    b = period_start(at, hours)
    return F.struct((b - 2 * seconds(hours)).alias("start"), (b - seconds(hours)).alias("end"))


def rolling_window(end: Column, hours: int) -> Column:
    """F41."""
    return F.struct((end - seconds(hours)).alias("start"), end.alias("end"))


def in_window(day: Column, start: Column, end: Column) -> Column:
    """Start < day <= end."""
    return (day > start) & (day <= end)


def months_cutoff(today: Column, months: Column | float) -> Column:
    """a month is 30.5 days."""
    return F.date_sub(today, F.floor(F.lit(months) * 30.5).cast("int") if not isinstance(months, Column) else F.floor(months * 30.5).cast("int"))


def whole_months(days: Column) -> Column:
    """days to whole months, rounded up, from one to three."""
    return F.greatest(F.lit(1), F.least(F.lit(3), F.ceil(days / 30.5)))


def incremental_start(full: Column, last: Column, now: Column, hours: int = 48) -> Column:
    """max(full, min(last, now - 48 h)); without a last run the full window."""
    return F.when(last.isNull(), full).otherwise(F.greatest(full, F.least(last, now - F.expr(f"INTERVAL {hours} HOURS"))))


def tolerant_date(text: Column) -> Column:
    """the first ten characters as a date, or null."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def as_utc(naive: Column) -> Column:
    """a time without a zone is UTC."""
    return F.to_utc_timestamp(naive.cast("timestamp"), "UTC")


def duration_seconds(started: Column, finished: Column, now: Column) -> Column:
    """a run that goes on lasts until now."""
    return F.unix_timestamp(F.coalesce(finished, now)) - F.unix_timestamp(started)


def age_bucket(created: Column, today: Column, days: int = 90) -> Column:
    """F47."""
    return F.when(created.isNull(), "unknown").when(F.datediff(today, created) <= days, "new").otherwise("established")


def jitter(key: Column) -> Column:
    """a fixed fraction in [0, 1) of a key."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def expires_at(fetched: Column, ttl_hours: Column, key: Column, spread: float = 0.25) -> Column:
    """Null ttl never expires; others expire up to a spread later, by key."""
    return F.when(ttl_hours.isNotNull(), F.timestamp_seconds(F.unix_timestamp(fetched) + ttl_hours * 3600 * (1 + spread * jitter(key))))


def first_covered_day(start: Column) -> Column:
    """the day after an exclusive start."""
    return F.date_add(start, 1)


def projected_count(count: Column, span_days: Column, window_days: float, least_span: float = 1 / 24) -> Column:
    """the count itself if it spans nine tenths of the window, else in proportion, rounded half to even; null without any."""
    rate = F.rint(count / F.greatest(span_days, F.lit(least_span)) * window_days)
    return F.when(count == 0, None).when(span_days >= 0.9 * window_days, count).otherwise(rate).cast("long")
