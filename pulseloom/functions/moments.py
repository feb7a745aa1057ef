"""Times: lenient parsing against an explicit clock, ages, display."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Seconds of each unit of a relative age (months are 30 days, years 365).
UNIT_SECONDS = {
    "second": 1, "s": 1,
    "minute": 60, "m": 60,
    "hour": 3600, "h": 3600,
    "day": 86400, "d": 86400,
    "week": 604800, "w": 604800,
    "month": 2592000, "mo": 2592000,
    "year": 31536000, "y": 31536000, "yr": 31536000,
}
# moments that can be shown: from year 1 to year 9999
EARLIEST_MICROS = -62135596800 * 1000000
LATEST_SECONDS = 62135596800
# Fixed value: pattern of a relative age.
AGO = r"(?U)(\d+)\s*(second|minute|hour|day|week|month|year|mo|d|h|m|s|y|yr)s?\s+ago"


def from_relative(text: Column, as_of: Column) -> Column:
    """``3 weeks ago`` as a moment before ``as_of``; null when the text holds no relative age."""
    low = F.lower(text)
    amount = F.regexp_extract(low, AGO, 1).try_cast("bigint")
    unit = F.regexp_extract(low, AGO, 2)
    seconds = F.lit(None).cast("bigint")
    for name, value in UNIT_SECONDS.items():
        seconds = F.when(unit == name, F.lit(value).cast("bigint")).otherwise(seconds)
    micros = F.try_subtract(F.unix_micros(as_of), F.try_multiply(F.try_multiply(amount, seconds), F.lit(1000000).cast("bigint")))
    return F.when(micros >= EARLIEST_MICROS, F.timestamp_micros(micros))


def from_iso(text: Column) -> Column:
    """ISO date or date-time; without an offset it is UTC. Null when it is not ISO."""
    t = F.upper(F.trim(text))
    dated = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00Z")))
    zoned = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ].*([+-]\d{2}:?\d{2}|Z)$"), t)
    naive = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.concat(t, F.lit("Z")))
    return F.try_to_timestamp(F.coalesce(dated, zoned, naive))


def from_epoch_seconds(seconds: Column, as_of: Column) -> Column:
    """Zero counts as missing, and so does what no calendar holds."""
    valid = (seconds != 0) & F.abs(seconds.cast("double")).between(0, LATEST_SECONDS)
    return F.coalesce(F.when(valid, F.timestamp_seconds(seconds)), as_of)


def parse_moment(text: Column, as_of: Column) -> Column:
    """Relative age, else ISO, else the clock itself."""
    return F.coalesce(from_relative(text, as_of), from_iso(text), as_of)


def age_days(created: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(created)) / F.lit(86400e6))


def age_hours(created: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(created)) / F.lit(3600e6)


def display_millis(epoch_ms: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.timestamp_millis(epoch_ms), pattern)


def duration_seconds(text: Column) -> Column:
    """``h:mm:ss`` or ``m:ss`` in seconds; null when it has another form."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("bigint"))
    return F.when(text.rlike(r"^\d+(:\d{1,2}){0,2}$"),
                  F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 60 + p))
