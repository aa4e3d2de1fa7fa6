"""Time buckets, interval literals and ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidInterval

# fixed values: the spellings of each unit, and its milliseconds
_UNITS = {
    1: ("ms", "millisecond", "milliseconds"),
    1_000: ("s", "sec", "second", "seconds"),
    60_000: ("m", "min", "minute", "minutes"),
    3_600_000: ("h", "hr", "hour", "hours"),
    86_400_000: ("d", "day", "days"),
}
_MS = {name: ms for ms, names in _UNITS.items() for name in names}
RANGES = {"1h": 3_600_000, "6h": 21_600_000, "24h": 86_400_000, "7d": 604_800_000, "30d": 2_592_000_000, "all": None}
_AUTO = ((3_600_000, "1 minute"), (21_600_000, "5 minutes"), (86_400_000, "15 minutes"), (604_800_000, "1 hour"))


def parse_interval(text: str) -> int:
    """Milliseconds of '<count> <unit>'; the count must be positive."""
    parts = text.split()
    if len(parts) != 2 or not re.fullmatch(r"[+-]?\d+", parts[0]):
        raise InvalidInterval(text)
    unit = _MS.get(parts[1].lower())
    if unit is None or int(parts[0]) <= 0:
        raise InvalidInterval(text)
    return int(parts[0]) * unit


def as_time(column: Column) -> Column:
    """A timestamp column in session time, from a timestamp with or without zone."""
    return column.cast("timestamp")


def to_ms(column: Column) -> Column:
    return F.unix_millis(as_time(column))


def bucket_ms(ms: Column, width: int) -> Column:
    """The start of the bucket of an epoch-millisecond column; buckets are floored, also before 1970."""
    return ms - F.pmod(ms, F.lit(width).cast("long"))


def time_bucket(interval: str | int, column: Column) -> Column:
    """The start of the bucket that a time falls into; null for null."""
    width = parse_interval(interval) if isinstance(interval, str) else interval
    if width <= 0:
        raise InvalidInterval(str(interval))
    return F.timestamp_millis(bucket_ms(to_ms(column), width))


def auto_bucket(duration_ms: int | None) -> str:
    """The bucket width that suits a range of this length."""
    if duration_ms is None:
        return "5 minutes"
    return next((width for limit, width in _AUTO if duration_ms <= limit), "6 hours")


def range_start(preset: str, now_ms: int) -> int | None:
    """The first millisecond of a preset range; None for all time."""
    if preset not in RANGES:
        raise InvalidInterval(preset)
    width = RANGES[preset]
    return None if width is None else now_ms - width


def preset_bucket(preset: str) -> str:
    width = RANGES.get(preset)
    return auto_bucket(width)


def parse_bucket(short: str) -> str:
    """'5m' as '5 m'."""
    m = re.fullmatch(r"(\d+)([a-z]+)", short)
    if not m:
        raise InvalidInterval(short)
    parse_interval(f"{m[1]} {m[2]}")
    return f"{m[1]} {m[2]}"
