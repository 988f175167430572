"""Time in integer nanoseconds: durations, buckets, shards."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND
DEFAULT_STEP = MINUTE
_UNITS = {"ns": 1, "us": 1000, "ms": 1_000_000, "s": SECOND, "m": MINUTE, "h": HOUR, "d": DAY}


def duration_ns(value: int | str | timedelta) -> int:
    """Nanoseconds of an int (already ns), a timedelta, or a text such as '1h30m' or '250ms'."""
    if isinstance(value, timedelta):
        return (value.days * 86_400 + value.seconds) * SECOND + value.microseconds * 1000
    if isinstance(value, int):
        return value
    parts = re.findall(r"(\d+)(ns|us|ms|s|m|h|d)", value)
    if not parts or "".join(n + u for n, u in parts) != value:
        raise ValueError(f"not a duration: {value!r}")
    return sum(int(n) * _UNITS[u] for n, u in parts)


def step_ns(value: int | str | timedelta | None) -> int:
    """A query step; missing or not positive means a minute."""
    step = DEFAULT_STEP if value is None else duration_ns(value)
    return step if step > 0 else DEFAULT_STEP


def bucket(ts: Column, step: int) -> Column:
    """Start of the bucket of ts. The remainder truncates, so bucket 0 spans (-step, step)."""
    return ts - ts % F.lit(step)


def shard_number(ts: Column, window: int) -> Column:
    """The ordinal of a shard, 1 for the window that starts at 0."""
    return F.floor((ts - ts % F.lit(window)) / F.lit(window)).cast("long") + 1


def overlaps(start: Column, window: int, lo: int, hi: int) -> Column:
    """Whether the shard named start can hold a time in [lo, hi).

    Remainders truncate: a shard above 0 is [start, start + window), one below 0 is (start - window, start],
    and shard 0 is (-window, window).
    """
    above = (start > 0) & (start < F.lit(hi)) & (start > F.lit(lo - window))
    below = (start < 0) & (start >= F.lit(lo)) & (start < F.lit(hi + window))
    return above | below | (start == 0) & F.lit(lo < window and hi > -window)


def ntz_ns(ts: str) -> Column:
    """Nanoseconds since the epoch of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) * 1000")
