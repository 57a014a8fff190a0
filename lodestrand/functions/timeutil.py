"""Durations, date literals and time precisions; keys are nanoseconds since 1970."""

from __future__ import annotations

import datetime as dt
import re
import time

# Nanoseconds of each unit (a year has 365 days, a week 7).
UNIT_NS = {"y": 31_536_000_000_000_000, "w": 604_800_000_000_000, "d": 86_400_000_000_000, "h": 3_600_000_000_000, "m": 60_000_000_000, "s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}
PRECISION_NS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "minute": 60_000_000_000, "hour": 3_600_000_000_000, "day": 86_400_000_000_000, "week": 604_800_000_000_000, "month": 2_592_000_000_000_000, "year": 31_536_000_000_000_000}
DURATION = re.compile(r"(\d+)(mo|ms|us|ns|y|w|d|h|m|s)", re.I)
DATE = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:[T ](\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?)?")


def duration_ns(text: str, base_ns: int = 0) -> int:
    """Sum of units such as 1mo2d3h; months are calendar months from base_ns."""
    parts = DURATION.findall(text)
    if "".join(n + u for n, u in parts).lower() != text.lower():
        raise ValueError(f"not a duration: {text}")
    total = 0
    for n, unit in parts:
        if unit.lower() == "mo":
            start = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=base_ns // 1000)
            months = start.year * 12 + start.month - 1 + int(n)
            day = min(start.day, (dt.date(months // 12 + (months % 12 + 1) // 13, (months + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day)
            end = start.replace(year=months // 12, month=months % 12 + 1, day=day)
            total += (end - start) // dt.timedelta(microseconds=1) * 1000
        else:
            total += int(n) * UNIT_NS[unit.lower()]
    return total


def date_ns(text: str) -> int:
    """A date literal with separator - / or . in UTC, with up to nine digits of a second."""
    m = DATE.fullmatch(text)
    if not m:
        raise ValueError(f"not a date: {text}")
    at = dt.datetime(int(m[1]), int(m[3]), int(m[4]), int(m[5] or 0), int(m[6] or 0), int(m[7] or 0), tzinfo=dt.timezone.utc)
    return int(at.timestamp()) * 1_000_000_000 + int((m[8] or "0").ljust(9, "0"))


def now_ns() -> int:
    """Wall clock in ns."""
    return time.time_ns()


def to_ns(value: int, precision: str = "ns") -> int:
    return value * PRECISION_NS[precision]
