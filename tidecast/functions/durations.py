"""Durations and instants given as text."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

#: Microseconds of each unit's name; fixed values.
UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "sec": 1_000_000, "min": 60_000_000, "m": 60_000_000, "h": 3_600_000_000, "hour": 3_600_000_000, "d": 86_400_000_000, "day": 86_400_000_000, "w": 604_800_000_000, "week": 604_800_000_000}

PART = re.compile(r"\s*([+-]?\d+(?:\.\d*)?|[+-]?\.\d+)?\s*([A-Za-z]+)")


def micros(value: str | int | float | timedelta) -> int:
    """Microseconds of a duration: a timedelta, a whole number of them, or text like ``1d``, ``20 min`` or ``1 d 12 h``."""
    if isinstance(value, timedelta):
        return (value.days * 86_400 + value.seconds) * 1_000_000 + value.microseconds
    if isinstance(value, bool):
        raise ValueError(f"not a duration: {value!r}")
    if isinstance(value, int | float):
        return round(value)
    total, at = 0.0, 0
    while at < len(value.rstrip()):
        m = PART.match(value, at)
        unit = m and (m[2].lower() if m[2].lower() in UNITS else m[2].lower().removesuffix("s"))
        if not m or unit not in UNITS:
            raise ValueError(f"not a duration: {value!r}")
        total += float(m[1] or 1) * UNITS[unit]
        at = m.end()
    if not at:
        raise ValueError("an empty duration")
    return round(total)


def instant(value: str | datetime) -> datetime:
    """A naive timestamp from ISO text or as it is; such with a time zone are refused."""
    out = value if isinstance(value, datetime) else datetime.fromisoformat(value.strip())
    if out.tzinfo is not None:
        raise NotImplementedError("timestamps with a time zone")
    return out
