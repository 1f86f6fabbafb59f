"""Column expressions shared by the operators; all stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ntz(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def diff_us(start: Column, end: Column) -> Column:
    """Microseconds from start to end."""
    return F.timestamp_diff("MICROSECOND", start, end)


def add_us(us: Column, at: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, at)


def day(ts: Column) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


#: Link functions and their inverses by name.
LINKS = {"identity": (lambda x: x, lambda x: x), "log": (F.ln, F.exp), "logit": (logit, expit)}


def dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def fourier(t: Column, period: float, n: int, part: str) -> Column:
    angle = F.lit(2 * math.pi * n / period) * t
    return F.sin(angle) if part == "sin" else F.cos(angle)


def with_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """The rows with aggregates of their series. Without keys the aggregates are one row, read as literals."""
    named = [c.alias(n) for n, c in stats.items()]
    if keys:
        return df.join(df.groupBy(*keys).agg(*named), list(keys))
    out = df.agg(*named)
    row = out.first()
    kinds = {f.name: f.dataType for f in out.schema}
    lit = lambda v: F.lit(None) if v is None else ntz(v) if isinstance(v, datetime) else F.lit(v)
    return df.withColumns({n: lit(row[n]).cast(kinds[n]) for n in stats})
