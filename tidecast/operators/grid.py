"""Regular time grids: resampling, integer time, sampling period, gaps and future rows. ``keys`` name the series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.columns import add_us, diff_us, with_stats
from tidecast.functions.durations import micros
from tidecast.functions.quantiles import exact_quantiles
from tidecast.operators.order import in_order


def resample(df: DataFrame, ts: str, unit: str, aggs: dict[str, Column], keys: Sequence[str] = (), out: str = "ds") -> DataFrame:
    """Aggregate by calendar unit (``day``, ``hour``, ``week``, ``month``, ...)."""
    return df.groupBy(*keys, F.date_trunc(unit, ts).cast("timestamp_ntz").alias(out)).agg(*(c.alias(n) for n, c in aggs.items()))


def resample_weeks(df: DataFrame, ts: str, aggs: dict[str, Column], keys: Sequence[str] = (), out: str = "ds") -> DataFrame:
    """Weeks that end on Sunday and are labelled by it."""
    sunday = F.timestamp_add("DAY", F.lit(6), F.date_trunc("week", ts).cast("timestamp_ntz"))
    return df.groupBy(*keys, sunday.alias(out)).agg(*(c.alias(n) for n, c in aggs.items()))


#: Units of a grid: microseconds of an even one, months of a calendar one. Fixed values.
EVEN = {"minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
MONTHS = {"month": 1, "quarter": 3, "year": 12}
#: Bins that one row makes at once.
RUN = 4096


def filled(binned: DataFrame, unit: str, keys: Sequence[str] = (), out: str = "ds", fill: float | dict[str, object] | None = 0) -> DataFrame:
    """The bins of ``resample`` or ``resample_weeks``, with those between a series' first and last that have no rows.

    Their aggregates are ``fill``, or what it says by column (null where it says nothing); keys may be null. The spine is made by
    runs of bins, so that no row holds a long series.
    """
    if unit not in EVEN | MONTHS:
        raise ValueError(f"no grid of unit {unit!r}")
    ends = binned.where(F.col(out).isNotNull()).groupBy(*keys).agg(F.min(out).alias("_lo"), F.max(out).alias("_hi")).where("_lo IS NOT NULL")
    months = lambda c: F.year(c) * 12 + F.month(c)
    steps = _div(diff_us(F.col("_lo"), F.col("_hi")), EVEN[unit]) if unit in EVEN else _div((months("_hi") - months("_lo")).cast("long"), MONTHS[unit])
    runs = ends.withColumn("_n", steps).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("_n"), RUN))))
    first = F.col("_run") * RUN
    each = runs.withColumn("_i", F.explode(F.sequence(first, F.least(F.col("_n"), first + RUN - 1))))
    at = add_us(F.col("_i") * EVEN[unit], F.col("_lo")) if unit in EVEN else F.timestamp_add("MONTH", (F.col("_i") * MONTHS[unit]).cast("int"), F.col("_lo"))
    spine = each.select(*(F.col(k).alias(f"_s_{k}") for k in keys), at.alias("_s"))
    joined = spine.join(binned.withColumn("_there", F.lit(True)), [F.col("_s") == binned[out], *(F.col(f"_s_{k}").eqNullSafe(binned[k]) for k in keys)], "left")
    values = [c for c in binned.columns if c not in (*keys, out)]
    given = {c: fill.get(c) if isinstance(fill, dict) else fill for c in values}
    kept = [F.when(F.col("_there"), F.col(c)).otherwise(F.lit(given[c]).cast(binned.schema[c].dataType)).alias(c) for c in values]
    return joined.select(*(F.col(f"_s_{k}").alias(k) for k in keys), F.col("_s").alias(out), *kept)


def steps_between(start: Column, end: Column, step: str | int) -> Column:
    """Whole steps from start to end, towards zero; 64-bit, so that long grids do not wrap."""
    return _div(diff_us(start, end), micros(step))


def _div(us: Column, size: int) -> Column:
    """Exact division of longs towards zero."""
    return F.call_function("div", us, F.lit(size))


def time_index(df: DataFrame, ts: str, step: str | int, keys: Sequence[str] = (), out: str = "t") -> DataFrame:
    """Integer time since each series' first row."""
    with_origin = with_stats(df, keys, _origin=F.min(ts))
    return with_origin.withColumn(out, steps_between(F.col("_origin"), F.col(ts), step)).drop("_origin")


def differences(df: DataFrame, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with ``diff_us``, the microseconds since the series' row before; null for its first."""
    if not keys:
        return in_order(df, ts, None, {"_before": ts}).withColumn("diff_us", diff_us(F.col("_before"), F.col(ts))).drop("_before")
    return df.withColumn("diff_us", diff_us(F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts)), F.col(ts)))


def sampling_period(df: DataFrame, ts: str, q: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """The q-quantile (linear between ranks) of successive differences, in microseconds, by series."""
    if not 0 <= q <= 1:
        raise ValueError("q must be within 0 and 1")
    return exact_quantiles(differences(df.select(*keys, ts), ts, keys), "diff_us", {"period_us": q}, keys)


def time_span(df: DataFrame, ts: str, keys: Sequence[str] = (), q: float = 0.3) -> DataFrame:
    """Last minus first timestamp plus one inferred period, in microseconds."""
    period = sampling_period(df, ts, q, keys)
    ends = df.groupBy(*keys).agg(diff_us(F.min(ts), F.max(ts)).alias("_ends"))
    both = ends.join(period, list(keys)) if keys else ends.join(F.broadcast(period), how="inner", on=F.lit(True))  # one row
    return both.select(*keys, (F.col("_ends") + F.col("period_us")).alias("span_us"))


def gaps(df: DataFrame, ts: str, step: str | int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows that follow a hole: how many grid points are missing before them."""
    missing = _div(F.col("diff_us"), micros(step)) - 1
    return differences(df, ts, keys).withColumn("missing", missing).where("missing > 0").drop("diff_us")


def future_frame(df: DataFrame, ts: str, step: str | int, periods: int = 1, include_history: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """``periods`` rows after each series' last one, after its own rows if asked for; is_history tells them apart."""
    if isinstance(periods, bool) or not isinstance(periods, int) or periods < 1:
        raise ValueError("periods must be a whole number of at least 1")
    last = df.groupBy(*keys).agg(F.max(ts).alias("_last")).where("_last IS NOT NULL")
    ahead = last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("_n"), "_last")
    future = ahead.select(*keys, add_us(F.col("_n").cast("long") * micros(step), F.col("_last")).alias(ts), F.lit(False).alias("is_history"))
    return df.select(*keys, ts, F.lit(True).alias("is_history")).unionByName(future) if include_history else future


def equidistant(df: DataFrame, ts: str, step: str | int, keys: Sequence[str] = (), out: str = "ds") -> DataFrame:
    """Put rows, in their order, on an even grid from the first row on; for calendar months of uneven length."""
    placed = with_stats(df, keys, _origin=F.min(ts))
    placed = placed.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1) if keys else in_order(placed, ts, "_n")
    return placed.withColumn(out, add_us((F.col("_n") * F.lit(micros(step))).cast("long"), F.col("_origin"))).drop("_n", "_origin")


def cast_kind(column: Column, kind: str) -> Column:
    """Cast by kind letter: b boolean, i and u long, f double; a negative u is an error, fractions are cut off."""
    types = {"b": "boolean", "i": "long", "u": "long", "f": "double"}
    if kind not in types:
        raise ValueError(f"no kind {kind!r}; there are b, i, u and f")
    out = column.cast(types[kind])
    return F.when(out < 0, F.raise_error(F.lit("a negative value for an unsigned kind"))).otherwise(out) if kind == "u" else out
