"""Changepoints and piecewise linear trends as DataFrame operations; families' scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.columns import LINKS, dot, with_stats
from tidecast.operators.order import in_order


def auto_changepoints(df: DataFrame, ts: str, n: int = 25, share: float = 0.8, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of each series that are changepoints: spread evenly over the first ``share`` of its rows, not the first one.

    With fewer rows than asked for, one less than there are rows. Positions are rounded half to even.
    """
    ranked = df.select(*keys, ts)
    ranked = ranked.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(ts)) - 1) if keys else in_order(ranked, ts, "_i")
    sized = with_stats(ranked, keys, _rows=F.count(F.lit(1)))
    rows = F.floor(F.col("_rows") * share).cast("long")
    many = F.when(F.lit(n + 1) > rows, F.greatest(rows - 1, F.lit(0))).otherwise(F.lit(n))
    places = sized.groupBy(*keys).agg(F.max("_rows").alias("_rows")).select(*keys, rows.alias("_h"), many.alias("_n")).where("_n > 0")
    step = F.bround(F.col("_j") * (F.col("_h") - 1) / F.col("_n"), 0).cast("long")
    wanted = places.select(*keys, "_h", "_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n").cast("long"))).alias("_j")).select(*keys, step.alias("_i"), F.col("_j").alias("changepoint_no"))
    return ranked.join(wanted, [*keys, "_i"]).select(*keys, "changepoint_no", ts)


def trend(t: Column, k: Column, m: Column, changepoints: Column, delta: Column) -> Column:
    """Piecewise linear: slope k and offset m at zero, and from each changepoint on a slope more."""
    bends = F.aggregate(F.zip_with(changepoints, delta, lambda c, d: d * F.greatest(t - c, F.lit(0))), F.lit(0.0), lambda acc, v: acc + v)
    return k * t + m + bends


def linear_predictor(trend_value: Column, x: Column, beta: Column, offset: Column, scale: Column) -> Column:
    return offset + scale * (trend_value + dot(x, beta))


def to_linked(y: Column, link: str, capacity: Column | None = None, lower: bool = False, upper: bool = False) -> Column:
    """The metric on the link's scale; exact bounds and empty capacities give way by 1e-10."""
    eps = 1e-10
    v = y.cast("double")
    if capacity is not None:
        v = v / F.when(capacity == 0, eps).otherwise(capacity)
    if lower:
        v = F.when(v == 0, eps).otherwise(v)
    if upper:
        v = F.when(v == 1, 1 - eps).otherwise(v)
    return LINKS[link][0](v)


def normalize(df: DataFrame, value: Column, keys: Sequence[str] = (), out: str = "scaled") -> DataFrame:
    """Min-max scaled value with the series' linked_offset and linked_scale (one where all values are equal)."""
    stats = with_stats(df.withColumn("_v", value), keys, linked_offset=F.min("_v"), _hi=F.max("_v"))
    spread = F.col("_hi") - F.col("linked_offset")
    return stats.withColumn("linked_scale", F.when(spread > 0, spread).otherwise(1.0)).withColumn(out, (F.col("_v") - F.col("linked_offset")) / F.col("linked_scale")).drop("_v", "_hi")


def line_fit(df: DataFrame, t: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of each series: slope, intercept."""
    return df.groupBy(*keys).agg(F.regr_slope(y, t).alias("slope"), F.regr_intercept(y, t).alias("intercept"))


def estimate_capacity(df: DataFrame, y: str, mode: str, value: float, keys: Sequence[str] = ()) -> DataFrame:
    """Capacity of each series: ``constant`` value, ``factor`` times the largest metric, or by ``scale``, the factor f >= 1
    for which metric / (f max) is closest to ``value`` in the least-squares sense, in closed form."""
    top = F.max(y)
    if mode == "constant":
        if value != int(value):
            raise ValueError("a constant capacity is a whole number")
        out = F.when(top <= value, F.lit(int(value))).otherwise(F.raise_error(F.lit("the metric exceeds the capacity")))
    elif mode == "factor":
        if value < 1:
            raise ValueError("a capacity factor is at least 1")
        out = F.ceil(top * value)
    elif mode == "scale":
        if not 0 < value < 1:
            raise ValueError("a capacity scale lies between 0 and 1")
        factor = F.try_divide(F.sum(F.col(y).cast("double") * F.col(y)), F.lit(value) * top * F.sum(y))
        out = F.ceil(F.greatest(F.coalesce(factor, F.lit(1.0)), F.lit(1.0)) * top)
    else:
        raise ValueError(f"no capacity mode {mode!r}")
    return df.groupBy(*keys).agg(out.cast("long").alias("capacity"))
