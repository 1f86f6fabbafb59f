"""Checks of a history before a fit: one aggregate for all that looks at rows, the schema for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.functions.columns import diff_us, with_stats
from tidecast.functions.durations import micros
from tidecast.operators.order import in_order
from tidecast.plans.errors import ValidationError

#: Names that results use, with their bounds; features must not have them. Fixed values.
RESERVED = frozenset(f"{n}{s}" for n in ("yhat", "yhat_linked", "observed", "trend", "trend_linked", "fit") for s in ("", "_lower", "_upper")) | {"ds_int", "dtype_kind", "cutoff", "is_history"}
#: Names of parameters and of working columns, closed to columns of the data that a model uses.
WORKING = frozenset("t x t0 eta eta_lo eta_hi eta_trend dev_lo dev_hi capacity_fixed k m delta changepoints beta kappa phi linked_offset linked_scale y_mean variance_bound t_max n_obs objective steps draws".split())
COUNTS = ("poisson", "negative binomial", "binomial", "beta-binomial")


def check_name(name: str, taken: Sequence[str] = (), reserved: Sequence[str] = ()) -> str:
    """A feature's name: text without the delimiter, neither reserved nor in use for another kind."""
    if not isinstance(name, str):
        raise TypeError("names are text")
    if not name or "__delim__" in name:
        raise ValueError(f"{name!r} is empty or has the delimiter in it")
    if name in RESERVED or name in WORKING or name in reserved:
        raise ValueError(f"{name!r} is reserved")
    if name in taken:
        raise ValueError(f"{name!r} is in use for another kind of feature")
    return name


def check_schema(df: DataFrame, ts: str, metric: str | None, family: str = "normal", capacity: str | None = None, externals: Sequence[str] = ()) -> None:
    """Columns are there and of the types that the family needs."""
    kinds = {f.name: f.dataType for f in df.schema}
    for c in (ts, metric, capacity, *externals):
        if c and c not in kinds:
            raise KeyError(f"no column {c!r}")
    if isinstance(kinds[ts], T.TimestampType):
        raise NotImplementedError("timestamps with a time zone: cast to timestamp_ntz")
    if not isinstance(kinds[ts], T.TimestampNTZType):
        raise TypeError(f"{ts!r} is no timestamp")
    if metric:
        if not isinstance(kinds[metric], T.NumericType | T.BooleanType):
            raise TypeError(f"{metric!r} is not numeric")
        if family in COUNTS and not isinstance(kinds[metric], T.IntegralType | T.BooleanType):
            raise TypeError(f"{family} needs whole numbers in {metric!r}")
        if family == "beta" and not isinstance(kinds[metric], T.FractionalType):
            raise TypeError(f"beta needs fractions in {metric!r}")
    for c in externals:
        if not isinstance(kinds[c], T.NumericType | T.BooleanType):
            raise TypeError(f"{c!r} is not numeric")


def validation_report(df: DataFrame, ts: str, metric: str, step: str | int, keys: Sequence[str] = (), capacity: str | None = None, externals: Sequence[str] = ()) -> DataFrame:
    """One row per series: n_rows, null_ts, null_metric, null_capacity, null_externals, duplicate_ts, off_grid, over_capacity, negative."""
    placed = with_stats(df, keys, _origin=F.min(ts)).withColumn("_us", diff_us(F.col("_origin"), F.col(ts)))
    null_any = F.lit(False)
    for c in externals:
        null_any = null_any | F.col(c).isNull()
    return placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(ts).isNull()).alias("null_ts"),
        F.count_if(F.col(metric).isNull()).alias("null_metric"),
        F.count_if(F.col(capacity).isNull() if capacity else F.lit(False)).alias("null_capacity"),
        F.count_if(null_any).alias("null_externals"),
        (F.count(ts) - F.countDistinct(ts)).alias("duplicate_ts"),
        F.count_if(F.col("_us") % F.lit(micros(step)) != 0).alias("off_grid"),
        F.count_if(F.col(capacity) < F.col(metric) if capacity else F.lit(False)).alias("over_capacity"),
        F.count_if(F.col(metric).cast("double") < 0).alias("negative"),
    )


def check_rows(report: DataFrame, family: str = "normal") -> None:
    """Raise for the first series of a report that a fit would refuse."""
    bad = (F.col("n_rows") < 2) | (F.col("null_ts") + F.col("null_metric") + F.col("null_capacity") + F.col("null_externals") + F.col("off_grid") + F.col("over_capacity") > 0)
    if family in COUNTS:
        bad = bad | (F.col("negative") > 0)
    found = report.where(bad).limit(1).collect()
    if found:
        raise ValidationError(f"history not fit for use: {found[0].asDict()}")


def capacity_violations(df: DataFrame, metric: str, capacity: str) -> DataFrame:
    return df.where(F.col(capacity) < F.col(metric))


def period_starts(df: DataFrame, ts: str, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """The first row of each series whose calendar unit differs from the row before: year, quarter, month, week or day."""
    value = {"year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": lambda c: F.to_date(c)}[unit](F.col(ts))
    seen = df.select(*keys, ts, value.alias("_u"))
    seen = seen.withColumn("_before", F.lag("_u").over(Window.partitionBy(*keys).orderBy(ts))) if keys else in_order(seen, ts, None, {"_before": "_u"})
    return seen.where("_before IS NOT NULL AND _before <> _u").groupBy(*keys).agg(F.min(ts).alias(ts))
