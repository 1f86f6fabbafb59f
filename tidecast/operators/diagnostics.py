"""Rolling-origin cross-validation with folds in parallel, accuracy by horizon, dispersion, anomalies and components."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.columns import add_us, diff_us, dot, ntz
from tidecast.functions.durations import micros
from tidecast.functions.quantiles import exact_quantiles
from tidecast.functions.storage import cut
from tidecast.operators import features as feats
from tidecast.operators.fit import FittedModel, bounds, fit_series, key_schema, prepare, seed_of, series_of, with_inner_keys
from tidecast.operators.predict import score_series
from tidecast.plans.spec import ModelSpec

log = logging.getLogger(__name__)

#: The floor of denominators in relative errors: the spacing of doubles at one. A fixed value.
FLOOR = 2.220446049250313e-16
METRICS = ("mse", "rmse", "mae", "mape", "smape", "mdape", "smdape", "coverage")


def cutoffs(start: datetime, end: datetime, step: str | int, horizon: str | int, initial: str | int, period: str | int) -> list[datetime]:
    """Fold ends counted back from the last one that leaves a whole horizon, ascending."""
    step, horizon, initial, period = map(micros, (step, horizon, initial, period))
    us = lambda n: timedelta(microseconds=n)
    last, first = end - us(horizon), start + us(initial - step)
    if last < first:
        raise ValueError("the history is too short for this initial span and horizon")
    many = (last - first + us(step)) // us(period)
    return [last - i * us(period) for i in range(many, -1, -1)]


def cutoff_frame(df: DataFrame, ts: str, step: str | int, horizon: str | int, initial: str | int, period: str | int, keys: Sequence[str] = ()) -> DataFrame:
    """The same by series, as rows; series that are too short have none."""
    step, horizon, initial, period = map(micros, (step, horizon, initial, period))
    span = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    room = diff_us(F.col("_lo"), F.col("_hi")) - F.lit(horizon + initial - step)
    many = F.floor((room + F.lit(step)) / F.lit(period)).cast("long")
    back = span.where(room >= 0).select(*keys, "_hi", F.explode(F.sequence(F.lit(0).cast("long"), many)).alias("_i"))
    return back.select(*keys, add_us(-F.col("_i") * F.lit(period) - F.lit(horizon), F.col("_hi")).alias("cutoff"))


def folds(df: DataFrame, ends: DataFrame, ts: str, horizon: str | int, keys: Sequence[str] = ()) -> DataFrame:
    """Every row once per fold that trains on it or tests it: cutoff, is_train. ``ends`` is small: a row per fold."""
    within = F.col(ts) <= add_us(F.lit(micros(horizon)), F.col("cutoff"))
    if keys:
        joined = df.join(ends, list(keys)).where(within)
    else:
        each = [ntz(r["cutoff"]) for r in ends.select("cutoff").collect()]
        joined = df.withColumn("cutoff", F.explode(F.array(*each))).where(within)
    return joined.withColumn("is_train", F.col(ts) <= F.col("cutoff"))


def cross_validation(model: FittedModel, history: DataFrame, horizon: str | int, period: str | int | None = None, initial: str | int | None = None, cuts: Sequence[datetime] | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """Refit on each fold and forecast its horizon: keys, ds, yhat and observed with their bounds, metric, cutoff.

    ``extra`` names numeric columns of the history that go along. A Laplace model draws in each fold too.

    All folds of all series are groups of one shuffle. Period defaults to half the horizon, initial to three horizons or
    the longest seasonality. A fold keeps the events of the fitted model and its changepoints up to the cutoff.
    """
    spec, keys, ts = model.spec, model.spec.inner_keys, model.spec.timestamp_name
    horizon_us = micros(horizon)
    longest = max((s.period_us for s in spec.seasonalities), default=0)
    initial_us = micros(initial) if initial is not None else max(3 * horizon_us, longest)
    period_us = micros(period) if period is not None else horizon_us // 2
    if initial_us < 2 * longest:
        log.warning("the initial span is under two of the longest seasonality")
    plain = history
    history = with_inner_keys(plain, spec)
    lo, hi = bounds(history, ts)
    if cuts is not None:
        if min(cuts) <= lo or max(cuts) > hi - timedelta(microseconds=horizon_us):
            raise ValueError("cutoffs must lie within the history and leave a horizon")
        ends = history.sparkSession.createDataFrame([(c,) for c in cuts], "cutoff timestamp_ntz")
        if keys:
            ends = history.select(*keys).distinct().withColumn("cutoff", F.explode(F.array(*[ntz(c) for c in cuts])))
    else:
        if not keys:
            cutoffs(lo, hi, spec.step_us, horizon_us, initial_us, period_us)
        ends = cutoff_frame(history, ts, spec.step_us, horizon_us, initial_us, period_us, keys)
    fold_spec = replace(spec, events=tuple(replace(e, include=True) for e in spec.events))
    settled, rows, lo, hi = prepare(plain, fold_spec, model.options)
    scales = [f.prior_scale for f in feats.features(settled, F.col("t"), F.col("ds"), lo, hi)]
    known = model.params.select(*keys, F.col("changepoints").alias("_cps"))
    rows = rows.join(known, keys) if keys else rows.join(F.broadcast(known), how="inner", on=F.lit(True))
    mode, step, laplace, draws = model.options["optimize_mode"], spec.step_us, model.options["use_laplace"], model.options.get("draws", 1000)
    if extra:
        more = plain.select(*(F.col(k).alias(i) for k, i in zip(spec.keys, keys, strict=True)), F.col(ts).alias("ds"), *(F.col(c).cast("double").alias(f"_extra_{c}") for c in extra))
        rows = rows.join(more, [*keys, "ds"])
    made = ["yhat", "yhat_lower", "yhat_upper", "observed_lower", "observed_upper"]

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        train, test = g[g["is_train"]], g[~g["is_train"]].sort_values("t")
        if len(train) < 2 or not len(test):
            return pd.DataFrame({c: [] for c in [*keys, "ds", *made, "y", *(f"_extra_{c}" for c in extra), "cutoff"]})
        last = int((g["cutoff"].iloc[0] - g["t0"].iloc[0]) // pd.Timedelta(1, "us")) // step
        cps = np.array([c for c in g["_cps"].iloc[0] if c <= last], np.int64)
        p = fit_series(series_of(train, settled, cps), settled, scales, mode, laplace, draws, seed_of(key, spec.seed))
        out = score_series(p, settled, test["t"].to_numpy(float).astype(np.int64), np.stack(test["x"].to_numpy()).astype(float).reshape(len(test), -1), test["capacity"].to_numpy(float), key[: len(keys)])
        out = out.assign(ds=test["ds"].to_numpy(), y=test["y"].to_numpy(), **{f"_extra_{c}": test[f"_extra_{c}"].to_numpy() for c in extra}, cutoff=g["cutoff"].iloc[0])
        return out.assign(**dict(zip(keys, key, strict=False)))

    schema = f"{key_schema(rows, keys)}ds timestamp_ntz, {', '.join(f'{c} double' for c in made)}, y double, {''.join(f'`_extra_{c}` double, ' for c in extra)}cutoff timestamp_ntz"
    done = folds(rows, ends, "ds", horizon_us, keys).groupBy(*keys, "cutoff").applyInPandas(run, schema)
    return done.withColumnsRenamed({"ds": ts, "y": spec.metric_name, **{f"_extra_{c}": c for c in extra}, **dict(zip(keys, spec.keys, strict=True))})


def errors(y: Column, yhat: Column) -> tuple[Column, Column, Column]:
    """The error, and its size relative to the metric and to the mean of metric and forecast."""
    err = (y - yhat).cast("double")
    return err, F.abs(err) / F.greatest(F.abs(y), F.lit(FLOOR)), 2 * F.abs(err) / F.greatest(F.abs(y) + F.abs(yhat), F.lit(FLOOR))


def metric_columns(y: Column, yhat: Column, lower: Column, upper: Column) -> dict[str, Column]:
    """Metrics that are one aggregate; the medians are not."""
    err, ape, sape = errors(y, yhat)
    return {
        "mse": F.avg(err * err), "rmse": F.sqrt(F.avg(err * err)), "mae": F.avg(F.abs(err)), "mape": F.avg(ape), "smape": F.avg(sape),
        "coverage": F.avg(((y >= lower) & (y <= upper)).cast("double")),
    }


def performance_metrics(cv: DataFrame, window: str | int, metrics: Sequence[str] | None = None, ts: str = "ds", y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """Count and metrics by horizon bin: one aggregate, and exact medians in bounded state. Unknown metrics are left out with a warning; order is as asked."""
    asked = list(dict.fromkeys(metrics if metrics is not None else METRICS))
    for m in asked:
        if m not in METRICS:
            log.warning("no metric %s", m)
    asked = [m for m in asked if m in METRICS]
    made = metric_columns(F.col(y), F.col("yhat"), F.col("observed_lower"), F.col("observed_upper"))
    size = micros(window)
    binned = cv.withColumn("horizon_us", (F.ceil(diff_us(F.col("cutoff"), F.col(ts)) / F.lit(size)) * F.lit(size)).cast("long"))
    groups = [*keys, "horizon_us"]
    _, ape, sape = errors(F.col(y), F.col("yhat"))
    medians = {m: e for m, e in (("mdape", ape), ("smdape", sape)) if m in asked}
    if medians:
        binned = cut(binned)  # the aggregate and the rounds of the medians read it
    out = binned.groupBy(*groups).agg(F.count(F.lit(1)).alias("count"), *(made[m].alias(m) for m in asked if m in made))
    if medians:
        long = binned.select(*groups, F.explode(F.array(*(F.struct(F.lit(m).alias("_m"), e.alias("_e")) for m, e in medians.items()))).alias("_v")).select(*groups, "_v._m", "_v._e")
        found = exact_quantiles(long, "_e", {"_median": 0.5}, [*groups, "_m"])
        wide = found.groupBy(*(F.col(g).alias(f"_{g}") for g in groups)).agg(*(F.max(F.when(F.col("_m") == m, F.col("_median"))).alias(m) for m in medians))
        same = [out[g].eqNullSafe(wide[f"_{g}"]) for g in groups]
        out = out.join(wide, same).drop(*(f"_{g}" for g in groups))
    return out.select(*groups, "count", *asked)


def dispersion(df: DataFrame, y: str, yhat: str, dof: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """alpha, near one for Poisson counts, below for binomial and above for negative binomial ones; phi = mean(yhat/(alpha-1))."""
    e = F.col(y) - F.col(yhat)
    out = df.groupBy(*keys).agg((F.sum(e * e / F.col(yhat)) / (F.count(F.lit(1)) - dof)).alias("alpha"), F.avg(yhat).alias("_mean"))
    return out.select(*keys, "alpha", F.try_divide(F.col("_mean"), F.col("alpha") - 1).alias("phi"))


def variance_bound(df: DataFrame, residual: Column, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg((1.5 * F.var_pop(residual)).alias("variance_bound"))


def anomalies(forecast: DataFrame, history: DataFrame, ts: str = "ds", y: str = "y", keys: Sequence[str] = ()) -> DataFrame:
    """History rows beyond the observed bounds."""
    joined = history.select(*keys, ts, y).join(forecast.select(*keys, ts, "yhat", "observed_lower", "observed_upper"), [*keys, ts])
    return joined.where((F.col("observed_upper") < F.col(y)) | (F.col("observed_lower") > F.col(y)))


def _outer(spec: ModelSpec) -> list[Column]:
    return [F.col(i).alias(k) for k, i in zip(spec.keys, spec.inner_keys, strict=True)]


def components(model: FittedModel, data: DataFrame) -> DataFrame:
    """keys, ds and a column per term: the sum of its features times their coefficients, on the normalised linked scale."""
    from tidecast.operators.grid import steps_between

    spec, keys, ts = model.spec, model.spec.inner_keys, model.spec.timestamp_name
    data = with_inner_keys(data, spec)

    lo, hi = bounds(data, ts)
    params = model.params.select(*keys, "t0", "beta")
    grid = data.join(params, keys) if keys else data.join(F.broadcast(params), how="inner", on=F.lit(True))
    grid = grid.withColumn("t", steps_between(F.col("t0"), F.col(ts), spec.step_us))
    grid = feats.with_anchored(grid, spec)
    made = feats.features(spec, F.col("t"), F.col(ts), lo, hi)
    parts: dict[str, list[tuple[int, Column]]] = {}
    for i, f in enumerate(made):
        parts.setdefault(f.part, []).append((i, f.column))
    sums = {part: dot(F.array(*[c for _, c in xs]), F.array(*[F.col("beta")[i] for i, _ in xs])) for part, xs in parts.items()}
    return grid.select(*_outer(spec), ts, *(c.alias(n) for n, c in sums.items()))


def one_period(df: DataFrame, ts: str, start: DataFrame, rows: int, keys: Sequence[str] = ()) -> DataFrame:
    """The first ``rows`` rows of each series from its period start (column of the same name) on."""
    first = start.withColumnRenamed(ts, "_start")
    joined = df.join(first, list(keys)) if keys else df.join(F.broadcast(first), how="inner", on=F.lit(True))
    ranked = joined.where(F.col(ts) >= F.col("_start")).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(ts)))
    return ranked.where(F.col("_n") <= rows).drop("_n", "_start")


def changepoint_markers(model: FittedModel) -> DataFrame:
    """keys, ds, delta of each changepoint."""
    spec = model.spec
    each = model.params.select(*_outer(spec), "t0", F.explode(F.arrays_zip("changepoints", "delta")).alias("c"))
    return each.select(*spec.keys, add_us(F.col("c.changepoints") * F.lit(spec.step_us), F.col("t0")).alias("ds"), F.col("c.delta").alias("delta"))


def capacity_line(model: FittedModel, data: DataFrame) -> DataFrame:
    """keys, ds and the capacity that the forecast of each row cannot exceed: the row's own, or the series' settled one."""
    spec, keys, ts = model.spec, model.spec.inner_keys, model.spec.timestamp_name
    if spec.model not in ("binomial", "beta-binomial"):
        raise ValueError(f"a {spec.model} model has no capacity")
    rows = with_inner_keys(data, spec)
    if spec.capacity_name:
        return rows.select(*_outer(spec), ts, F.col(spec.capacity_name).cast("double").alias("capacity"))
    settled = model.params.select(*keys, F.col("capacity_fixed").alias("capacity"))
    joined = rows.join(settled, keys) if keys else rows.join(F.broadcast(settled), how="inner", on=F.lit(True))  # one row
    return joined.select(*_outer(spec), ts, "capacity")
