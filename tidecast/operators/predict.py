"""Scoring: grid joined with parameters, and from there expressions; Python only for simulations and other quantiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions.columns import LINKS, dot
from tidecast.functions.special import normal_ppf
from tidecast.operators import features as feats
from tidecast.operators.families import FAMILIES, INVERSE
from tidecast.operators.fit import FittedModel, bounds, seed_of, with_inner_keys
from tidecast.operators.grid import future_frame, steps_between
from tidecast.operators.trend import trend
from tidecast.plans.config import given, settings
from tidecast.plans.errors import NotFittedError

BANDS = ("yhat", "yhat_linked", "trend", "trend_linked")


#: Steps of simulated trends that are held at once.
AHEAD = 2048


def deviations(steps: int, delta: np.ndarray, n_obs: int, width: float, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper deviation of the next ``steps`` of a trend whose slope changes as often and as much as the history's did."""
    low, high = np.zeros(steps), np.zeros(steps)
    if not samples or not len(delta):
        return low, high
    rng, size = np.random.default_rng(seed), np.mean(np.abs(delta)) or 1e-300
    slope = level = np.zeros((samples, 1))
    for at in range(0, steps, AHEAD):
        n = min(AHEAD, steps - at)
        change = np.where(rng.random((samples, n)) < len(delta) / n_obs, rng.laplace(0, size, (samples, n)), 0)
        slopes = slope + np.cumsum(change, axis=1)
        levels = level + np.cumsum(slopes, axis=1)
        low[at : at + n], high[at : at + n] = np.percentile(levels, [50 - 50 * width, 50 + 50 * width], axis=0)
        slope, level = slopes[:, -1:], levels[:, -1:]
    return low, high


def simulate_trend(t: np.ndarray, t_max: int, delta: np.ndarray, n_obs: int, width: float, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The deviations at the times t; zero up to the history's end."""
    out, future = np.zeros((2, len(t))), t > t_max
    if future.any():
        out[:, future] = np.stack(deviations(int(t.max()) - t_max, delta, n_obs, width, samples, seed))[:, t[future] - t_max - 1]
    return out[0], out[1]


def quantile(model: str, q: float, mean: Column, phi: Column, capacity: Column) -> Column:
    """Quantile of the response; the normal one is an expression."""
    if model == "normal":
        return mean + phi * F.lit(normal_ppf(q))
    family = FAMILIES[model]

    @F.pandas_udf("double")
    def run(mean: pd.Series, phi: pd.Series, capacity: pd.Series) -> pd.Series:
        m, n = mean.to_numpy(float), capacity.to_numpy(float)
        p = family.dispersion(phi.to_numpy(float), 0, 0, n) if model == "beta-binomial" else phi.to_numpy(float)
        return pd.Series(family.quantile(q, m, p, n))

    return run(mean, phi, capacity)


def predict(model: FittedModel, data: DataFrame | None = None, history: DataFrame | None = None, periods: int | None = None, include_history: bool | None = None, compat: bool = False, toml_path: str | None = None) -> DataFrame:
    """Forecast of the given rows, or of ``periods`` rows after ``history``: keys, ds, yhat, trend and their bounds.

    ``periods`` (1) and ``include_history`` (true) come from [predict] of the TOML file or from the model's own settings if not given.
    ``compat`` leaves simulated trend deviations unscaled by the link's scale. Rows of series without parameters are dropped.
    """
    if not isinstance(model, FittedModel):
        raise NotFittedError("fit the model first")
    spec, keys, ts = model.spec, model.spec.inner_keys, model.spec.timestamp_name
    if data is None:
        if history is None:
            raise ValueError("give the rows to predict, or the history to go on from")
        if spec.externals:
            raise ValueError("external regressors need explicit rows")
        if spec.capacity_name:
            raise ValueError("a capacity column needs explicit rows")
        asked = settings("predict", spec.config, toml_path, **given(periods=periods, include_history=include_history))
        data = future_frame(history, ts, spec.step_us, asked["periods"], asked["include_history"], spec.keys)
    data = with_inner_keys(data, spec)
    lo, hi = bounds(data, ts)
    params = model.params
    grid = data.join(params.drop("draws"), keys) if keys else data.join(F.broadcast(params.drop("draws")), how="inner", on=F.lit(True))  # one row
    grid = grid.withColumn("t", steps_between(F.col("t0"), F.col(ts), spec.step_us))
    grid = feats.feature_matrix(grid, spec, lo, hi)
    grid = grid.withColumn("_cap", F.col(spec.capacity_name).cast("double") if spec.capacity_name and spec.capacity_name in data.columns else F.col("capacity_fixed"))
    grid = grid.withColumn("eta_trend", F.col("linked_offset") + F.col("linked_scale") * trend(F.col("t"), F.col("k"), F.col("m"), F.col("changepoints"), F.col("delta")))
    grid = grid.withColumn("eta", F.col("eta_trend") + F.col("linked_scale") * dot(F.col("x"), F.col("beta")))
    samples = spec.trend_samples if spec.n_changepoints else 0
    grid = grid.withColumns({"eta_lo": F.col("eta"), "eta_hi": F.col("eta")})
    times = grid.select(*keys, "t", "t_max")
    if model.options["use_laplace"]:
        grid = over_draws(grid, model)
    grid = with_deviations(grid, times, model, samples, compat) if samples else grid.withColumns({"dev_lo": F.lit(0.0), "dev_hi": F.lit(0.0)})
    if model.options["use_laplace"]:
        grid = grid.withColumns({"eta_lo": F.col("eta_lo") + F.col("dev_lo"), "eta_hi": F.col("eta_hi") + F.col("dev_hi")})
    inverse = LINKS[FAMILIES[spec.model].link][1]
    size = F.col("_cap") if FAMILIES[spec.model].counts_of else F.lit(1.0)
    out = grid.withColumns({
        "yhat_linked": F.col("eta"), "yhat_linked_lower": F.col("eta_lo") , "yhat_linked_upper": F.col("eta_hi"),
        "trend_linked": F.col("eta_trend"), "trend_linked_lower": F.col("eta_trend") + F.col("dev_lo"), "trend_linked_upper": F.col("eta_trend") + F.col("dev_hi"),
    })
    out = out.withColumns({f"{n}{b}": size * inverse(F.col(f"{n}_linked{b}")) for n in ("yhat", "trend") for b in ("", "_lower", "_upper")})
    tail = (1 - spec.interval_width) / 2
    # The dispersion of beta-binomial rows follows from kappa and each row's capacity.
    phi = F.col("kappa") if spec.model == "beta-binomial" else F.coalesce("phi", F.lit(1.0))
    for side, q in (("lower", tail), ("upper", 1 - tail)):
        out = out.withColumn(f"observed_{side}", quantile(spec.model, q, F.col("yhat") - F.col("trend") + F.col(f"trend_{side}"), phi, F.coalesce("_cap", F.lit(0.0))))
    order = ["yhat", "yhat_linked", "observed", "trend", "trend_linked"]
    names = [f"{n}{b}" for n in order for b in (("", "_lower", "_upper") if n != "observed" else ("_lower", "_upper"))]
    return out.select(*(F.col(i).alias(k) for k, i in zip(spec.keys, keys, strict=True)), ts, *(F.col(n).cast("double").alias(n) for n in names))


def with_deviations(grid: DataFrame, times: DataFrame, model: FittedModel, samples: int, compat: bool) -> DataFrame:
    """dev_lo and dev_hi: simulated once per series up to the last step asked for, and joined to the future rows; zero elsewhere."""
    spec, keys = model.spec, model.spec.inner_keys
    kinds = {f.name: f.dataType.simpleString() for f in grid.schema}
    ahead = times.where("t > t_max").groupBy(*keys).agg(F.max("t").alias("_last"))
    own = model.params.select(*keys, "t_max", "delta", "n_obs", "linked_scale")
    series = own.join(ahead, keys) if keys else own.join(F.broadcast(ahead), how="inner", on=F.col("_last").isNotNull())  # one row

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                *key, t_max, delta, n_obs, scale, last = r
                low, high = deviations(int(last) - int(t_max), np.array(delta, float), int(n_obs), spec.interval_width, samples, seed_of(tuple(key), spec.seed + 1))
                factor = 1.0 if compat else scale
                yield pd.DataFrame({**{k: [v] * len(low) for k, v in zip(keys, key, strict=True)}, "t": np.arange(int(t_max) + 1, int(last) + 1), "dev_lo": factor * low, "dev_hi": factor * high})

    made = series.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "t bigint", "dev_lo double", "dev_hi double"]))
    return grid.join(made, [*keys, "t"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("dev_lo", "dev_hi")})


def over_draws(grid: DataFrame, model: FittedModel) -> DataFrame:
    """Mean and bounds of eta, and mean of its trend, over posterior draws, by series."""
    spec, keys, width = model.spec, model.spec.inner_keys, model.spec.interval_width
    replaced = ["eta", "eta_trend", "eta_lo", "eta_hi"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grid.schema if f.name not in replaced)

    def run(key: tuple, g: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rest = g.drop(columns=replaced)
        if not len(g) or not len(own):
            return rest.iloc[:0].assign(**{c: np.empty(0) for c in replaced})
        first = g.iloc[0]
        t, scale, offset = g["t"].to_numpy(np.int64), first["linked_scale"], first["linked_offset"]
        d, cps = np.stack(own["draws"].iloc[0]).astype(float), np.array(first["changepoints"], float)
        x, s = np.stack(g["x"].to_numpy()).astype(float).reshape(len(g), -1), len(cps)
        out = {c: np.empty(len(g)) for c in replaced}
        for at in range(0, len(g), AHEAD):
            some = slice(at, at + AHEAD)
            trends = d[:, :1] * t[some] + d[:, 1:2] + d[:, 2 : 2 + s] @ np.maximum(t[None, some] - cps[:, None], 0)
            every = offset + scale * (trends + d[:, 2 + s :] @ x[some].T)
            out["eta"][some], out["eta_trend"][some] = every.mean(axis=0), offset + scale * trends.mean(axis=0)
            out["eta_lo"][some], out["eta_hi"][some] = np.percentile(every, [50 - 50 * width, 50 + 50 * width], axis=0)
        return rest.assign(**out)

    # Draws meet their series' rows in the worker, so that they are not repeated for each row.
    draws = model.params.select(*keys, "draws")
    grouped, given = (x.groupBy(*keys) if keys else x.groupBy(F.lit(0).alias("_one")) for x in (grid, draws))
    return grouped.cogroup(given).applyInPandas(run, f"{kinds}, {', '.join(f'{c} double' for c in replaced)}")


def score_series(p: dict, spec, t: np.ndarray, x: np.ndarray, capacity: np.ndarray, key: tuple = ()) -> pd.DataFrame:
    """The point path in numpy, for folds whose parameters never leave the worker; trends are simulated by the series' own seed."""
    family = FAMILIES[spec.model]
    cps, delta = np.array(p["changepoints"], float), np.array(p["delta"], float)
    value = p["k"] * t + p["m"] + np.maximum(t[:, None] - cps[None, :], 0) @ delta
    eta = p["linked_offset"] + p["linked_scale"] * (value + x @ np.array(p["beta"], float))
    size = capacity if family.counts_of else 1.0
    yhat, base = size * INVERSE[family.link](eta), size * INVERSE[family.link](p["linked_offset"] + p["linked_scale"] * value)
    low, high = simulate_trend(t, p["t_max"], delta, p["n_obs"], spec.interval_width, spec.trend_samples, seed_of(key, spec.seed + 1))
    phi = family.dispersion(p["kappa"], 0, 0, capacity) if spec.model == "beta-binomial" else p["phi"] or 1.0
    tail = (1 - spec.interval_width) / 2
    out = {"yhat": yhat, "yhat_lower": yhat, "yhat_upper": yhat}
    if p["draws"]:
        d = np.array(p["draws"], float)
        s = len(cps)
        trends = d[:, :1] * t + d[:, 1:2] + d[:, 2 : 2 + s] @ np.maximum(t[None, :] - cps[:, None], 0)
        every = p["linked_offset"] + p["linked_scale"] * (trends + d[:, 2 + s :] @ x.T)
        edges = np.percentile(every, [50 - 50 * spec.interval_width, 50 + 50 * spec.interval_width], axis=0)
        yhat = size * INVERSE[family.link](every.mean(axis=0))
        out = {"yhat": yhat, **{f"yhat_{side}": size * INVERSE[family.link](edge + p["linked_scale"] * dev) for side, edge, dev in zip(("lower", "upper"), edges, (low, high), strict=True)}}
    for side, q, dev in (("lower", tail, low), ("upper", 1 - tail, high)):
        shifted = size * INVERSE[family.link](p["linked_offset"] + p["linked_scale"] * (value + dev))
        out[f"observed_{side}"] = family.quantile(q, yhat - base + shifted, phi, capacity)
    return pd.DataFrame(out)

