"""Fit of one series, and of many by groups: damped Newton steps in an unconstrained space.

A group is one series and has to fit a Python worker, as a model's parameters depend on all of its rows; groups are spread
by one shuffle. A long history without keys is fitted across the executors instead (longfit.py). Bounded parameters are lb + (ub - lb) expit(u). The smooth part of the curvature is the Fisher information of
the linear predictor; the double-exponential prior of slope changes enters by the quadratic that touches it from above, so that
every accepted step lowers the objective. The dispersion is searched for between the steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.storage import cut
from tidecast.operators import features as feats
from tidecast.operators.families import FAMILIES, INVERSE, LINK, expit
from tidecast.operators.grid import steps_between
from tidecast.operators.longfit import fit_across
from tidecast.operators.validate import check_rows, check_schema, validation_report
from tidecast.plans.config import given, settings
from tidecast.plans.errors import FittedError
from tidecast.plans.spec import ModelSpec

EPS = 1e-10
#: From so many rows on the one series of a history without keys is fitted across the executors.
LONG = 500_000
PARAMS = (
    "k double, m double, delta array<double>, changepoints array<bigint>, beta array<double>, kappa double, phi double, linked_offset double, "
    "linked_scale double, y_mean double, variance_bound double, t_max bigint, n_obs bigint, objective double, steps bigint, draws array<array<double>>"
)


@dataclass
class Series:
    t: np.ndarray
    y: np.ndarray
    capacity: np.ndarray
    x: np.ndarray
    changepoints: np.ndarray


def changepoint_positions(t: np.ndarray, n: int, share: float) -> np.ndarray:
    """Of sorted times: evenly spread over the first ``share`` of the rows, without the first."""
    rows = int(np.floor(len(t) * share))
    n = n if n + 1 <= rows else max(rows - 1, 0)
    return t[np.round(np.linspace(0, rows - 1, n + 1)).astype(int)[1:]] if n > 0 else t[:0]


def linked(family, y: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    v = y / np.where(capacity == 0, EPS, capacity) if family.counts_of else y.astype(float)
    if family.lower:
        v = np.where(v == 0, EPS, v)
    if family.upper:
        v = np.where(v == 1, 1 - EPS, v)
    return LINK[family.link](v)


def fit_series(s: Series, spec: ModelSpec, scales: Sequence[float], mode: str = "MAP", laplace: bool = False, draws: int = 1000, seed: int = 0) -> dict:
    """Parameters of one series. ``scales`` are the features' prior scales; MLE leaves the Jacobian out and keeps the priors."""
    family = FAMILIES[spec.model]
    t, n_rows = s.t.astype(float), len(s.t)
    y = np.clip(s.y, EPS, None) if family.name == "gamma" else np.clip(s.y, EPS, 1 - EPS) if family.name == "beta" else s.y.astype(float)
    z = linked(family, s.y, s.capacity)
    offset, scale = float(z.min()), float(z.max() - z.min())
    scale = scale if scale > 0 else 1.0
    bend = np.maximum(t[:, None] - s.changepoints[None, :], 0)
    base = np.c_[t, np.ones(n_rows), bend]
    # Features by their strength, without those that do not vary.
    span = np.ptp(s.x, axis=0) if s.x.shape[1] else np.empty(0)
    live = np.flatnonzero(span > 0)
    x = s.x[:, live]
    norm = np.linalg.norm(x, axis=0)
    q = norm / np.median(norm) if len(live) else norm
    x = x / q if len(live) else x
    reach = np.ptp(x, axis=0) if len(live) else norm
    S_, K = bend.shape[1], len(live)
    lb = np.r_[-0.5, 0.0, np.full(S_, -1.0), -1 / reach]
    ub = np.r_[0.5, 1.0, np.full(S_, 1.0), 1 / reach]
    sd = np.array(scales, float)[live] / (3 * reach * np.sqrt(-2 * np.log(0.01))) if K else np.empty(0)
    laplace_b = 0.072 * spec.changepoint_prior_scale
    design = np.c_[base, x] * scale
    # Start at the least-squares trend.
    first = np.linalg.lstsq(np.c_[base, np.zeros((n_rows, 0))], (z - offset) / scale, rcond=None)[0]
    theta0 = np.clip(np.r_[first, np.zeros(K)], lb + 1e-3 * (ub - lb), ub - 1e-3 * (ub - lb))
    ybar = float(y.mean())
    expect = INVERSE[family.link](offset + scale * (base @ theta0[: 2 + S_])) * (s.capacity if family.counts_of else 1)
    v = max(1.5 * float(np.var(y - expect)), EPS)
    has_kappa = family.dispersion is not None
    top = family.kappa_top(ybar, v) if family.kappa_top else 2.0
    top = top if top > 0 else 1e-3
    jac = mode.upper() == "MAP"

    def phi_of(uk: float):
        return family.dispersion(top * expit(np.array(uk)), ybar, v, s.capacity) if has_kappa else 1.0

    def objective(u: np.ndarray, uk: float) -> float:
        w = expit(u)
        theta = lb + (ub - lb) * w
        total = -np.sum(family.parts(y, offset + design @ theta, phi_of(uk), s.capacity)[0])
        total += theta[0] ** 2 / 0.5 + (theta[1] - 0.5) ** 2 / 0.5 + np.sum(np.abs(theta[2 : 2 + S_])) / laplace_b + np.sum((theta[2 + S_ :] / sd) ** 2) / 2
        if jac:
            total -= np.sum(np.log(ub - lb) - np.logaddexp(0, -u) - np.logaddexp(0, u))
        if has_kappa:
            total += top * expit(np.array(uk)) * spec.dispersion_prior_scale / 6
            if jac:
                total -= np.log(top) - np.logaddexp(0, -uk) - np.logaddexp(0, uk)
        return float(total) if np.isfinite(total) else np.inf

    def derivatives(u: np.ndarray, uk: float) -> tuple[np.ndarray, np.ndarray]:
        w = expit(u)
        theta, d = lb + (ub - lb) * w, (ub - lb) * w * (1 - w)
        _, g_eta, weight = family.parts(y, offset + design @ theta, phi_of(uk), s.capacity)
        delta = theta[2 : 2 + S_]
        prior_g = np.r_[theta[0] / 0.25, (theta[1] - 0.5) / 0.25, np.sign(delta) / laplace_b, theta[2 + S_ :] / sd**2]
        prior_h = np.r_[4.0, 4.0, 1 / (laplace_b * np.sqrt(delta**2 + 1e-8)), 1 / sd**2]
        g = (prior_g - design.T @ g_eta) * d
        h = (design.T * weight) @ design + np.diag(prior_h)
        h = h * d[:, None] * d[None, :]
        if jac:
            g -= 1 - 2 * w
            h[np.diag_indices_from(h)] += 2 * w * (1 - w)
        return g, h

    u, uk = np.log((theta0 - lb) / (ub - theta0)), 0.0
    now, damp, step_no = objective(u, uk), 1e-6, 0
    for step_no in range(1, 201):
        if has_kappa:
            lo, hi = (-12.0, 12.0) if step_no <= 2 else (uk - 1.0, uk + 1.0)
            grid = np.linspace(lo, hi, 13)
            best = grid[int(np.argmin([objective(u, x_) for x_ in grid]))]
            width = grid[1] - grid[0]
            for _ in range(25):
                width /= 2
                best = min((best - width, best, best + width), key=lambda x_: objective(u, x_))
            if objective(u, best) < now:
                uk, now = float(best), objective(u, best)
        g, h = derivatives(u, uk)
        moved = False
        for _ in range(12):
            try:
                move = np.linalg.solve(h + damp * np.diag(np.maximum(np.diag(h), 1e-12)), -g)
            except np.linalg.LinAlgError:
                damp = max(damp * 10, 1e-8)
                continue
            move *= min(1.0, 4.0 / max(np.abs(move).max(initial=0), 1e-300))
            for shrink in (1.0, 0.5, 0.25, 0.06, 0.01):
                new = objective(u + shrink * move, uk)
                if new < now:
                    moved = True
                    break
            if moved:
                break
            damp = max(damp * 30, 1e-8)
        if not moved:
            break
        gain, u, now, damp = now - new, u + shrink * move, new, max(damp / 10, 1e-10)
        if gain < 1e-12 * (1 + abs(now)):
            break

    theta = lb + (ub - lb) * expit(u)
    phi = phi_of(uk)

    def unpack(th: np.ndarray) -> np.ndarray:
        beta = np.zeros(s.x.shape[1])
        beta[live] = th[2 + S_ :] / q
        return np.r_[th[: 2 + S_], beta]

    full, many, kappa = unpack(theta), [], float(top * expit(np.array(uk))) if has_kappa else None
    phi = float(np.mean(phi)) if has_kappa else None
    if laplace:
        # The Gaussian at the mode, of the dispersion too: its row of the curvature comes from differences of the gradient.
        rng, (_, h), width = np.random.default_rng(seed), derivatives(u, uk), 1e-3
        if has_kappa:
            up, down = (derivatives(u, uk + e)[0] for e in (width, -width))
            cross = (up - down) / (2 * width)
            own = (objective(u, uk + width) - 2 * now + objective(u, uk - width)) / width**2
            # Curvature in the linear predictor's parameters is expected, not observed: keep the whole positive.
            own = max(own, 1.01 * float(cross @ np.linalg.solve(h + 1e-9 * np.diag(np.diag(h)), cross)), 1e-6)
            h = np.block([[h, cross[:, None]], [cross[None, :], np.array([[own]])]])
        root = np.linalg.cholesky(np.linalg.inv(h + 1e-9 * np.diag(np.diag(h))))
        at = np.r_[u, [uk] * has_kappa] + rng.standard_normal((draws, len(h))) @ root.T
        many = [unpack(lb + (ub - lb) * expit(d[: len(u)])).tolist() for d in at]
        if has_kappa:  # what scoring uses is the dispersion's mean over the draws
            drawn = top * expit(at[:, -1])
            phi = float(np.mean([np.mean(phi_of(x)) for x in at[:, -1]]))
            kappa = float(np.mean(drawn**-2.0) ** -0.5) if family.name == "beta-binomial" else float(drawn.mean())
    return {
        "k": float(full[0]), "m": float(full[1]), "delta": full[2 : 2 + S_].tolist(), "changepoints": s.changepoints.astype(int).tolist(), "beta": full[2 + S_ :].tolist(),
        "kappa": kappa, "phi": phi, "linked_offset": offset, "linked_scale": scale,
        "y_mean": ybar, "variance_bound": v, "t_max": int(s.t.max()), "n_obs": n_rows, "objective": now, "steps": step_no, "draws": many,
    }


@dataclass(frozen=True)
class FittedModel:
    """A settled spec (protocols and prunings applied), the span of the history, and one row of parameters per series.

    In ``params`` the keys are called _key0, _key1, ... in the order of the spec's.
    """

    spec: ModelSpec
    params: DataFrame
    start: datetime
    end: datetime
    options: dict

    @property
    def is_fitted(self) -> bool:
        return True


def with_inner_keys(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """The columns that the model uses, the keys renamed."""
    used = [spec.timestamp_name, *[c for c in (spec.metric_name, spec.capacity_name) if c in df.columns], *(e.name for e in spec.externals if e.name in df.columns)]
    return df.select(*(F.col(k).alias(i) for k, i in zip(spec.keys, spec.inner_keys, strict=True)), *dict.fromkeys(used))


def seed_of(key: tuple, seed: int) -> int:
    return zlib.crc32(repr((tuple(map(str, key)), seed)).encode())


def bounds(df: DataFrame, ts: str) -> tuple[datetime, datetime]:
    row = df.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    if row["lo"] is None:
        raise ValueError("no rows")
    return row["lo"], row["hi"]


def capacity_column(spec: ModelSpec, options: dict) -> F.Column:
    if spec.model not in ("binomial", "beta-binomial"):
        return F.lit(None).cast("double")
    if spec.capacity_name:
        return F.col(spec.capacity_name).cast("double")
    if options.get("capacity") is not None:
        return F.lit(float(options["capacity"]))
    return F.col("_capacity").cast("double")


def prepare(df: DataFrame, spec: ModelSpec, options: dict, validate: bool = True) -> tuple[ModelSpec, DataFrame, datetime, datetime]:
    """Validated rows (keys, ds, t, y, capacity, x, t0) and the settled spec."""
    from tidecast.operators.trend import estimate_capacity

    df = with_inner_keys(df, spec)
    outer, spec = spec.keys, replace(spec, keys=tuple(spec.inner_keys))
    ts, keys, metric = spec.timestamp_name, list(spec.keys), spec.metric_name
    names = [e.name for e in spec.externals]
    check_schema(df, ts, metric, spec.model, spec.capacity_name or None, names)
    if validate:
        check_rows(validation_report(df, ts, metric, spec.step_us, keys, spec.capacity_name or None, names), spec.model)
    lo, hi = bounds(df, ts)
    spec = feats.prune_events(feats.apply_protocols(spec, df, lo, hi), lo, hi)
    if spec.changepoints is not None and any(not lo <= c <= hi for c in spec.changepoints):
        raise ValueError("changepoints must lie within the history")
    rows = df
    if spec.model in ("binomial", "beta-binomial") and not spec.capacity_name and options.get("capacity") is None:
        found = estimate_capacity(df, metric, options.get("capacity_mode") or "scale", 0.5 if options.get("capacity_value") is None else options["capacity_value"], keys).withColumnRenamed("capacity", "_capacity")
        rows = df.join(found, keys) if keys else df.withColumn("_capacity", F.lit(found.first()["_capacity"]))
    origin = df.groupBy(*keys).agg(F.min(ts).alias("t0"))
    rows = rows.join(origin, keys) if keys else rows.withColumn("t0", F.lit(lo.isoformat(sep=" ")).cast("timestamp_ntz"))
    rows = rows.withColumn("t", steps_between(F.col("t0"), F.col(ts), spec.step_us))
    rows = feats.feature_matrix(rows, spec, lo, hi)
    spec = replace(spec, keys=outer)
    return spec, rows.select(*keys, F.col(ts).alias("ds"), "t", F.col(metric).cast("double").alias("y"), capacity_column(spec, options).alias("capacity"), "x", "t0"), lo, hi


def given_changepoints(spec: ModelSpec, start: datetime) -> np.ndarray | None:
    """Integer times of the spec's own changepoints, None if they are left to the rows."""
    if spec.changepoints is None:
        return None
    us = ((pd.Series(spec.changepoints, dtype="datetime64[us]") - pd.Timestamp(start)) // pd.Timedelta(1, "us")).to_numpy(np.int64)
    return np.trunc(us / spec.step_us).astype(np.int64)


def series_of(g: pd.DataFrame, spec: ModelSpec, changepoints: np.ndarray | None = None) -> Series:
    g = g.sort_values("t", kind="stable")
    t = g["t"].to_numpy(np.int64)
    if changepoints is None:
        changepoints = given_changepoints(spec, g["t0"].iloc[0])
        if changepoints is None:
            changepoints = changepoint_positions(t, spec.n_changepoints, spec.changepoint_range)
    capacity = g["capacity"].to_numpy(float)
    return Series(t, g["y"].to_numpy(float), capacity, np.stack(g["x"].to_numpy()).astype(float).reshape(len(g), -1), changepoints)


def key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def fit(
    df: DataFrame, spec: ModelSpec, optimize_mode: str | None = None, use_laplace: bool | None = None, capacity: int | None = None, capacity_mode: str | None = None, capacity_value: float | None = None,
    draws: int = 1000, validate: bool = True, toml_path: str | None = None, across: bool | None = None,
) -> FittedModel:
    """Fit every series of the frame, once: the parameters, a row per series, are a checkpoint that all later steps read.

    What is not given comes from [fit] of the TOML file, else from the spec's own settings, else from the defaults: MAP, no
    Laplace draws, and a capacity for which the metric is half of it on the whole. A history without keys is one series:
    with LONG rows or more, or if ``across`` asks for it, its fit is made of sums over the executors, with the same optimum; draws
    need the series in one task.
    """
    if isinstance(spec, FittedModel):
        raise FittedError("the model is fitted; fit its spec again for another history")
    options = settings("fit", spec.config, toml_path, **given(optimize_mode=optimize_mode, use_laplace=use_laplace, capacity=capacity, capacity_mode=capacity_mode, capacity_value=capacity_value)) | {"draws": draws}
    if options["optimize_mode"].upper() not in ("MAP", "MLE"):
        raise ValueError("optimize_mode is MAP or MLE")
    optimize_mode, use_laplace = options["optimize_mode"], options["use_laplace"]
    spec, rows, lo, hi = prepare(df, spec, options, validate)
    keys = spec.inner_keys
    scales = [f.prior_scale for f in feats.features(spec, F.col("t"), F.col("ds"), lo, hi)]

    if across and (keys or use_laplace):
        raise ValueError("a fit across executors is of one series, without keys and draws")
    if across or (across is None and not keys and not use_laplace and rows.count() >= LONG):
        first = rows.select("t0", "capacity").first()
        out = fit_across(rows, spec, scales, given_changepoints(spec, first["t0"]), linked, optimize_mode)
        row = {"t0": first["t0"], "capacity_fixed": None if spec.capacity_name else first["capacity"], **out}
        params = rows.sparkSession.createDataFrame([row], f"t0 timestamp_ntz, capacity_fixed double, {PARAMS}")
        return FittedModel(replace(spec, meta={**spec.meta}), cut(params), lo, hi, options)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        out = fit_series(series_of(g, spec), spec, scales, optimize_mode, use_laplace, draws, seed_of(key[: len(keys)], spec.seed))
        return pd.DataFrame([{**dict(zip(keys, key, strict=False)), "t0": g["t0"].iloc[0], "capacity_fixed": None if spec.capacity_name else g["capacity"].iloc[0], **out}])

    grouped = rows.groupBy(*keys) if keys else rows.groupBy(F.lit(0).alias("_one"))
    params = grouped.applyInPandas(run, f"{key_schema(rows, keys)}t0 timestamp_ntz, capacity_fixed double, {PARAMS}")
    return FittedModel(replace(spec, meta={**spec.meta}), cut(params), lo, hi, options)
