"""Fit of one series that spreads over the executors: the same optimum as a group's fit, from sums over the rows.

Every step needs the objective, its gradient and its curvature, which are sums over the rows. Tasks make their part of them from
blocks of rows, and a tree adds the parts, so that the driver holds a few numbers and a matrix of parameters by parameters,
however long the series is. A pass evaluates several candidates: all step lengths of a line search, and all points of a grid of
the dispersion. Rows are written once and read again by each pass. Changepoints are rows at given places of the order, which
a range partitioning finds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.functions.storage import forget, mark, written
from tidecast.operators.families import FAMILIES, INVERSE, expit
from tidecast.operators.order import in_order
from tidecast.plans.spec import ModelSpec

#: Rows of a block, and points of a grid of the dispersion.
BLOCK, POINTS = 16_384, 25
SHRINK = (1.0, 0.5, 0.25, 0.06, 0.01)
Part = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def over_rows(data: DataFrame, part: Part, add: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> np.ndarray:
    """The parts of all blocks of rows (t, y, capacity, x), put together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                t, y, capacity = (some.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("t", "y", "capacity"))
                x = some.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(t), -1)
                one = part(t, y, capacity, x)
                total = one if total is None else add(total, one)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, float).tobytes()], pa.binary())], names=["part"])

    return data.mapInArrow(run, "part binary").rdd.map(lambda r: np.frombuffer(r[0])).treeReduce(add)


def places_of_changepoints(rows: DataFrame, n_rows: int, n: int, share: float) -> np.ndarray:
    """Integer times of the automatic changepoints: rows evenly spread over the first ``share`` of the rows."""
    first = int(np.floor(n_rows * share))
    n = n if n + 1 <= first else max(first - 1, 0)
    if n <= 0:
        return np.empty(0, np.int64)
    at = np.round(np.linspace(0, first - 1, n + 1)).astype(int)[1:].tolist()
    found = dict(in_order(rows.select("t"), "t").where(F.col("position").isin(at)).select("position", "t").collect())  # a row per changepoint
    return np.array([found[i] for i in at], np.int64)


def fit_across(rows: DataFrame, spec: ModelSpec, scales: Sequence[float], changepoints: np.ndarray | None, linked: Callable, mode: str = "MAP") -> dict:
    """Parameters of the one series of ``rows`` (t, y, capacity, x), as ``fit_series`` gives them; without draws.

    ``changepoints`` are integer times; None spreads them over the rows. Rows come in any order and repeat as they like.
    """
    since, family, jac = mark(), FAMILIES[spec.model], mode.upper() == "MAP"
    data = written(rows.select("t", "y", F.coalesce("capacity", F.lit(0.0)).alias("capacity"), "x"))
    tiny = 1e-10

    def clipped(y: np.ndarray) -> np.ndarray:
        return np.clip(y, tiny, None) if family.name == "gamma" else np.clip(y, tiny, 1 - tiny) if family.name == "beta" else y

    # What single columns need: extremes in the first part, sums in the second.
    K = len(scales)

    def measure(t, y, capacity, x):  # noqa: ANN001, ANN202
        z = linked(family, y, capacity)
        return np.r_[-z.min(), z.max(), t.max(), -x.min(axis=0), x.max(axis=0), len(t), clipped(y).sum(), (x * x).sum(axis=0)]

    top = 3 + 2 * K
    seen = over_rows(data, measure, lambda a, b: np.r_[np.maximum(a[:top], b[:top]), a[top:] + b[top:]])
    offset, scale, t_max, n_rows = float(-seen[0]), float(seen[1] + seen[0]), int(seen[2]), int(seen[top])
    scale = scale if scale > 0 else 1.0
    ybar, span = float(seen[top + 1] / n_rows), seen[3 + K : top] + seen[3 : 3 + K]
    live = np.flatnonzero(span > 0)
    norm = np.sqrt(seen[top + 2 :][live])
    q = norm / np.median(norm) if len(live) else norm
    reach = span[live] / q
    cps = places_of_changepoints(data, n_rows, spec.n_changepoints, spec.changepoint_range) if changepoints is None else changepoints
    S_, L = len(cps), len(live)

    def trend_columns(t: np.ndarray) -> np.ndarray:
        return np.c_[t, np.ones(len(t)), np.maximum(t[:, None] - cps[None, :], 0)]

    def design(t: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.c_[trend_columns(t), x[:, live] / q] * scale

    # Start at the least-squares trend, its normal equations in columns of about one.
    size = np.r_[max(t_max, 1), 1.0, np.full(S_, max(t_max, 1))]

    def normal_equations(t, y, capacity, x):  # noqa: ANN001, ANN202
        b = trend_columns(t) / size
        return np.r_[(b.T @ b).ravel(), b.T @ ((linked(family, y, capacity) - offset) / scale)]

    gram = over_rows(data, normal_equations)
    first = np.linalg.lstsq(gram[: (2 + S_) ** 2].reshape(2 + S_, -1), gram[(2 + S_) ** 2 :], rcond=1e-14)[0] / size
    lb, ub = np.r_[-0.5, 0.0, np.full(S_, -1.0), -1 / reach], np.r_[0.5, 1.0, np.full(S_, 1.0), 1 / reach]
    sd = np.array(scales, float)[live] / (3 * reach * np.sqrt(-2 * np.log(0.01))) if L else np.empty(0)
    laplace_b = 0.072 * spec.changepoint_prior_scale
    theta0 = np.clip(np.r_[first, np.zeros(L)], lb + 1e-3 * (ub - lb), ub - 1e-3 * (ub - lb))

    def residuals(t, y, capacity, x):  # noqa: ANN001, ANN202
        r = clipped(y) - INVERSE[family.link](offset + scale * (trend_columns(t) @ theta0[: 2 + S_])) * (capacity if family.counts_of else 1)
        return np.array([r.sum(), (r * r).sum()])

    total, squares = over_rows(data, residuals) / n_rows
    v = max(1.5 * float(squares - total**2), tiny)
    has_kappa = family.dispersion is not None
    kappa_top = family.kappa_top(ybar, v) if family.kappa_top else 2.0
    kappa_top = kappa_top if kappa_top > 0 else 1e-3

    def phi_of(uk: float, capacity: np.ndarray):  # noqa: ANN202
        return family.dispersion(kappa_top * expit(np.array(uk)), ybar, v, capacity) if has_kappa else 1.0

    def penalty(u: np.ndarray, uk: float) -> float:
        theta = lb + (ub - lb) * expit(u)
        out = theta[0] ** 2 / 0.5 + (theta[1] - 0.5) ** 2 / 0.5 + np.sum(np.abs(theta[2 : 2 + S_])) / laplace_b + np.sum((theta[2 + S_ :] / sd) ** 2) / 2
        if jac:
            out -= np.sum(np.log(ub - lb) - np.logaddexp(0, -u) - np.logaddexp(0, u))
        if has_kappa:
            out += kappa_top * expit(np.array(uk)) * spec.dispersion_prior_scale / 6
            if jac:
                out -= np.log(kappa_top) - np.logaddexp(0, -uk) - np.logaddexp(0, uk)
        return float(out)

    def objectives(us: Sequence[np.ndarray], uks: Sequence[float]) -> np.ndarray:
        """By parameters and dispersion."""
        thetas = np.stack([lb + (ub - lb) * expit(u) for u in us], axis=1)

        def part(t, y, capacity, x):  # noqa: ANN001, ANN202
            eta, seen_y = offset + design(t, x) @ thetas, clipped(y)
            return np.array([-np.sum(family.parts(seen_y, eta[:, i], phi_of(uk, capacity), capacity)[0]) for i in range(len(us)) for uk in uks])

        with np.errstate(invalid="ignore"):
            out = over_rows(data, part).reshape(len(us), len(uks)) + np.array([[penalty(u, uk) for uk in uks] for u in us])
        return np.where(np.isfinite(out), out, np.inf)

    def derivatives(u: np.ndarray, uk: float) -> tuple[np.ndarray, np.ndarray]:
        w = expit(u)
        theta, d = lb + (ub - lb) * w, (ub - lb) * w * (1 - w)
        P = len(theta)

        def part(t, y, capacity, x):  # noqa: ANN001, ANN202
            b = design(t, x)
            _, g_eta, weight = family.parts(clipped(y), offset + b @ theta, phi_of(uk, capacity), capacity)
            return np.r_[b.T @ g_eta, ((b.T * weight) @ b).ravel()]

        got = over_rows(data, part)
        delta = theta[2 : 2 + S_]
        prior_g = np.r_[theta[0] / 0.25, (theta[1] - 0.5) / 0.25, np.sign(delta) / laplace_b, theta[2 + S_ :] / sd**2]
        prior_h = np.r_[4.0, 4.0, 1 / (laplace_b * np.sqrt(delta**2 + 1e-8)), 1 / sd**2]
        g, h = (prior_g - got[:P]) * d, (got[P:].reshape(P, P) + np.diag(prior_h)) * d[:, None] * d[None, :]
        if jac:
            g -= 1 - 2 * w
            h[np.diag_indices_from(h)] += 2 * w * (1 - w)
        return g, h

    def dispersion(u: np.ndarray, uk: float, wide: bool) -> tuple[float, float]:
        """The best dispersion for these parameters, on grids that close in, and at last where a parabola has its foot."""
        lo, hi = (-12.0, 12.0) if wide else (uk - 1.0, uk + 1.0)
        for _ in range(5 if wide else 4):
            grid = np.linspace(lo, hi, POINTS)
            f = objectives([u], grid)[0]
            i = int(np.argmin(f))
            lo, hi = grid[max(i - 1, 0)], grid[min(i + 1, POINTS - 1)]
        best, value = float(grid[i]), float(f[i])
        if 0 < i < POINTS - 1 and (bend := f[i - 1] - 2 * f[i] + f[i + 1]) > 0:
            foot = best + (grid[1] - grid[0]) * (f[i - 1] - f[i + 1]) / (2 * bend)
            if (there := float(objectives([u], [foot])[0, 0])) < value:
                best, value = float(foot), there
        return best, value

    u, uk, step_no, damp = np.log((theta0 - lb) / (ub - theta0)), 0.0, 0, 1e-6
    now = float(objectives([u], [uk])[0, 0])
    for step_no in range(1, 101):
        before = now
        if has_kappa:
            best, value = dispersion(u, uk, step_no <= 2)
            if value < now:
                uk, now = best, value
        g, h = derivatives(u, uk)
        moved = False
        for _ in range(8):
            move = np.linalg.lstsq(h + damp * np.diag(np.maximum(np.diag(h), 1e-12)), -g, rcond=None)[0]
            move *= min(1.0, 4.0 / max(np.abs(move).max(initial=0), 1e-300))
            f = objectives([u + s * move for s in SHRINK], [uk])[:, 0]
            better = np.flatnonzero(f < now)
            if len(better):
                moved, u, now, damp = True, u + SHRINK[better[0]] * move, float(f[better[0]]), max(damp / 10, 1e-10)
                break
            damp = max(damp * 30, 1e-8)
        if not moved or before - now < 1e-12 * (1 + abs(now)):
            break
    phi = None
    if has_kappa:
        phi = float(over_rows(data, lambda t, y, capacity, x: np.array([np.sum(np.broadcast_to(phi_of(uk, capacity), len(t)))]))[0] / n_rows)
    forget(data.sparkSession, since)
    theta = lb + (ub - lb) * expit(u)
    beta = np.zeros(K)
    beta[live] = theta[2 + S_ :] / q
    kappa = float(kappa_top * expit(np.array(uk))) if has_kappa else None
    return {
        "k": float(theta[0]), "m": float(theta[1]), "delta": theta[2 : 2 + S_].tolist(), "changepoints": [int(c) for c in cps], "beta": beta.tolist(),
        "kappa": kappa, "phi": phi, "linked_offset": offset, "linked_scale": scale, "y_mean": ybar, "variance_bound": v,
        "t_max": t_max, "n_obs": n_rows, "objective": now, "steps": step_no, "draws": [],
    }
