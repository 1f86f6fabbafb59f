from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tidecast as T
from tests.test_fit import simulated
from tidecast.operators import fit as fitting
from tidecast.operators import longfit
from tidecast.operators.families import FAMILIES
from tidecast.operators.fit import Series, changepoint_positions, fit_series, linked

START = datetime(2020, 1, 1)


def frame(spark, t, y, cap, x):
    rows = [(int(a), float(b), float(c), list(map(float, d))) for a, b, c, d in zip(t, y, cap, x)]
    return spark.createDataFrame(rows, "t bigint, y double, capacity double, x array<double>").repartition(3)


@pytest.mark.parametrize(("name", "mode"), [*((n, "MAP") for n in FAMILIES), ("normal", "MLE"), ("poisson", "MLE")])
def test_same_optimum_as_in_one_task(spark, monkeypatch, name, mode):
    """With changepoints, a feature that does not vary, and blocks of a few rows."""
    monkeypatch.setattr(longfit, "BLOCK", 64)
    rng = np.random.default_rng(8)
    t, y, cap, _ = simulated(name, rng, 300)
    x = np.c_[np.sin(2 * np.pi * t / 7), np.ones(300), 10 * np.cos(2 * np.pi * t / 7)]
    spec = T.ModelSpec(model=name, n_changepoints=4)
    cps = changepoint_positions(t, 4, 0.8)
    want = fit_series(Series(t, y, cap, x, cps), spec, [3.0, 3.0, 1.0], mode)
    got = longfit.fit_across(frame(spark, t, y, cap, x), spec, [3.0, 3.0, 1.0], None, linked, mode)
    assert got.keys() == want.keys() and got["changepoints"] == want["changepoints"] and (got["t_max"], got["n_obs"]) == (want["t_max"], want["n_obs"])
    assert got["objective"] == pytest.approx(want["objective"], abs=1e-6, rel=1e-9)
    for c in ("linked_offset", "linked_scale", "y_mean", "variance_bound"):
        assert got[c] == pytest.approx(want[c], rel=1e-8)
    scale = want["linked_scale"]
    line = lambda p: p["k"] * t + p["m"] + np.maximum(t[:, None] - cps, 0) @ p["delta"] + x @ p["beta"]
    assert np.abs(line(got) - line(want)).max() * scale < 2e-4 and got["beta"][1] == 0
    for c in ("kappa", "phi"):
        assert (got[c] is None) == (want[c] is None) and (got[c] is None or got[c] == pytest.approx(want[c], rel=1e-4))


def test_to_the_sixth_digit(spark):
    """A smooth objective (no changepoints), where the optimum is sharp."""
    rng = np.random.default_rng(9)
    t, y, cap, _ = simulated("poisson", rng, 2000)
    x = np.c_[np.sin(2 * np.pi * t / 7), np.cos(2 * np.pi * t / 7)]
    spec = T.ModelSpec(model="poisson", n_changepoints=0)
    want = fit_series(Series(t, y, cap, x, t[:0]), spec, [3.0, 3.0])
    got = longfit.fit_across(frame(spark, t, y, cap, x), spec, [3.0, 3.0], None, linked)
    assert np.allclose([got["k"] * 1999, got["m"], *got["beta"]], [want["k"] * 1999, want["m"], *want["beta"]], rtol=1e-6, atol=1e-6)


def history(spark, n=400):
    rng = np.random.default_rng(5)
    rows = [(START + timedelta(days=i), int(rng.poisson(20 + 5 * np.sin(2 * np.pi * i / 7)))) for i in range(n) if i % 11]
    return spark.createDataFrame(rows, "ds timestamp_ntz, y bigint").repartition(4)


def test_fit_takes_it_for_long_histories(spark, monkeypatch):
    df, spec = history(spark), T.ModelSpec(model="poisson", n_changepoints=3, trend_samples=20).add_seasonality("weekly", "7d", 2)
    calls = []
    real = fitting.fit_across
    monkeypatch.setattr(fitting, "fit_across", lambda *a: calls.append(1) or real(*a))
    small = T.fit(df, spec)
    assert not calls
    monkeypatch.setattr(fitting, "LONG", 100)
    long = T.fit(df, spec)
    assert calls == [1] and long.params.schema == small.params.schema
    one, two = (T.predict(m, history=df, periods=5).orderBy("ds").toPandas() for m in (small, long))
    pd.testing.assert_series_equal(one["yhat"], two["yhat"], rtol=1e-4)
    assert "FlatMapGroupsInPandas" not in long.params._jdf.queryExecution().toString()
    given = T.ModelSpec(model="poisson", changepoints=(START + timedelta(days=50), START + timedelta(days=200)))
    assert T.fit(df, given, across=True).params.first()["changepoints"] == T.fit(df, given, across=False).params.first()["changepoints"]
    with pytest.raises(ValueError):
        T.fit(df, spec, across=True, use_laplace=True)
    with pytest.raises(ValueError):
        T.fit(df.withColumn("k", F.lit(1)), T.ModelSpec(keys=("k",)), across=True)


def test_places_of_changepoints(spark):
    t = np.arange(0, 3000, 3)
    df = spark.createDataFrame([(int(i),) for i in t], "t bigint").repartition(5)
    for n, share in ((0, 0.8), (5, 0.8), (25, 0.37), (2000, 0.9)):
        assert longfit.places_of_changepoints(df, len(t), n, share).tolist() == changepoint_positions(t, n, share).tolist()
