import json
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import tidecast as T
from tidecast.operators.families import FAMILIES, INVERSE
from tidecast.operators.fit import Series, changepoint_positions, fit_series
from tidecast.operators.predict import simulate_trend
from tidecast.plans.config import settings

START = datetime(2020, 1, 1)


@pytest.mark.parametrize("name", FAMILIES)
def test_derivatives(name):
    f, rng = FAMILIES[name], np.random.default_rng(0)
    eta = rng.normal(0.3, 0.4, 40)
    n = np.full(40, 30.0)
    y = {"normal": rng.normal(size=40), "gamma": rng.gamma(2, size=40), "beta": rng.beta(2, 3, size=40)}.get(name, rng.integers(0, 20, 40).astype(float))
    phi = 3.0
    ll, g, w = f.parts(y, eta, phi, n)
    h = 1e-5
    assert np.allclose(g, (f.parts(y, eta + h, phi, n)[0] - f.parts(y, eta - h, phi, n)[0]) / (2 * h), rtol=1e-4, atol=1e-5)
    assert (w > 0).all() and np.isfinite(ll).all()


def simulated(name, rng, n=500):
    t = np.arange(n)
    eta = {"identity": 20.0, "log": 3.0, "logit": 0.2}[FAMILIES[name].link] + 0.4 * np.sin(2 * np.pi * t / 7) + np.where(t < 200, t * 0.002, 0.4 + (t - 200) * -0.001)
    mu, cap = INVERSE[FAMILIES[name].link](eta), np.full(n, 50.0)
    y = {
        "normal": lambda: rng.normal(mu, 0.3), "poisson": lambda: rng.poisson(mu), "binomial": lambda: rng.binomial(50, mu), "negative binomial": lambda: rng.negative_binomial(8, 8 / (8 + mu)),
        "gamma": lambda: rng.gamma(mu * 2, 0.5), "beta": lambda: rng.beta(mu * 40, (1 - mu) * 40), "beta-binomial": lambda: rng.binomial(50, rng.beta(mu * 40, (1 - mu) * 40)),
    }[name]()
    return t, y.astype(float), cap, mu * (50 if FAMILIES[name].counts_of else 1)


@pytest.mark.parametrize("name", FAMILIES)
def test_recovery_and_coverage(name):
    rng = np.random.default_rng(3)
    t, y, cap, mean = simulated(name, rng)
    spec = T.ModelSpec(model=name, n_changepoints=10, trend_samples=0)
    x = np.c_[np.sin(2 * np.pi * t / 7), np.cos(2 * np.pi * t / 7)]
    p = fit_series(Series(t, y, cap, x, changepoint_positions(t, 10, 0.8)), spec, [3.0, 3.0])
    from tidecast.operators.predict import score_series

    out = score_series(p, spec, t, x, cap)
    assert np.corrcoef(out["yhat"], mean)[0, 1] > 0.9
    covered = np.mean((y >= out["observed_lower"]) & (y <= out["observed_upper"]))
    assert 0.74 < covered < 0.93
    # The link's scale times beta is the seasonality's size.
    assert p["linked_scale"] * p["beta"][0] == pytest.approx(0.4, abs=0.12)


def history(spark, n=120, series=("a", "b")):
    rng = np.random.default_rng(5)
    rows = [(s, START + timedelta(days=i), int(rng.poisson(20 + 5 * np.sin(2 * np.pi * i / 7) + 4 * j)), 60, float(i % 5)) for j, s in enumerate(series) for i in range(n)]
    return spark.createDataFrame(rows, "k string, ds timestamp_ntz, y bigint, cap bigint, load double")


def test_same_result_however_dealt(spark):
    df = history(spark)
    spec = T.ModelSpec(model="poisson", keys=("k",), n_changepoints=3, trend_samples=50).add_seasonality("weekly", "7d", 2).add_external("load")
    one, two = (T.predict(T.fit(d, spec), d).orderBy("k", "ds").toPandas() for d in (df.coalesce(1), df.repartition(7).orderBy(F.rand(1))))
    pd.testing.assert_frame_equal(one, two, rtol=1e-6)


def test_future_band_and_laplace(spark):
    df = history(spark)
    spec = T.ModelSpec(model="normal", keys=("k",), n_changepoints=5, trend_samples=300).add_seasonality("weekly", "7d", 2)
    out = T.predict(T.fit(df, spec, use_laplace=True, draws=100), history=df, periods=40).toPandas()
    future = out[out.ds > START + timedelta(days=119)]
    assert len(future) == 80
    assert (out.yhat_lower <= out.yhat).all() and (out.yhat <= out.yhat_upper).all() and (out.observed_lower < out.observed_upper).all()
    t = np.arange(200)
    low, high = simulate_trend(t, 99, np.array([0.1, -0.2]), 20, 0.8, 500, 1)
    assert (low[:100] == 0).all() and (high[100:] >= 0).all() and high[-1] > high[110] and (np.array(simulate_trend(t, 99, np.array([0.1, -0.2]), 20, 0.8, 500, 1)) == [low, high]).all()


def test_capacity_binomial(spark):
    df = history(spark)
    by_column = T.fit(df, T.ModelSpec(model="binomial", keys=("k",), capacity_name="cap", n_changepoints=0, trend_samples=0))
    assert T.predict(by_column, df).where("observed_upper > 60").count() == 0
    by_value = T.fit(df, T.ModelSpec(model="beta-binomial", keys=("k",), n_changepoints=0, trend_samples=0), capacity=70)
    assert T.predict(by_value, history=df, periods=3).count() == 246
    with pytest.raises(ValueError):
        T.predict(by_column, history=df, periods=3)
    with pytest.raises(T.ValidationError):
        T.fit(df.withColumn("cap", F.lit(3)), T.ModelSpec(model="binomial", keys=("k",), capacity_name="cap"))


def test_cross_validation(spark):
    df = history(spark, 200)
    spec = T.ModelSpec(model="poisson", keys=("k",), n_changepoints=3, trend_samples=0).add_seasonality("weekly", "7d", 2)
    model = T.fit(df, spec)
    cv = T.cross_validation(model, df, "10d", "30d", "100d")
    assert cv.select("k", "cutoff").distinct().count() == 2 * 4
    m = T.performance_metrics(cv, "5d", ["mae", "nonsense", "coverage", "mae"], keys=["k"])
    assert m.columns == ["k", "horizon_us", "count", "mae", "coverage"] and m.count() == 4
    with pytest.raises(ValueError):
        T.cross_validation(model, df, "10d", cuts=[START])


def test_bad_histories(spark):
    df = history(spark, 20, "a").drop("k")
    spec = T.ModelSpec(model="poisson", n_changepoints=0)
    for bad in (df.limit(1), df.withColumn("y", F.when(F.col("y") > 20, F.col("y"))), df.withColumn("y", -F.col("y")), df.withColumn("ds", F.timestamp_add("SECOND", F.pmod("y", F.lit(7)).cast("int"), F.col("ds")))):
        with pytest.raises(T.ValidationError):
            T.fit(bad, spec)
    with pytest.raises(TypeError):
        T.fit(df.withColumn("y", F.col("y") / 2), spec)
    with pytest.raises(KeyError):
        T.fit(df.drop("y"), spec)
    with pytest.raises(NotImplementedError):
        T.fit(df.withColumn("ds", F.col("ds").cast("timestamp")), spec)
    with pytest.raises(T.NotFittedError):
        T.predict(spec, df)
    model = T.fit(df, spec)
    assert model.is_fitted and not spec.is_fitted and spec.panels == ["trend"]
    with pytest.raises(T.FittedError):
        T.fit(df, model)


def test_constant_and_degenerate(spark):
    df = history(spark, 30, "a").drop("k").withColumn("flat", F.lit(2.0)).withColumn("y", F.lit(5).cast("bigint"))
    spec = T.ModelSpec(model="normal", n_changepoints=40, trend_samples=0).add_external("flat")
    out = T.predict(T.fit(df, spec), df).toPandas()
    assert np.allclose(out.yhat, 5, atol=0.6)


def test_spec_and_files(spark, tmp_path):
    spec = T.ModelSpec(model="poisson", n_changepoints=2, trend_samples=0, meta={"a": 1}).add_seasonality("weekly", "1 w", 2).add_external("load", 0.7)
    spec = spec.add_event("launch", T.Exponential("1d", "3d"), anchors="2020-02-01").add_event("fair", T.BoxCar("2d"), "periodic", "2020-01-05", "30d").add_protocol(T.Calendric("US", profile=T.Gaussian("1d")))
    assert T.from_json(T.to_json(spec)) == spec
    T.to_json(spec, str(tmp_path / "s.json"))
    assert T.from_json(str(tmp_path / "s.json")) == spec
    df = history(spark, 60, "a").drop("k")
    model = T.fit(df, spec)
    T.save_model(model, str(tmp_path / "m"))
    again = T.load_model(spark, str(tmp_path / "m"))
    assert again.spec == model.spec
    pd.testing.assert_frame_equal(*(T.predict(m, df).orderBy("ds").toPandas() for m in (model, again)))
    for wrong in (lambda: T.ModelSpec(model="x"), lambda: T.ModelSpec(interval_width=1), lambda: spec.add_external("weekly"), lambda: spec.add_seasonality("trend", "1d", 1), lambda: spec.add_seasonality("s", "1 moon", 1), lambda: T.Gaussian("1d", 0)):
        with pytest.raises((ValueError, NotImplementedError)):
            wrong()


def test_toml(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("""
[model]
model = "binomial"
sampling_period = "1h"
nonsense = 3
[fit]
capacity = 100
[[seasonalities]]
name = "daily"
period = "1d"
order = 2
[[events]]
name = "e"
anchors = "2020-01-02"
profile = {type = "Cauchy", width = "2h"}
[[protocols]]
type = "Calendric"
country = "DE"
profile = {type = "BoxCar", width = "1d"}
""")
    spec, data = T.model_from_toml(str(path), n_changepoints=1)
    assert (spec.step_us, spec.n_changepoints, len(spec.seasonalities), spec.events[0].profile, spec.protocols[0].country) == (3_600_000_000, 1, 1, T.Cauchy("2h"), "DE")
    got = settings("fit", toml_path=str(path), optimize_mode="MLE", what=1)
    assert got == {"optimize_mode": "MLE", "use_laplace": False, "capacity": 100, "capacity_mode": None, "capacity_value": None}
    assert settings("fit", data, capacity_mode="factor", capacity_value=1.5)["capacity"] is None


def test_holidays_and_csv(spark, tmp_path):
    got = dict((n, d) for d, n in T.holidays("US", [2024]))
    assert (got["Thanksgiving Day"].day, got["Memorial Day"].day, got["Labor Day"].day) == (28, 27, 2)
    assert str(dict((n, d) for d, n in T.holidays("DE", [2025]))["Easter Monday"]) == "2025-04-21"
    assert ("Independence Day (observed)", "2021-07-05") in [(n, str(d)) for d, n in T.holidays("US", [2021])]
    with pytest.raises(NotImplementedError):
        T.holidays("XX", [2020])
    history(spark, 10, "a").select("ds", "y").write.csv(str(tmp_path / "c"), header=True)
    df = T.load_data(spark, str(tmp_path / "c"), dtype_kind="u")
    assert dict(df.dtypes) == {"ds": "timestamp_ntz", "y": "bigint"} and df.count() == 10
    json.dumps(T.ModelSpec().to_dict())
    assert replace(T.ModelSpec(), changepoints=(START,)).n_changepoints == 1


def test_streaming_scorer(spark, tmp_path):
    from tidecast.streaming.scorer import flag, on_grid

    events = spark.createDataFrame([(START + timedelta(minutes=30 * i), 1) for i in range(40)], "ts timestamp_ntz, v int")
    events.write.parquet(str(tmp_path / "in"))
    forecast = spark.createDataFrame([(START + timedelta(hours=h), 2.0, 1.0, 3.0 if h != 4 else 1.5) for h in range(20)], "ds timestamp_ntz, yhat double, observed_lower double, observed_upper double")
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    flagged = flag(on_grid(stream, "ts", "1h", F.count(F.lit(1)), lateness="10 minutes"), forecast)
    q = flagged.writeStream.format("memory").queryName("flagged").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("flagged").collect()
    assert len(rows) >= 18 and [r.ds for r in rows if r.is_anomaly] == [START + timedelta(hours=4)]


def test_settings_reach_fit_predict_and_load(spark, tmp_path):
    path, df = tmp_path / "c.toml", history(spark, 60, "a").drop("k")
    source = str(tmp_path / "c")
    df.select("ds", "y").write.csv(source, header=True)
    path.write_text(f'[model]\nmodel = "poisson"\nn_changepoints = 2\n[fit]\noptimize_mode = "MLE"\n[predict]\nperiods = 5\ninclude_history = false\n[load_data]\nsource = "{source}"\ndtype_kind = "u"\n[[seasonalities]]\nname = "w"\nperiod = "7d"\norder = 1\n')
    spec, _ = T.model_from_toml(str(path))
    rows = T.load_data(spark, config=spec.config)
    assert dict(rows.dtypes)["y"] == "bigint" and T.load_data(spark, dtype_kind="f", toml_path=str(path)).schema["y"].dataType.simpleString() == "double"
    model = T.fit(rows, spec)
    assert model.options["optimize_mode"] == "MLE" and T.fit(rows, spec, "MAP").options["optimize_mode"] == "MAP"
    assert T.predict(model, history=rows).count() == 5 and T.predict(model, history=rows, periods=2, include_history=True).count() == 62
    bare, left = T.model_from_toml(str(path), ignore=["seasonalities", "fit"])
    assert not bare.seasonalities and "fit" not in bare.config and "fit" not in left
    assert T.predict(T.fit(rows, bare), history=rows, toml_path=str(path)).count() == 5


def test_fitted_model_as_json(spark):
    df = history(spark, 50)
    model = T.fit(df, T.ModelSpec(model="poisson", keys=("k",), n_changepoints=2, trend_samples=20).add_seasonality("w", "7d", 1), use_laplace=True, draws=7)
    again = T.model_from_json(spark, T.model_to_json(model))
    assert again.spec == model.spec and again.params.schema == model.params.schema
    pd.testing.assert_frame_equal(*(T.predict(m, history=df, periods=3).orderBy("k", "ds").toPandas() for m in (model, again)))


def test_the_fit_runs_once(spark):
    """Scoring reads the checkpoint of the parameters; only the simulation of future trends is a grouped map."""
    df = history(spark, 50)
    model = T.fit(df, T.ModelSpec(model="normal", keys=("k",), n_changepoints=2, trend_samples=20))
    plan = T.predict(model, history=df, periods=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "FlatMapGroupsInPandas" not in plan and "FlatMapCoGroups" not in plan
    drawn = T.predict(T.fit(df, model.spec, use_laplace=True, draws=5), history=df, periods=3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in drawn and drawn.count("FlatMapCoGroupsInPandas") == 1


def test_deviations_in_blocks(monkeypatch):
    from tidecast.operators import predict as P

    whole = P.deviations(300, np.array([0.1, -0.3]), 50, 0.8, 4000, 3)
    monkeypatch.setattr(P, "AHEAD", 64)
    parts = P.deviations(300, np.array([0.1, -0.3]), 50, 0.8, 4000, 3)
    assert np.allclose(whole[1][20:], parts[1][20:], rtol=0.15) and (parts[0][20:] < 0).all() and (np.diff(parts[1]) > -1e-9).all()


@pytest.mark.parametrize("name", ["normal", "negative binomial", "gamma", "beta", "beta-binomial"])
def test_laplace_draws_the_dispersion(name):
    rng = np.random.default_rng(4)
    t, y, cap, _ = simulated(name, rng, 200)
    spec = T.ModelSpec(model=name, n_changepoints=0)
    s = Series(t, y, cap, np.empty((200, 0)), changepoint_positions(t, 0, 0.8))
    point, drawn = fit_series(s, spec, []), fit_series(s, spec, [], laplace=True, draws=400, seed=1)
    assert len(drawn["draws"]) == 400 and drawn["kappa"] != point["kappa"] and drawn["kappa"] == pytest.approx(point["kappa"], rel=0.1)
    assert drawn["phi"] == pytest.approx(point["phi"], rel=0.15) and np.std([d[1] for d in drawn["draws"]]) > 0


def test_cross_validation_extras_and_draws(spark):
    df = history(spark, 120)
    spec = T.ModelSpec(model="poisson", keys=("k",), n_changepoints=2, trend_samples=30)
    plain = T.cross_validation(T.fit(df, spec), df, "10d", "40d", "60d", extra=["load", "cap"]).toPandas()
    assert (plain.yhat_lower == plain.yhat).all() and set(plain.cap) == {60.0} and {"load", "cutoff", "observed_upper"} <= set(plain.columns)
    drawn = T.cross_validation(T.fit(df, spec, use_laplace=True, draws=50), df, "10d", "40d", "60d").toPandas()
    assert len(drawn) == len(plain) and (drawn.yhat_lower < drawn.yhat).all() and (drawn.yhat < drawn.yhat_upper).all()


@pytest.mark.parametrize("name", FAMILIES)
def test_optimum(name):
    """No direction from the optimum lowers the objective, which is written down here anew; nor does a long random search."""
    from tidecast.operators.fit import linked

    rng = np.random.default_rng(6)
    t, y, cap, _ = simulated(name, rng, 30)
    family, spec = FAMILIES[name], T.ModelSpec(model=name, n_changepoints=0)
    p = fit_series(Series(t, y, cap, np.empty((30, 0)), changepoint_positions(t, 0, 0.8)), spec, [])
    z = linked(family, y, cap)
    off, scale = z.min(), z.max() - z.min()
    ybar, v = y.mean(), p["variance_bound"]
    top = (family.kappa_top(ybar, v) if family.kappa_top else 2.0) if family.dispersion else None

    def objective(k, m, kappa):
        if not (-0.5 < k < 0.5 and 0 < m < 1 and (top is None or 0 < kappa < top)):
            return np.inf
        phi = family.dispersion(kappa, ybar, v, cap) if top else 1.0
        out = -family.parts(y, off + scale * (k * t + m), phi, cap)[0].sum() + 2 * k * k + 2 * (m - 0.5) ** 2 - np.log(k + 0.5) - np.log(0.5 - k) - np.log(m) - np.log(1 - m)
        return out + (kappa * 0.5 - np.log(kappa) - np.log(top - kappa) if top else 0)

    best = objective(p["k"], p["m"], p["kappa"])
    for size in (1e-4, 1e-3, 1e-2, 0.1, 0.5):
        for d in rng.normal(size=(400, 3)):
            assert objective(p["k"] + size * d[0] * 0.1, p["m"] + size * d[1], (p["kappa"] or 0) + size * d[2]) > best - 1e-6


def test_twins(spark):
    """The DataFrame functions say what the estimator's own steps say."""
    from tidecast.operators import trend as D
    from tidecast.operators.features import strengths
    from tidecast.operators.fit import linked
    from tidecast.operators.grid import time_index

    df = history(spark, 47, "a").drop("k")
    local = df.orderBy("ds").toPandas()
    t, y, cap = np.arange(47), local["y"].to_numpy(float), local["cap"].to_numpy(float)
    for n in (0, 3, 25, 60):
        got = [(r.ds - START).days for r in D.auto_changepoints(df, "ds", n).orderBy("changepoint_no").collect()]
        assert got == changepoint_positions(t, n, 0.8).tolist()
    for name, family in FAMILIES.items():
        values = linked(family, y, cap) if name != "beta" else linked(family, y / 100, cap)
        metric = F.col("y") / 100 if name == "beta" else F.col("y")
        rows = D.normalize(df, D.to_linked(metric, family.link, F.col("cap") if family.counts_of else None, family.lower, family.upper)).orderBy("ds").toPandas()
        assert np.allclose(rows["linked_offset"] + rows["linked_scale"] * rows["scaled"], values) and np.allclose(rows["linked_scale"], np.ptp(values))
    line = D.line_fit(time_index(df, "ds", "1d"), "t", "y").first()
    assert np.allclose(np.linalg.lstsq(np.c_[t, np.ones(47)], y, rcond=None)[0], [line.slope, line.intercept])
    norms = np.linalg.norm(local[["y", "cap", "load"]].to_numpy(float), axis=0)
    assert np.allclose([r.strength for r in strengths(df, ["y", "cap", "load"]).collect()], norms / np.median(norms))
    p = fit_series(Series(t, y, cap, np.c_[np.sin(t)], np.array([10, 20])), T.ModelSpec(model="poisson"), [3.0])
    made = spark.createDataFrame([(int(i), [float(np.sin(i))]) for i in t], "t bigint, x array<double>")
    lit = lambda v: F.array(*map(F.lit, v))
    eta = D.linear_predictor(D.trend(F.col("t"), F.lit(p["k"]), F.lit(p["m"]), lit(p["changepoints"]), lit(p["delta"])), F.col("x"), lit(p["beta"]), F.lit(p["linked_offset"]), F.lit(p["linked_scale"]))
    want = p["linked_offset"] + p["linked_scale"] * (p["k"] * t + p["m"] + np.maximum(t[:, None] - [10, 20], 0) @ p["delta"] + p["beta"][0] * np.sin(t))
    assert np.allclose([r[0] for r in made.orderBy("t").select(eta).collect()], want)


def test_own_profiles_events_and_protocols(spark):
    from dataclasses import dataclass

    from tidecast.functions.profiles import Profile

    @T.register_profile
    @dataclass(frozen=True)
    class Spike(Profile):
        def at(self, us):
            return F.when(us == 0, 1.0).otherwise(0.0)

    @T.register_protocol
    @dataclass(frozen=True)
    class Firsts:
        def to_dict(self):
            return {"type": "Firsts"}

        @staticmethod
        def from_dict(data):
            return Firsts()

        def settle(self, spec, history, lo, hi):
            return spec.add_event("first", Spike(), "month_start")

    T.register_event_kind("month_start", lambda e, lo, hi: [datetime(y, m, 1) for y in range(lo.year, hi.year + 1) for m in range(1, 13)])
    spec = T.ModelSpec(model="poisson", n_changepoints=0).add_protocol(Firsts())
    assert T.from_json(T.to_json(spec)) == spec
    df = history(spark, 100, "a").drop("k").withColumn("y", F.col("y") + F.when(F.dayofmonth("ds") == 1, 30).otherwise(0))
    model = T.fit(df, spec)
    assert [e.name for e in model.spec.events] == ["first"] and T.from_json(T.to_json(model.spec)) == model.spec
    out = {r.ds: r.yhat for r in T.predict(model, df).collect()}
    assert out[datetime(2020, 2, 1)] > 1.5 * out[datetime(2020, 2, 2)]


def test_logging_and_capacity_line(spark, tmp_path):
    import logging

    log = T.configure_logging("ERROR", "DEBUG", str(tmp_path / "log"))
    T.configure_logging("ERROR", "DEBUG", str(tmp_path / "log"))
    logging.getLogger("tidecast.x").info("a message")
    assert (tmp_path / "log").read_text().count("a message") == 1 and len([h for h in log.handlers if hasattr(h, "_of_tidecast")]) == 2
    for h in [h for h in log.handlers if hasattr(h, "_of_tidecast")]:
        log.removeHandler(h)
    df = history(spark, 30)
    spec = T.ModelSpec(model="binomial", keys=("k",), n_changepoints=0)
    assert {r.capacity for r in T.capacity_line(T.fit(df, spec, capacity=77), df).collect()} == {77.0}
    assert T.capacity_line(T.fit(df, replace(spec, capacity_name="cap")), df).columns == ["k", "ds", "capacity"]
    with pytest.raises(ValueError):
        T.capacity_line(T.fit(df, replace(spec, model="poisson")), df)


def test_more_holidays():
    on = lambda country, year, subdiv=None: {n: str(d) for d, n in T.holidays(country, [year], subdiv)}
    assert on("FR", 2024)["Ascension Day"] == "2024-05-09" and on("DE", 2024, "BY")["Corpus Christi"] == "2024-05-30" and "Corpus Christi" not in on("DE", 2024)
    assert on("DE", 2024, "SN")["Repentance and Prayer Day"] == "2024-11-20" and on("DE", 2023, "SN")["Repentance and Prayer Day"] == "2023-11-22"
    assert on("CA", 2024, "ON")["Victoria Day"] == "2024-05-20" and on("CA", 2025, "QC")["National Patriots' Day"] == "2025-05-19" and on("CA", 2024, "ON")["Thanksgiving Day"] == "2024-10-14"
    assert on("AU", 2024, "VIC")["Melbourne Cup Day"] == "2024-11-05" and on("US", 2024, "MA")["Patriots' Day"] == "2024-04-15" and on("PL", 2024)["Whit Sunday"] == "2024-05-19"
    assert "Reformation Day" not in on("DE", 2017, "HH") and on("DE", 2018, "HH")["Reformation Day"] == "2018-10-31"
    with pytest.raises(NotImplementedError):
        T.holidays("DE", [2024], "XX")
