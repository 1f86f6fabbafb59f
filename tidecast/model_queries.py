"""Queries that hold the estimator and the scoring against SQL.

Fits of a level and a slope, without features, have an optimum that SQL finds by itself: a recursive query takes Newton steps (of bounded length) in
slope and offset, and after the first of them narrows a bracket of the dispersion by comparing the objective at nine points. The forecasts are
then rebuilt from that optimum. Scoring with fixed parameters is rebuilt term by term.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.columns import tidy
from tidecast.operators import diagnostics as diag
from tidecast.operators.fit import FittedModel, bounds, fit
from tidecast.operators.predict import predict
from tidecast.plans.spec import ModelSpec

#: The 0.9 quantile of the standard normal distribution; a fixed value.
Z = 1.2815515655446004
EPS = "1e-10::DOUBLE"
STEPS = 45


def digamma(x: str) -> str:
    return f"(ln({x} + 6) - 1 / (2 * ({x} + 6)) - 1 / (12 * pow({x} + 6, 2)) + 1 / (120 * pow({x} + 6, 4)) - 1 / (252 * pow({x} + 6, 6)) + 1 / (240 * pow({x} + 6, 8))" + "".join(f" - 1 / ({x} + {i})" for i in range(6)) + ")"


def trigamma(x: str) -> str:
    return f"(1 / ({x} + 6) + 1 / (2 * pow({x} + 6, 2)) + 1 / (6 * pow({x} + 6, 3)) - 1 / (30 * pow({x} + 6, 5))" + "".join(f" + 1 / pow({x} + {i}, 2)" for i in range(6)) + ")"


LINK = {"identity": "v0", "log": "ln(v0)", "logit": "ln(v0 / (1 - v0))"}
A, B = "(mu * phi)", "((1 - mu) * phi)"
#: By family: link and inverse, whether it counts out of n, phi from kap, largest kap, log-likelihood, its derivative by eta, its
#: weight, and the probability of a count x. mu is the inverse link of eta.
SQL: dict[str, dict[str, str]] = {
    "normal": {"phi": "sqrt(v) * kap", "ll": "-0.5 * pow((y - mu) / phi, 2) - ln(phi)", "g": "(y - mu) / pow(phi, 2)", "w": "1 / pow(phi, 2)"},
    "poisson": {"ll": "y * eta - mu", "g": "y - mu", "w": "mu", "pmf": "exp(x * ln(mean) - mean - lgamma(x + 1))"},
    "binomial": {"ll": "0", "g": "y - n * mu", "w": "n * mu * (1 - mu)", "pmf": "CASE WHEN x > n THEN 0 ELSE exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(mean / n) + (n - x) * ln(1 - mean / n)) END"},
    "negative binomial": {
        "phi": "pow(ybar, 2) / (greatest(v - ybar, 1e-3 * ybar) * pow(kap, 2))", "ll": "lgamma(y + phi) - lgamma(phi) + phi * ln(phi / (phi + mu)) + y * (eta - ln(phi + mu))",
        "g": "(y - mu) * phi / (phi + mu)", "w": "mu * phi / (phi + mu)", "pmf": "exp(lgamma(x + phi) - lgamma(phi) - lgamma(x + 1) + phi * ln(phi / (phi + mean)) + x * ln(mean / (phi + mean)))",
    },
    "gamma": {"phi": "ybar / (v * pow(kap, 2))", "ll": f"{A} * ln(phi) - lgamma({A}) + ({A} - 1) * ln(y) - phi * y", "g": f"{A} * (ln(phi) - {digamma(A)} + ln(y))", "w": f"pow({A}, 2) * {trigamma(A)}"},
    "beta": {
        "phi": "greatest(ybar * (1 - ybar) / (v * pow(kap, 2)) - 1, 1e-6)", "top": "least(ybar * (1 - ybar) / v - 1e-9, 2.0)",
        "ll": f"lgamma(phi) - lgamma({A}) - lgamma({B}) + ({A} - 1) * ln(y) + ({B} - 1) * ln(1 - y)", "g": f"phi * (ln(y / (1 - y)) - {digamma(A)} + {digamma(B)}) * mu * (1 - mu)",
        "w": f"pow(phi * mu * (1 - mu), 2) * ({trigamma(A)} + {trigamma(B)})",
    },
    "beta-binomial": {
        "phi": "greatest(4 * (n - 1) / (greatest(n, 1) * pow(kap, 2)) - 1, 1e-6)", "ll": f"lgamma(y + {A}) + lgamma(n - y + {B}) - lgamma(n + phi) + lgamma(phi) - lgamma({A}) - lgamma({B})",
        "g": f"phi * ({digamma(f'(y + {A})')} - {digamma(A)} - {digamma(f'(n - y + {B})')} + {digamma(B)}) * mu * (1 - mu)", "w": "n * mu * (1 - mu) / (1 + (n - 1) / (phi + 1))",
        "pmf": "CASE WHEN x > n THEN 0 ELSE exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + lgamma(x + mean / n * phi) + lgamma(n - x + (1 - mean / n) * phi) - lgamma(n + phi) + lgamma(phi) - lgamma(mean / n * phi) - lgamma((1 - mean / n) * phi)) END",
    },
}
LINKS = {"normal": "identity", "poisson": "log", "negative binomial": "log", "gamma": "log", "binomial": "logit", "beta": "logit", "beta-binomial": "logit"}
COUNTS_OF = ("binomial", "beta-binomial")


def inverse(model: str, x: str) -> str:
    return {"identity": x, "log": f"exp({x})", "logit": f"(1 / (1 + exp(-({x}))))"}[LINKS[model]]


def fitted_sql(model: str, series: str, step_us: int, head: str = "") -> str:
    """WITH RECURSIVE ... up to ``fit``: key, k, m, kap, o, s, ybar, v, lo, hi of each series of ``series`` (key, ds, y, n)."""
    f = SQL[model]
    v = ("y / CASE WHEN n = 0 THEN 1e-10 ELSE n END" if model in COUNTS_OF else "y") + "::DOUBLE"
    if model != "normal":
        v = f"CASE WHEN {v} = 0 THEN {EPS} ELSE {v} END"
    if LINKS[model] == "logit":
        v = f"CASE WHEN {v} = 1 THEN 1 - {EPS} ELSE {v} END"
    metric = {"gamma": f"greatest(y, {EPS})", "beta": f"least(greatest(y, {EPS}), 1 - {EPS})"}.get(model, "y::DOUBLE")
    size = "n" if model in COUNTS_OF else "1"
    mu = inverse(model, "(o + s * (k * t + m))")
    point = f"SELECT *, o + s * (k * t + m) AS eta, {mu} AS mu"
    phi = f.get("phi", "1.0::DOUBLE")
    prior = "4 * {p} - 1 / ({p} + 0.5) + 1 / (0.5 - {p})"
    choose = f"SELECT key, i, k, m, lo, hi, top, kap FROM it WHERE i < {STEPS}"
    if "phi" in f:
        choose = f"""SELECT key, i, k, m, lo, hi, top, arg_min(kap, obj) AS kap FROM (
          SELECT key, i, k, m, lo, hi, top, kap, 0.5 * kap - ln(kap) - ln(top - kap) - sum({f['ll']}) AS obj FROM (
            SELECT *, {phi} AS phi FROM ({point} FROM (SELECT it.* EXCLUDE (kap), lo + (hi - lo) * j / 10.0 AS kap FROM it, range(1, 10) r(j) WHERE i < {STEPS}) JOIN data USING (key)))
          GROUP BY key, i, k, m, lo, hi, top, kap) GROUP BY key, i, k, m, lo, hi, top"""
    return f"""WITH RECURSIVE {head} points AS (SELECT key, ds, {metric} AS y, n::DOUBLE AS n, {v} AS v0 FROM {series}),
    linked AS (SELECT key, ds, y, n, (date_diff('microsecond', min(ds) OVER (PARTITION BY key), ds) // {step_us})::DOUBLE AS t, {LINK[LINKS[model]]} AS z FROM points),
    scaled AS (SELECT key, min(z) AS o, CASE WHEN max(z) > min(z) THEN max(z) - min(z) ELSE 1 END AS s, avg(y) AS ybar FROM linked GROUP BY key),
    start AS (SELECT key, any_value(o) AS o, any_value(s) AS s, any_value(ybar) AS ybar, least(greatest(regr_slope((z - o) / s, t), -0.499), 0.499) AS k0,
      least(greatest(regr_intercept((z - o) / s, t), 0.001), 0.999) AS m0 FROM linked JOIN scaled USING (key) GROUP BY key),
    spread AS (SELECT key, greatest(1.5 * var_pop(y - {size} * {inverse(model, '(o + s * (k0 * t + m0))')}), {EPS}) AS v FROM linked JOIN start USING (key) GROUP BY key),
    tops AS (SELECT *, {f.get('top', '2.0')}::DOUBLE AS top FROM start JOIN spread USING (key)),
    data AS (SELECT key, t, y, n, o, s, ybar, v FROM linked JOIN tops USING (key)),
    it AS (SELECT key, 0 AS i, k0 AS k, m0 AS m, top * 1e-5 AS lo, top * (1 - 1e-5) AS hi, top, 1.0::DOUBLE AS kap FROM tops
      UNION ALL
      SELECT key, i + 1, least(greatest(k - dk * least(1, 2 / far), -0.499999), 0.499999), least(greatest(m - dm * least(1, 2 / far), 1e-6), 1 - 1e-6),
        CASE WHEN i < 12 THEN lo ELSE greatest(kap - 0.3 * (hi - lo), top * 1e-9) END, CASE WHEN i < 12 THEN hi ELSE least(kap + 0.3 * (hi - lo), top * (1 - 1e-9)) END, top, kap
      FROM (SELECT *, s * (abs(dk) * last + abs(dm)) + 1e-300 AS far FROM (SELECT *, (hmm * gk - hkm * gm) / (hkk * hmm - hkm * hkm) AS dk, (hkk * gm - hkm * gk) / (hkk * hmm - hkm * hkm) AS dm FROM (
        SELECT key, i, k, m, lo, hi, top, kap, any_value(s) AS s, max(t) AS last, {prior.format(p='k')} - sum(g * s * t) AS gk, 4 * (m - 0.5) - 1 / m + 1 / (1 - m) - sum(g * s) AS gm,
          4 + 1 / pow(k + 0.5, 2) + 1 / pow(0.5 - k, 2) + sum(w * s * s * t * t) AS hkk, sum(w * s * s * t) AS hkm, 4 + 1 / pow(m, 2) + 1 / pow(1 - m, 2) + sum(w * s * s) AS hmm
        FROM (SELECT *, {f['g']} AS g, {f['w']} AS w FROM (SELECT *, {phi} AS phi FROM ({point} FROM ({choose}) JOIN data USING (key))))
        GROUP BY key, i, k, m, lo, hi, top, kap)))),
    fit AS (SELECT key, k, m, kap, o, s, ybar, v FROM it JOIN tops USING (key) WHERE i = {STEPS})"""


def observed_sql(model: str, rows: str) -> str:
    """CTEs up to ``bands``: every row of ``rows`` (with mean, n, phi; ``id`` tells rows apart) with its 0.1 and 0.9 quantiles."""
    if model == "normal":
        return f"bands AS (SELECT *, mean - {Z} * phi AS low, mean + {Z} * phi AS high FROM {rows})"
    return f"""cdf AS (SELECT id, x, sum({SQL[model]['pmf']}) OVER (PARTITION BY id ORDER BY x) AS p FROM {rows}, range(0, (SELECT (max(mean) * 4 + 60)::BIGINT FROM {rows})) r(x)),
    quant AS (SELECT id, (min(x) FILTER (p >= 0.1))::DOUBLE AS low, (min(x) FILTER (p >= 0.9))::DOUBLE AS high FROM cdf GROUP BY id),
    bands AS (SELECT * FROM {rows} JOIN quant USING (id))"""


def line(model: str, **more: object) -> ModelSpec:
    return ModelSpec(model=model, n_changepoints=0, **more)


def register(query, sources: dict) -> None:  # noqa: ANN001
    """Register the queries; ``sources`` has the series' functions and SQL."""
    s1, s2, s4, beta_rows = sources["s1"], sources["s2"], sources["s4"], sources["daily_share"]
    hour, day = 3_600_000_000, 86_400_000_000
    daily = f"{sources['S1']}, own AS (SELECT 0 AS key, ds, y, 1 AS n FROM s1),"
    hourly = f"{sources['S4']}, own AS (SELECT 0 AS key, ds, y, capacity AS n FROM s4),"
    share = f"{sources['SHARE']}, own AS (SELECT 0 AS key, ds, y, 1 AS n FROM share),"
    plans = {m: (s1, daily, day, {}) for m in ("normal", "poisson", "negative binomial", "gamma")}
    plans |= {m: (s4, hourly, hour, {"sampling_period": "1h", "capacity_name": "capacity"}) for m in COUNTS_OF} | {"beta": (beta_rows, share, day, {})}

    def history(model: str, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = plans[model][0](spark, sf_dir)
        return rows.withColumn("y", F.col("y").cast("double")) if model == "gamma" else rows

    def fit_query(model: str) -> None:
        _, head, step, more = plans[model]
        kap = "round(kap, 4)" if "phi" in SQL[model] else "NULL::DOUBLE"
        bound = "round(v, 4)"
        sql = f"{fitted_sql(model, 'own', step, head)} SELECT round(k * (SELECT max(t) FROM linked), 4) + 0.0 AS rise, round(m, 4) AS m, {kap} AS kappa, {bound} AS variance_bound FROM fit"

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            p = fit(history(model, spark, sf_dir), line(model, **more)).params
            return p.select(tidy(F.col("k") * F.col("t_max"), 4).alias("rise"), F.round("m", 4).alias("m"), F.round("kappa", 4).alias("kappa"), F.round("variance_bound", 4).alias("variance_bound"))

        query(sql, f"fit_line_{model.replace(' ', '_').replace('-', '_')}")(run)

    def forecast_query(model: str) -> None:
        """Point path and bands of the fitted line: the history, and where no capacity is needed 14 steps more."""
        _, head, step, more = plans[model]
        size = "n" if model in COUNTS_OF else "1"
        ahead = "" if model in COUNTS_OF else f" UNION ALL SELECT 0, max(ds) + to_microseconds(j * {step}), 1.0 FROM linked, range(1, 15) r(j) GROUP BY j"
        every = f"every AS (SELECT key, ds, n FROM linked{ahead})"
        phi = SQL[model].get("phi", "1.0")
        scored = f"""scored AS (SELECT *, {size} * {inverse(model, 'eta')} AS mean, {phi} AS phi FROM (
          SELECT row_number() OVER (ORDER BY ds) AS id, ds, n, o + s * (k * (date_diff('microsecond', min(ds) OVER (), ds) // {step}) + m) AS eta, kap, v, ybar FROM every JOIN fit USING (key)))"""
        with_bands = model == "normal" or "pmf" in SQL[model]
        digits = 2 if model == "gamma" else 3
        columns = f"ds, round(mean, {digits}) + 0.0 AS yhat, round(eta, {digits}) + 0.0 AS yhat_linked, round(mean, {digits}) + 0.0 AS trend_upper" + (", round(low, 3) + 0.0 AS observed_lower, round(high, 3) + 0.0 AS observed_upper" if with_bands else "")
        sql = f"{fitted_sql(model, 'own', step, head)}, {every}, {scored}" + (f", {observed_sql(model, 'scored')} SELECT {columns} FROM bands" if with_bands else f" SELECT {columns} FROM scored")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = history(model, spark, sf_dir)
            fitted = fit(rows, line(model, **more))
            out = predict(fitted, rows) if more else predict(fitted, history=rows, periods=14)
            return out.select("ds", *(tidy(F.col(c), digits).alias(c) for c in ("yhat", "yhat_linked", "trend_upper", *(("observed_lower", "observed_upper") if with_bands else ()))))

        query(sql, f"forecast_line_{model.replace(' ', '_').replace('-', '_')}")(run)

    for model in SQL:
        fit_query(model)
        forecast_query(model)

    # -- one long series, fitted across the executors

    minute = 60_000_000
    minutes = f"{sources['MINUTES']}, own AS (SELECT 0 AS key, ds, y, 1 AS n FROM minutes),"

    def across_query(model: str) -> None:
        kap = "round(kap, 3)" if "phi" in SQL[model] else "NULL::DOUBLE"

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = sources["minutes"](spark, sf_dir)
            p = fit(rows.withColumn("y", F.col("y").cast("double")) if model == "gamma" else rows, line(model, sampling_period="1m"), across=True).params
            return p.select(tidy(F.col("k") * F.col("t_max"), 4).alias("rise"), F.round("m", 4).alias("m"), F.round("kappa", 3).alias("kappa"), F.round("variance_bound", 4).alias("variance_bound"), "n_obs")

        sql = f"""{fitted_sql(model, 'own', minute, minutes)} SELECT round(k * (SELECT max(t) FROM linked), 4) + 0.0 AS rise, round(m, 4) AS m, {kap} AS kappa, round(v, 4) AS variance_bound,
            (SELECT count(*) FROM linked) AS n_obs FROM fit"""
        query(sql, f"fit_line_across_{model.replace(' ', '_')}")(run)

    for model in ("normal", "poisson", "gamma"):
        across_query(model)

    # -- many series, saved models, anomalies and folds, by the same SQL

    many = f"{sources['S2']}, own AS (SELECT event_type AS key, ds, y, 1 AS n FROM s2),"

    def fit_line_many_series(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = fit(s2(spark, sf_dir), line("poisson", sampling_period="1h", keys=("event_type",))).params
        return p.select(F.col("_key0").alias("event_type"), tidy(F.col("k") * F.col("t_max"), 4).alias("rise"), F.round("m", 4).alias("m"), "n_obs")

    query(f"{fitted_sql('poisson', 'own', hour, many)} SELECT key AS event_type, round(k * max(t), 4) + 0.0 AS rise, round(m, 4) AS m, count(*) AS n_obs FROM fit JOIN linked USING (key) GROUP BY key, k, m")(fit_line_many_series)

    normal = fitted_sql("normal", "own", day, daily)
    band = f"""scored AS (SELECT ds, y, o + s * (k * t + m) AS yhat, {Z} * sqrt(v) * kap AS half FROM linked JOIN fit USING (key))"""

    def anomalies_line(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = s1(spark, sf_dir)
        return diag.anomalies(predict(fit(rows, line("normal")), rows), rows).select("ds", "y", F.round("yhat", 3).alias("yhat"))

    query(f"{normal}, {band} SELECT ds, y::BIGINT AS y, round(yhat, 3) AS yhat FROM scored WHERE y > yhat + half OR y < yhat - half")(anomalies_line)

    def saved_model_line(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Fitted, written to the shared folder, read back, and scored."""
        import uuid

        from tidecast.functions.storage import shared_folder
        from tidecast.sources.tables import load_model, model_from_json, model_to_json, save_model

        rows, path = s1(spark, sf_dir), f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
        save_model(fit(rows, line("normal")), path)
        model = model_from_json(spark, model_to_json(load_model(spark, path)))
        return predict(model, history=rows, periods=7, include_history=False).select("ds", F.round("yhat", 3).alias("yhat"))

    query(f"{normal} SELECT max(ds) + to_microseconds(j * {day}) AS ds, round(any_value(o + s * m) + any_value(s * k) * (max(t) + j), 3) AS yhat FROM linked JOIN fit USING (key), range(1, 8) r(j) GROUP BY j")(saved_model_line)

    def cv_line(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Refits on folds of the last horizon: the forecast of each fold's test rows."""
        rows = s1(spark, sf_dir)
        cv = diag.cross_validation(fit(rows, line("poisson")), rows, "30d", "30d", "300d", cuts=[datetime(1997, 1, 1)])
        return cv.select("ds", "cutoff", "y", F.round("yhat", 3).alias("yhat"))

    early = f"{sources['S1']}, own AS (SELECT 0 AS key, ds, y, 1 AS n FROM s1 WHERE ds <= TIMESTAMP '1997-01-01'),"
    query(f"""{fitted_sql('poisson', 'own', day, early)} SELECT s1.ds, TIMESTAMP '1997-01-01' AS cutoff, s1.y::DOUBLE AS y, round(exp(o + s * (k * (date_diff('day', (SELECT min(ds) FROM s1), s1.ds)) + m)), 3) AS yhat
        FROM s1, fit WHERE s1.ds > TIMESTAMP '1997-01-01' AND s1.ds <= TIMESTAMP '1997-01-31'""")(cv_line)

    # -- scoring with fixed parameters

    spec = ModelSpec(n_changepoints=2, trend_samples=0).add_seasonality("weekly", "7d", 1)
    k, m, cps, delta, beta = 0.0001, 0.4, (300, 700), (0.0003, -0.0005), (0.05, -0.1)
    offsets = {"normal": (4.0, 6.0, 1.5), "poisson": (1.0, 1.5, None), "binomial": (-2.0, 1.0, None), "negative binomial": (1.0, 1.5, 8.0), "gamma": (1.0, 1.5, 2.0), "beta": (-1.0, 2.0, 30.0), "beta-binomial": (-2.0, 1.0, None)}

    def score_query(model: str) -> None:
        off, scale, phi = offsets[model]
        counts, with_bands = model in COUNTS_OF, model == "normal" or "pmf" in SQL[model]
        trend = f"({k} * t + {m} + " + " + ".join(f"{d} * greatest(t - {c}, 0)" for c, d in zip(cps, delta, strict=True)) + ")::DOUBLE"
        eta = f"({off} + {scale} * ({trend} + {beta[0]} * sin(2 * pi() / 7.0 * t) + {beta[1]} * cos(2 * pi() / 7.0 * t)))::DOUBLE"
        size = "40" if counts else "1"
        phi_sql = SQL[model]["phi"].replace("kap", "0.7").replace("n", "40") if model == "beta-binomial" else f"{phi or 1.0}"
        scored = f"scored AS (SELECT row_number() OVER (ORDER BY ds) AS id, ds, 40.0::DOUBLE AS n, {eta} AS eta, {off} + {scale} * {trend} AS eta_trend, ({phi_sql})::DOUBLE AS phi FROM t1)"
        means = f"means AS (SELECT *, {size} * {inverse(model, 'eta')} AS mean, {size} * {inverse(model, 'eta_trend')} AS trend FROM scored)"
        names = {"yhat": "mean", "yhat_lower": "mean", "yhat_upper": "mean", "yhat_linked": "eta", "trend": "trend", "trend_lower": "trend", "trend_upper": "trend", "trend_linked": "eta_trend", "yhat_linked_lower": "eta", "yhat_linked_upper": "eta", "trend_linked_lower": "eta_trend", "trend_linked_upper": "eta_trend"}
        names |= {"observed_lower": "low", "observed_upper": "high"} if with_bands else {}
        columns = "ds, " + ", ".join(f"round({v}, 5) + 0.0 AS {c}" for c, v in names.items())
        sql = f"WITH {sources['T1']}, {scored}, {means}" + (f", {observed_sql(model, 'means')} SELECT {columns} FROM bands" if with_bands else f" SELECT {columns} FROM means")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            rows = s1(spark, sf_dir).select("ds")
            lo, hi = bounds(rows, "ds")
            row = (lo, 40.0 if counts else None, k, m, list(delta), list(cps), list(beta), 0.7 if model == "beta-binomial" else None, float(phi) if phi else None, off, scale, 10**6, 1000, [])
            params = spark.createDataFrame([row], "t0 timestamp_ntz, capacity_fixed double, k double, m double, delta array<double>, changepoints array<bigint>, beta array<double>, kappa double, phi double, linked_offset double, linked_scale double, t_max bigint, n_obs bigint, draws array<array<double>>")
            from dataclasses import replace

            model_of = FittedModel(replace(spec, model=model), params, lo, hi, {"use_laplace": False})
            return predict(model_of, rows).select("ds", *(tidy(F.col(c), 5).alias(c) for c in names))

        query(sql, f"score_{model.replace(' ', '_').replace('-', '_')}")(run)

    for model in SQL:
        score_query(model)
