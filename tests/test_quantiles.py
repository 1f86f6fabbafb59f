import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions import quantiles as Q

PROBABILITIES = {"low": 0.0, "a": 0.3, "median": 0.5, "b": 0.997, "high": 1.0}


def groups(seed):
    rng = np.random.default_rng(seed)
    yield "one", [3.5]
    yield "two", [2.0, -1.0]
    yield "none", [None, None]
    yield "few", [None, *rng.normal(size=30).tolist()]
    yield "many", rng.lognormal(0, 30, 6000).tolist()
    yield "ties", np.repeat([1.0, 2.0, 3.0, 1e300], [4000, 1, 4000, 2]).tolist()
    yield "same", [7.25] * 6000
    yield "edge", [0.0] * 3000 + np.arange(1, 3001).tolist()
    yield "tiny", (5e-324 * rng.integers(0, 3000, 9000)).tolist()
    yield None, rng.integers(-50, 50, 5000).astype(float).tolist()


@pytest.mark.parametrize("few,steps", [(1024, 64), (32, 16)])
def test_as_percentile(spark, monkeypatch, few, steps):
    monkeypatch.setattr(Q, "FEW", few)
    monkeypatch.setattr(Q, "STEPS", steps)
    rows = [(g, None if v is None else float(v)) for g, vs in groups(few) for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r["g"]: r for r in Q.exact_quantiles(df, "v", PROBABILITIES, ["g"]).collect()}
    want = {r["g"]: r for r in df.groupBy("g").agg(*(F.percentile("v", q).alias(n) for n, q in PROBABILITIES.items())).collect()}
    assert got.keys() == want.keys() and len(got) == 10
    for g, r in want.items():
        for n in PROBABILITIES:
            assert (got[g][n] is None and r[n] is None) or got[g][n] == r[n] or math.isclose(got[g][n], r[n], rel_tol=1e-14), (g, n)


def test_without_keys_and_by_several(spark):
    df = spark.range(5000).selectExpr("id % 977 AS v", "id % 2 AS a", "CASE WHEN id % 3 > 0 THEN id % 3 END AS b")
    assert Q.exact_quantiles(df, "v", {"m": 0.5}).collect() == df.agg(F.percentile("v", 0.5).alias("m")).collect()
    got = Q.exact_quantiles(df, F.col("v") * 2, {"m": 0.25}, ["a", "b"])
    assert sorted(map(str, got.collect())) == sorted(map(str, df.groupBy("a", "b").agg(F.percentile(F.col("v") * 2, 0.25).alias("m")).collect()))
    assert Q.exact_quantiles(df.where("v < 0"), "v", {"m": 0.5}).collect() == [(None,)]
    assert Q.exact_quantiles(df.where("v < 0"), "v", {"m": 0.5}, ["a"]).collect() == []
    with pytest.raises(ValueError):
        Q.exact_quantiles(df, "v", {"m": 1.5})


def test_lists_are_bounded(spark, monkeypatch):
    """No group's list is longer than FEW, however many values it has."""
    monkeypatch.setattr(Q, "FEW", 64)
    seen = []
    real = Q.cut
    monkeypatch.setattr(Q, "cut", lambda df: seen.append(df.columns) or real(df))
    df = spark.range(20_000).selectExpr("xxhash64(id) AS v")
    asked = Q.exact_quantiles(df, "v", {"m": 0.37})
    assert asked.first()["m"] == df.agg(F.percentile(F.col("v").cast("double"), 0.37).alias("m")).first()["m"]
    rounds = sum(c[-2:] == ["a", "b"] for c in seen)
    assert 2 <= rounds <= 8


def test_all_values_are_read_by_the_first_round_only(spark, monkeypatch):
    """Later rounds read what is left around the ranks, and ranks between the same borders share a sketch."""
    monkeypatch.setattr(Q, "FEW", 64)
    sizes, sketched, real, sketch = [], [], Q.written, Q.F.percentile_approx
    monkeypatch.setattr(Q, "written", lambda df: sizes.append((out := real(df)).count()) or out)
    monkeypatch.setattr(Q.F, "percentile_approx", lambda *a: sketched.append(1) or sketch(*a))
    df = spark.range(100_000).selectExpr("id % 2 AS g", "xxhash64(id) AS v")
    asked = {"low": 0.01, "m": 0.37, "high": 0.99}
    got = sorted(map(tuple, Q.exact_quantiles(df, "v", asked, ["g"]).collect()))
    assert got == sorted(map(tuple, df.groupBy("g").agg(*(F.percentile(F.col("v").cast("double"), q).alias(n) for n, q in asked.items())).collect()))
    assert sizes[0] == 100_000 and sizes[1] <= 100_000 * 6 * 4 / Q.STEPS and len(sizes) == len(sketched) + 1 <= 4
