import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidecast as T
from tidecast.functions.columns import diff_us, ntz
from tidecast.functions.durations import micros
from tidecast.operators import features as feats
from tidecast.operators.anchors import from_anchors
from tidecast.plans.spec import Event

START = datetime(1969, 12, 20)
PROFILES = [T.BoxCar("7h"), T.BoxCar("3d"), T.BoxCar("0h"), T.Gaussian("2h"), T.Gaussian("5h", 3), T.Exponential("1h", "9h"), T.Exponential(0, "2d"), T.Exponential("30m", 0), T.Exponential(0, 0)]


def value(p, us):
    name = type(p).__name__
    if name == "BoxCar":
        return float(0 <= us < micros(p.width))
    if name == "Gaussian":
        z = us / micros(p.width)
        return math.exp(-min((z * z / 2) ** p.order, 800))
    lead, lag = micros(p.lead), micros(p.lag)
    return (2 ** max(us / lead, -1200) if lead else 0) if us < 0 else (2 ** max(-us / lag, -1200) if lag else 0)


def data(n=120, m=300, seed=0):
    rng = np.random.default_rng(seed)
    at = lambda k, span: [START + timedelta(minutes=int(x)) for x in rng.integers(0, span, k)]
    rows = [(t, "ab"[i % 2], i) for i, t in enumerate(at(n, 60 * 24 * 40))] + [(None, "a", -1), (START + timedelta(days=300), "a", -2), (START - timedelta(days=300), "b", -3)]
    anchors = [(t, "ab"[i % 3 > 0]) for i, t in enumerate(at(m, 60 * 24 * 40))]
    anchors += anchors[:40] + [(rows[0][0], "a")] * 3 + [(None, "a"), (START + timedelta(days=20), "c")]
    return rows, anchors


@pytest.mark.parametrize("profile", PROFILES, ids=repr)
@pytest.mark.parametrize("keyed", [True, False])
def test_as_all_pairs(spark, profile, keyed):
    rows, anchors = data()
    df = spark.createDataFrame(rows, "ds timestamp_ntz, k string, i int").repartition(3)
    table = spark.createDataFrame(anchors, "at timestamp_ntz, k string").repartition(2)
    out = from_anchors(df, "ds", table, profile, "at", ["k"] if keyed else [], "v")
    assert out.columns == ["ds", "k", "i", "v"]
    got = {r.i: r.v for r in out.collect()}
    us = lambda d: (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds
    assert len(got) == len(rows)
    for ds, k, i in rows:
        want = math.fsum(value(profile, us(ds - a)) for a, o in anchors if a is not None and (o == k or not keyed)) if ds else 0.0
        assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-200), (ds, k)


def test_plan_does_not_grow(spark):
    df = spark.range(500).select(F.timestamp_add("MINUTE", "id", ntz(START)).alias("ds"))
    sizes = []
    for n in (10, 100_000):
        table = spark.range(n).select(F.timestamp_add("SECOND", F.col("id") * 7, ntz(START)).alias("at"))
        out = from_anchors(df, "ds", table, T.Exponential("1h", "2h"), "at")
        sizes.append(out._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert sizes[1] == sizes[0]
    assert out.count() == 500 and out.agg(F.max("value")).first()[0] > 1000
    periodic = [Event("e", "periodic", T.Gaussian("1h"), (START,), p * 3_600_000_000) for p in (2, 200)]
    plans = [str(feats.event_column(e, F.col("ds"), START, START + timedelta(days=3000))) for e in periodic]
    assert abs(len(plans[0]) - len(plans[1])) < 40


@pytest.mark.parametrize("profile", [T.BoxCar("30h"), T.Gaussian("5h"), T.Cauchy("5h"), T.Exponential("1h", "40h")], ids=repr)
def test_periodic_by_remainder(spark, profile):
    lo, hi = START, START + timedelta(days=60)
    e = Event("e", "periodic", profile, (START + timedelta(days=11, hours=5),), 26 * 3_600_000_000)
    df = spark.range(600).select(F.timestamp_add("HOUR", F.col("id") * 3 - 200, ntz(START)).alias("ds"))
    listed = F.lit(0.0)
    for a in feats.anchors_of(e, lo, hi):
        listed = listed + e.profile.at(diff_us(ntz(a), F.col("ds")))
    for r in df.select(feats.event_column(e, F.col("ds"), lo, hi).alias("a"), listed.alias("b")).collect():
        assert r.a == pytest.approx(r.b, rel=1e-12, abs=1e-300)


def test_models_with_a_table(spark, tmp_path):
    rng = np.random.default_rng(1)
    days = [datetime(2020, 1, 1) + timedelta(days=i) for i in range(150)]
    anchors = [(k, d) for k in "ab" for d in rng.choice(days[:140], 8, replace=False).tolist()]
    path = str(tmp_path / "anchors")
    spark.createDataFrame(anchors, "shop string, at timestamp_ntz").write.parquet(path)
    rows = [(k, d, int(rng.poisson(20 + 40 * any(0 <= (d - a).days < 2 for s, a in anchors if s == k)))) for k in "ab" for d in days]
    df = spark.createDataFrame(rows, "k string, ds timestamp_ntz, y bigint")
    spec = T.ModelSpec(model="poisson", keys=("k",), n_changepoints=0).add_event("promo", T.BoxCar("2d"), "table", table=path, column="at", by=("shop",))
    assert T.ModelSpec.from_dict(spec.to_dict()) == spec
    model = T.fit(df, spec)
    out = T.predict(model, df).toPandas().merge(df.toPandas(), on=["k", "ds"])
    assert np.corrcoef(out["yhat"], out["y"])[0, 1] > 0.8
    parts = T.components(model, df).toPandas()
    assert "promo" in parts.columns and (parts["promo"] > 0).sum() == sum(0 <= (d - a).days < 2 for k in "ab" for d in days for a in {x for s, x in anchors if s == k}) - sum(max(0, sum(0 <= (d - a).days < 2 for a in {x for s, x in anchors if s == k}) - 1) for k in "ab" for d in days)
    assert feats.impact(model.spec.events[0], days[0], days[-1]) == 1.0 and feats.impact(model.spec.events[0], days[0], days[0]) < 1
    for wrong in ({"kind": "table"}, {"kind": "single", "anchors": (START,), "table": "x"}):
        with pytest.raises(ValueError):
            Event("e", profile=T.BoxCar("1d"), **wrong)
    with pytest.raises(ValueError):
        Event("e", "table", T.Cauchy("1d"), table="x")
    with pytest.raises(ValueError):
        from_anchors(df, "ds", df, T.Cauchy("1d"), "ds")


@pytest.mark.parametrize("end", ["5h", "11h", "100h", "400h", "3000h"])
@pytest.mark.parametrize("keyed", [True, False])
def test_tails_with_an_end(spark, end, keyed):
    """Nothing from the end on, exactly: no rest of a difference of sums either."""
    rows, anchors = data()
    rows.append((anchors[0][0] + timedelta(microseconds=micros(end)), "a", -4))
    p = T.Exponential("30m", "2h", end)
    us = lambda d: (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds
    df, table = spark.createDataFrame(rows, "ds timestamp_ntz, k string, i int").repartition(3), spark.createDataFrame(anchors, "at timestamp_ntz, k string")
    got = {r.i: r.v for r in from_anchors(df, "ds", table, p, "at", ["k"] if keyed else [], "v").collect()}
    for ds, k, i in rows:
        near = [us(ds - a) for a, o in anchors if a is not None and (o == k or not keyed) and abs(us(ds - a)) < micros(end)] if ds else []
        assert got[i] == pytest.approx(math.fsum(value(p, d) for d in near), rel=1e-9, abs=1e-300), (ds, k)
    at = spark.createDataFrame([(-micros(end),), (1 - micros(end),), (micros(end) - 1,), (micros(end),)], "us long").select(p.at(F.col("us")).alias("v")).collect()
    assert [r.v > 0 for r in at] == [False, micros(end) < 1000 * 1_800_000_000, micros(end) < 1000 * 7_200_000_000, False]
    assert T.ModelSpec.from_dict((spec := T.ModelSpec().add_event("e", p, anchors="2020-01-01")).to_dict()) == spec and max(p.reach()) <= micros(end)
    with pytest.raises(ValueError):
        T.Exponential("1h", "1h", "0h")


def test_feature_matrix_ends_where_its_sql_does(spark, tmp_path):
    """Very many shipments just beyond the reach of 400 days would show in the sixth decimal."""
    import duckdb

    from tidecast import queries as Q

    folder, day = str(tmp_path), lambda n: f"date_add(DATE '1995-01-01', {n})"
    spark.range(12).selectExpr("id AS o_orderkey", day("cast(400 + id % 4 as int)") + " AS o_orderdate").write.parquet(f"{folder}/orders.parquet")
    far = spark.range(1_200_000).selectExpr(day("0") + " AS l_shipdate", "50.0D AS l_quantity")
    far.union(spark.range(3).selectExpr(day("cast(390 + id as int)"), "50.0D")).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = {d: x for d, x in con.execute(Q.ORACLE["feature_matrix_anchor_table"]).fetchall()}
    assert {r.ds: r.x for r in Q.QUERIES["feature_matrix_anchor_table"](spark, folder).collect()} == want and len(want) == 4
