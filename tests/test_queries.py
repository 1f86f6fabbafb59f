"""Every query with SQL equals DuckDB's result on the smallest tables; the others give rows."""

import datetime as dt
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tidecast import queries as own

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "array<double>": "DOUBLE[]", "int": "INTEGER"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    return v.isoformat() if isinstance(v, dt.datetime) else repr([plain(x) for x in v]) if isinstance(v, list | tuple) else repr(v)


@pytest.mark.parametrize("name", sorted(own.ORACLE))
def test_as_duckdb(spark, duck, name):
    df = own.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    result = duck.execute(own.ORACLE[name])
    kinds = {c[0]: str(c[1]) for c in result.description}
    assert sorted(kinds) == names
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    at = [list(kinds).index(c) for c in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())
    assert Counter(tuple(map(plain, r)) for r in df.select(*names).collect()) == want


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLE)))
def test_rows(spark, name):
    assert own.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_models_keep_the_default_simulation(spark, monkeypatch):
    """Registered queries that forecast take the default numbers of simulated trends and of draws."""
    from tidecast import queries as Q

    class Seen(Exception):
        pass

    def spy(rows, spec, *args, **more):
        raise Seen(spec.trend_samples, more.get("draws", 1000))

    class Rows:
        def __getattr__(self, name):
            return lambda *a, **b: self

    monkeypatch.setattr(Q, "fit", spy)
    monkeypatch.setattr(Q.grid, "resample", lambda *a, **b: Rows())
    for name in ("s1", "s2", "s4", "table"):
        monkeypatch.setattr(Q, name, lambda *a, **b: Rows())
    names = [*(n for n in Q.queries() if n.startswith("fit_") and not n.startswith("fit_line")), "trend_uncertainty", "cv_refit", "calendric_fit", "forecast_anomalies", "serialize_roundtrip"]
    assert len(names) == 14
    for name in names:
        with pytest.raises(Seen) as got:
            Q.queries()[name](None, "")
        assert got.value.args == (1000, 1000), name
