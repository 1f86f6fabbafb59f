import hashlib

import numpy as np
import pytest

from tidecast.llm import centroids as C


def brute(rows, k=8, rounds=10, size=64):
    """(id, vector) rows -> sorted result rows, in Python's integers."""
    from fractions import Fraction
    from math import floor, isfinite

    own = [(i, [floor(Fraction(e) * 1024) for e in v]) for i, v in rows if v is not None and len(v) == size and all(e is not None and isfinite(e) for e in v)]
    named = sorted(own, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in named[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    best = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        at = [best(v) for _, v in own]
        c = [[sum(x) // len(g) for x in zip(*g)] if (g := [v for (_, v), a in zip(own, at) if a == j]) else c[j] for j in range(len(c))]
    at = [best(v) for _, v in own]
    near = [far(v, c[a]) for (_, v), a in zip(own, at)]
    fits = lambda n: n if n < 2**63 else None
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, a, fits(d), fits(sum(e for e, b in zip(near, at) if a == b)), fits(sum(near)), digest[a]) for (i, _), a, d in zip(own, at, near)), key=str)


def got(spark, rows, schema="vec_id long, embedding array<float>", n=3, **more):
    df = spark.createDataFrame(rows, schema).repartition(n)
    out = C.cluster(df, **more)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 16)
    rng = np.random.default_rng(1)
    middle = rng.normal(0, 0.3, (5, 64))
    rows = [(i, (middle[i % 5] + rng.normal(0, 0.1, 64)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[7][1]) for i in range(80)] + [rows[3]] * 2 + [(None, rows[9][1])]  # copies, repeated rows, no identifier
    rows += [(2000, None), (2001, []), (2002, [0.5] * 63), (2003, [0.5] * 65), (2004, [None] + [0.5] * 63), (2005, [float("nan")] + [0.5] * 63), (2006, [float("-inf")] + [0.5] * 63)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, n=1) == brute(rows)


def test_few_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    assert got(spark, rows) == brute(rows)
    assert {r[1] for r in got(spark, rows)} == {0, 1, 2}
    assert got(spark, []) == got(spark, [(1, [1.0])]) == []
    same = [(i, [0.25] * 64) for i in range(20)]  # ties go to the smaller number, clusters without vectors stay
    assert got(spark, same) == brute(same)
    assert {r[1] for r in got(spark, same)} == {0}


@pytest.mark.parametrize("top", [2.0**14, 2.0**20, 2.0**52, 1e300])
def test_beyond_float64(spark, top):
    """Bounds past 2^53 and 2^63, and integers of over 64 bits."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 1, 64) * (top if i % 3 == 0 else 1)).tolist()) for i in range(40)] + [(99, [5e-324] * 64), (98, [-5e-324] * 64)]
    assert got(spark, rows, "vec_id long, embedding array<double>", rounds=3) == brute(rows, rounds=3)


def test_distances_by_every_path():
    rng = np.random.default_rng(3)
    for top in (10, 2**22, 2**27, 2**40):
        x, c = rng.integers(-top, top, (30, 64)), rng.integers(-top, top, (4, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
        assert C.distances(x, c).tolist() == want


def test_pack():
    for x in (np.array([[1, -2]]), np.array([[40000, 1]]), np.array([[2**40, -1]]), np.array([[2**80, -(2**70)]], object)):
        assert C.unpack(*C.pack(x), 2).tolist() == x.tolist()


def test_clashing_columns(spark):
    rows = [(i, [i / 7] * 64) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cluster", "2 AS id", "'x' AS v", "3 AS distance", "4 AS data")
    assert sorted(map(tuple, C.cluster(df).collect()), key=str) == brute([(i, np.float32(v).tolist()) for i, v in rows])


def test_as_duckdb(spark):
    import duckdb

    from tidecast.llm import queries as Q

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({Q.oracle_sql()['op11_centroids']})").fetchall())
    assert len(want) > 100
    assert sorted(map(tuple, Q.op11_centroids(spark, folder).select(*names).collect())) == want
