import numpy as np
import pytest

from tidecast.llm import common
from tidecast.llm.components import connected_components


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [tuple(map(int, rng.integers(1000, 1200, 2))) for _ in range(120)] + [(7, 7), (-5, 8), (8, -5), (None, 3)]
    rng.shuffle(edges)
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    want = {x: find(x) for x in list(root)}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == want
    for rounds in (1, 2):
        some = connected_components(spark.createDataFrame(edges, "a long, b long"), rounds).collect()
        assert some and len(some) == len({r.node for r in some}) and all(want[r.node] == want[r.root] and r.root <= r.node for r in some)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 20])
def test_bitmap_loses_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "BITMAP", bits)
    df = spark.range(1000).selectExpr("id", "id * 2 AS _word")
    ids = spark.range(0, 1000, 37)
    inside = {r.id for r in common.maybe_in(df, "id", ids).collect()}
    outside = {r.id for r in common.maybe_in(df, "id", ids, without=True).collect()}
    assert inside | outside == set(range(1000)) and not inside & outside and set(range(0, 1000, 37)) <= inside
    assert bits < 1000 or len(inside) < 100
    assert common.maybe_in(df, "id", ids.limit(0)).count() == 0


def test_shared_folder(spark):
    df = common.cut(spark.range(5))
    assert df.count() == 5 and "ExistingRDD" in df._jdf.queryExecution().toString()
    assert common.written(spark.range(7)).count() == 7
