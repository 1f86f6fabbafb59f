import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidecast.operators import grid

START = dt.datetime(2024, 2, 26, 13, 5)


def test_holes_are_filled(spark, monkeypatch):
    rows = [(k, START + dt.timedelta(hours=h)) for k, hours in (("a", (0, 1, 9, 9)), (None, (5, 200)), ("one", (3,))) for h in hours]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz")
    binned = grid.resample(df, "t", "hour", {"y": F.count(F.lit(1)), "last": F.max("t")}, ["k"])
    for run in (4096, 7):
        monkeypatch.setattr(grid, "RUN", run)
        got = {(r.k, r.ds): (r.y, r.last) for r in grid.filled(binned, "hour", ["k"], fill={"y": 0}).collect()}
        assert len(got) == 10 + 196 + 1
        assert [got["a", dt.datetime(2024, 2, 26, h)][0] for h in range(13, 23)] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 2]
        assert got["a", dt.datetime(2024, 2, 26, 15)][1] is None and got["a", dt.datetime(2024, 2, 26, 22)][1] == START + dt.timedelta(hours=9)


@pytest.mark.parametrize(("unit", "days", "many"), [("day", (0, 40), 41), ("week", (0, 28), 5), ("month", (0, 370), 14), ("quarter", (0, 370), 5), ("year", (0, 1500), 5)])
def test_units(spark, unit, days, many):
    df = spark.createDataFrame([(START + dt.timedelta(days=d),) for d in days], "t timestamp_ntz")
    got = sorted((r.ds, r.y) for r in grid.filled(grid.resample(df, "t", unit, {"y": F.count(F.lit(1))}), unit).collect())
    assert len(got) == many and got[0][1] == got[-1][1] == 1 and sum(y for _, y in got) == 2
    assert {r.ds for r in grid.resample(df, "t", unit, {"y": F.count(F.lit(1))}).collect()} == {got[0][0], got[-1][0]}


def test_empty_and_unknown(spark):
    df = spark.createDataFrame([], "t timestamp_ntz, k string")
    binned = grid.resample(df, "t", "day", {"y": F.count(F.lit(1))}, ["k"])
    assert grid.filled(binned, "day", ["k"]).collect() == []
    assert grid.filled(binned.drop("k"), "day").collect() == []
    with pytest.raises(ValueError):
        grid.filled(binned, "fortnight", ["k"])
