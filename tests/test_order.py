import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidecast.operators import grid, order, trend, validate

START = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def several_partitions(spark):
    """Small tables are ranged into several partitions too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def table(spark, n, ties=7, parts=5):
    rows = [(START + dt.timedelta(hours=(i * 7919) % (n // ties + 1)) if i % 50 else None, i, str(i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "ds timestamp_ntz, v long, g string").repartition(parts)


@pytest.mark.parametrize("n", [1, 2, 3000])
def test_as_windows(spark, n):
    df = table(spark, n)
    got = order.in_order(df, ["ds", "v"], "position", {"before": "ds", "b_v": "v"})
    w = Window.orderBy("ds", "v")
    want = df.select("*", (F.row_number().over(w) - 1).alias("position"), F.lag("ds").over(w).alias("before"), F.lag("v").over(w).alias("b_v"))
    assert got.columns == ["ds", "v", "g", "position", "before", "b_v"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # Of rows that are equal in the order, the row before is not settled, but its time is.
    times = order.in_order(df, "ds", None, {"before": "ds"}).select("ds", "before")
    assert Counter(map(str, times.collect())) == Counter(map(str, df.select("ds", F.lag("ds").over(Window.orderBy("ds")).alias("before")).collect()))
    assert sorted(r[0] for r in order.in_order(df, "ds").select("position").collect()) == list(range(n))


def test_one_time_is_dealt(spark):
    """A time that most rows share is spread over partitions; equal rows and empty tables are no matter."""
    df = spark.createDataFrame([(START, i) for i in range(4000)] + [(START, 5)] * 3, "ds timestamp_ntz, v long")
    sizes = [r["count"] for r in order.ranged(df, ["ds"]).groupBy("_part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 3000
    assert sorted(r[0] for r in order.in_order(df, "ds").select("position").collect()) == list(range(4003))
    none = order.in_order(df.where("v < 0"), "ds", "position", {"before": "v"})
    assert none.collect() == [] and none.columns == ["ds", "v", "position", "before"]


def test_no_single_partition(spark):
    df = table(spark, 200).where("ds IS NOT NULL")
    for made in (
        order.in_order(df, "ds", "position", {"before": "ds"}), grid.differences(df, "ds"), grid.gaps(df, "ds", "1h"), grid.equidistant(df, "ds", "1h"),
        validate.period_starts(df, "ds", "day"), trend.auto_changepoints(df, "ds", 5),
    ):
        plan = made._jdf.queryExecution().executedPlan().toString()
        windows = plan.count("Window [")
        assert "Exchange SinglePartition" not in plan or not windows or "hashpartitioning(_part" in plan
        assert plan.count("hashpartitioning(_part") >= windows


def test_operators_without_keys_are_those_with_one(spark):
    df = table(spark, 900).where("ds IS NOT NULL").select("ds").distinct()
    one = df.withColumn("k", F.lit(1))
    for f in (
        lambda x, k: grid.differences(x, "ds", k), lambda x, k: grid.gaps(x, "ds", "1m", k), lambda x, k: grid.equidistant(x, "ds", "1d", k, "even"),
        lambda x, k: validate.period_starts(x, "ds", "day", k), lambda x, k: trend.auto_changepoints(x, "ds", 11, 0.7, k),
        lambda x, k: grid.sampling_period(x, "ds", 0.4, k), lambda x, k: grid.time_span(x, "ds", k),
    ):
        got, want = f(df, []), f(one, ["k"])
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
