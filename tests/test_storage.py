import os

from tidecast.functions import storage as S


def test_tables_are_written_and_forgotten(spark):
    first = S.mark()
    one, two = S.written(spark.range(5)), S.written(spark.range(7))
    assert (one.count(), two.count(), S.mark() - first) == (5, 7, 2)
    paths = [p.removeprefix("file:") for p in S._made[first:]]
    assert all(map(os.path.exists, paths)) and all(S.shared_folder(spark) in p for p in S._made[first:])
    S.forget(spark, first, first + 1)
    assert not os.path.exists(paths[0]) and os.path.exists(paths[1]) and S.mark() == first + 1
    S.forget(spark, first)
    assert not os.path.exists(paths[1])


def test_cut_is_reliable(spark):
    df = S.cut(spark.range(9).selectExpr("id * 2 AS x"))
    plan = df._jdf.queryExecution().toString()
    assert "Range" not in plan and df.agg({"x": "sum"}).first()[0] == 72
    assert spark.sparkContext.getCheckpointDir().rstrip("/").startswith(("file:", "/"))


def test_release_collects_on_executors(spark):
    """By counts of collections; here the one executor is in the driver's JVM."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    collected = lambda: sum(b.getCollectionCount() for b in beans)
    before = collected()
    S.trim(spark)
    assert collected() > before
    plain = collected()
    S.release(spark)
    assert collected() >= plain + 2  # the driver's and the executor's
