"""Events whose anchors are a table: the sum of a profile over all anchors that reach a row, whose plan does not grow with them.

Rows and anchors meet by buckets of time, as wide as the profile reaches. Boxes and exponential tails are running sums within a
bucket, in the order of time, and what earlier buckets leave over: work is in proportion to rows and anchors, however many of these
reach a row. Other profiles that are zero in double precision beyond some distance are joined pair by pair within it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.columns import diff_us, ntz
from tidecast.functions.durations import micros
from tidecast.functions.profiles import BoxCar, Exponential, Profile

EPOCH = datetime(1970, 1, 1)
#: Halvings of a bucket of a tail, and after how many a double is zero, whatever the sum was.
HALVINGS, ZERO = 32, 1120


def bucket(us: Column, width: int) -> Column:
    """Whole number of widths below, exactly, of negative times too."""
    return F.call_function("div", us - F.pmod(us, F.lit(width)), F.lit(width))


def _running(times: DataFrame, anchors: DataFrame, keys: Sequence[str], us: Column, width: int, weight: Column, anchors_first: bool, back: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with the running sum of ``weight`` of their bucket's anchors before them (``back``: after them), and the buckets' totals.

    ``weight`` is of n, the number of anchors at a time, and since, the microseconds from the bucket's begin.
    """
    placed = lambda df: df.withColumn("u", us).withColumn("b", bucket(F.col("u"), width)).withColumn("since", F.col("u") - F.col("b") * F.lit(width))
    own = placed(anchors).withColumn("w", weight)
    both = placed(times.withColumn("n", F.lit(0).cast("long"))).withColumn("w", F.lit(0).cast(own.schema["w"].dataType)).withColumn("row", F.lit(True))
    window = Window.partitionBy(*keys, "b").orderBy(F.desc("u") if back else "u", F.col("row") if anchors_first else ~F.col("row")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = both.unionByName(own.withColumn("row", F.lit(False))).withColumn("sum", F.sum("w").over(window)).where("row")
    return sums.select(*keys, "us", "b", "since", "sum"), own.groupBy(*keys, "b").agg(F.sum("w").alias("total"))


def _box(times: DataFrame, anchors: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Anchors at most ``width`` before, not counting those right at that distance: up to now, less those up to then."""
    now, totals = _running(times, anchors, keys, F.col("us"), width, F.col("n"), True)
    earlier = F.when(F.col("n") == 0, F.col("us") - F.lit(width)).otherwise(F.col("us"))  # rows have no anchors of their own
    then, _ = _running(times, anchors, keys, earlier, width, F.col("n"), True)
    before = totals.select(*keys, (F.col("b") + 1).alias("b"), F.col("total").alias("left"))
    met = now.join(before, [*keys, "b"], "left").join(then.select(*keys, "us", F.col("sum").alias("gone")), [*keys, "us"])
    return met.select(*keys, "us", (F.col("sum") + F.coalesce("left", F.lit(0)) - F.col("gone")).cast("double").alias("value"))


def _tail(times: DataFrame, anchors: DataFrame, keys: Sequence[str], unit: int, ahead: bool, end: int | None) -> DataFrame:
    """Sum of what halves every ``unit``, of the anchors up to a time; or with ``ahead`` of those after it, by time turned round.

    Anchors from a distance of ``end`` on do not count. What the oldest bucket leaves of them is summed from its end, as a difference
    of sums would be off by rounding.
    """
    us = -F.col("us") if ahead else F.col("us")
    ends = end is not None and end < ZERO * unit
    width = min(HALVINGS * unit, end) if ends else HALVINGS * unit
    whole = end // width if ends else ZERO // HALVINGS + 1  # buckets before that are whole within the reach, and one more
    grown = F.pow(F.lit(2.0), F.col("since") / F.lit(float(unit)))
    fallen = lambda d: F.pow(F.lit(2.0), -d * F.lit(width / unit))
    rows, totals = _running(times, anchors, keys, us, width, F.col("n") * grown, not ahead)
    value = F.col("sum")
    if whole > 1:
        later = totals.select(*keys, "total", "b", F.explode(F.sequence(F.lit(1), F.lit(whole - 1))).alias("d"))
        carried = later.groupBy(*keys, (F.col("b") + F.col("d")).alias("b")).agg(F.sum(F.col("total") * fallen(F.col("d"))).alias("carried"))
        rows, value = rows.join(carried, [*keys, "b"], "left"), value + F.coalesce("carried", F.lit(0.0))
    if ends:
        earlier = F.when(F.col("n") == 0, us - F.lit(end)).otherwise(us)  # rows have no anchors of their own
        oldest, _ = _running(times, anchors, keys, earlier, width, F.col("n") * grown, False, back=True)
        rows = rows.join(oldest.select(*keys, "us", F.col("b").alias("from"), F.col("sum").alias("part")), [*keys, "us"])
        rows = rows.join(totals.select(*keys, (F.col("b") + whole).alias("b"), F.col("total").alias("one_more")), [*keys, "b"], "left")
        value = value + F.col("part") * fallen(F.col("b") - F.col("from"))
        value = value + F.when(F.col("b") - F.col("from") > whole, F.coalesce("one_more", F.lit(0.0))).otherwise(0.0) * fallen(F.lit(whole))
    return rows.select(*keys, "us", (value / grown).alias("value"))


def _pairs(times: DataFrame, anchors: DataFrame, keys: Sequence[str], profile: Profile, before: int, after: int) -> DataFrame:
    width = before + after + 1
    own = anchors.withColumnRenamed("us", "a").withColumn("b", F.explode(F.sequence(bucket(F.col("a") - before, width), bucket(F.col("a") + after, width))))
    met = times.withColumn("b", bucket(F.col("us"), width)).join(own, [*keys, "b"])
    since = F.col("us") - F.col("a")
    return met.where((since >= -before) & (since <= after)).groupBy(*keys, "us").agg(F.sum(F.col("n") * profile.at(since)).alias("value"))


def from_anchors(df: DataFrame, ts: str, anchors: DataFrame, profile: Profile, at: str, keys: Sequence[str] = (), out: str = "value") -> DataFrame:
    """The rows with ``out``: the sum of the profile over the anchors in column ``at``, of the row's series if there are ``keys``.

    Anchors may repeat and count as often; null ones are left out. Rows that no anchor reaches, or without a time, have zero.
    A profile has to end: to say how far it reaches.
    """
    inner = [f"_a{i}" for i in range(len(keys))]
    own = [F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)]
    times = df.select(*own, diff_us(ntz(EPOCH), F.col(ts)).alias("us")).where("us IS NOT NULL").distinct()
    some = anchors.select(*own, diff_us(ntz(EPOCH), F.col(at).cast("timestamp_ntz")).alias("us")).where("us IS NOT NULL").groupBy(*inner, "us").agg(F.count(F.lit(1)).alias("n"))
    if isinstance(profile, BoxCar) and micros(profile.width) <= 0:
        value = times.select(*inner, "us", F.lit(0.0).alias("value"))
    elif isinstance(profile, BoxCar):
        value = _box(times, some, inner, micros(profile.width))
    elif isinstance(profile, Exponential):
        sides = [_tail(times, some, inner, micros(unit), ahead, profile.end and micros(profile.end)) for unit, ahead in ((profile.lead, True), (profile.lag, False)) if micros(unit)]
        value = sides[0] if sides else times.select(*inner, "us", F.lit(0.0).alias("value"))
        for more in sides[1:]:
            value = value.unionByName(more).groupBy(*inner, "us").agg(F.sum("value").alias("value"))
    else:
        reach = profile.reach()
        if reach is None:
            raise ValueError(f"a {type(profile).__name__} reaches without end: its anchors have to be in the spec")
        value = _pairs(times, some, inner, profile, *reach)
    named = value.select(*(F.col(i).alias(f"_k{i}") for i in inner), F.col("us").alias("_us"), F.col("value").alias("_value"))
    same = [df[k] == named[f"_k{i}"] for k, i in zip(keys, inner, strict=True)] + [diff_us(ntz(EPOCH), df[ts]) == named["_us"]]
    return df.join(named, same, "left").select(*df.columns, F.coalesce("_value", F.lit(0.0)).alias(out))
