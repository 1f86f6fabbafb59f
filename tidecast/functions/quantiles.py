"""Exact quantiles of groups in bounded state: selection by equi-depth histograms that are refined around the ranks asked for.

A round sketches, for every group at once, the values between two borders by STEPS + 1 approximate percentiles, counts what lies
below and at the two of them around each rank, and goes on between these. Borders that turn out to be the value settle a rank, so
that any number of ties does; the rest is sorted once at most FEW values are left. Sketches, histograms and the last lists have a
size of their own, whatever that of a group, and are combined on the map side. Ranks between the same borders share the work, and
each round reads what the one before has left between borders, so that all values are read by the first only. Few groups are
broadcast to the values, which then stay where they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions.storage import cut, forget, mark, written

#: Parts of a histogram, accuracy of its sketch, values that are sorted as a list, and rows of groups that are broadcast.
STEPS, ACCURACY, FEW, SMALL = 512, 10_000, 4096, 100_000


def _with(left: DataFrame, right: DataFrame, on: Sequence[str], small: bool, how: str = "inner", where: str | None = None) -> DataFrame:
    """Joined by columns that may be null and then meet; by none of them each row meets all. ``where`` names the right side's columns as ``_r_``."""
    named = right.select(*(F.col(c).alias(f"_r_{c}" if c in left.columns or where else c) for c in right.columns))
    same = F.lit(True) if where is None else F.expr(where)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    met = left.join(F.broadcast(named) if small or not on else named, same, how)
    more = [] if how == "left_semi" else [c for c in named.columns if c.removeprefix("_r_") not in on]
    return met.select(*left.columns, *(F.col(c).alias(c.removeprefix("_r_")) for c in more))


def exact_quantiles(df: DataFrame, value: Column | str, probabilities: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """``keys`` and a column per name: the quantile of the group's values that are not null, linear between ranks; null without any.

    The same as ``percentile``, whose buffer holds every different value of a group.
    """
    for q in probabilities.values():
        if not 0 <= q <= 1:
            raise ValueError("quantiles lie within 0 and 1")
    spark, since = df.sparkSession, mark()
    own = [f"_k{i}" for i in range(len(keys))]
    rows = written(df.select(*(F.col(k).alias(i) for k, i in zip(keys, own, strict=True)), (F.col(value) if isinstance(value, str) else value).cast("double").alias("v")))
    sizes = cut(rows.groupBy(*own).agg(F.count("v").alias("n")))
    values = rows.where("v IS NOT NULL")
    asked = F.broadcast(spark.createDataFrame([(i, float(q)) for i, q in enumerate(probabilities.values())], "i int, q double"))
    place = (F.col("n") - 1) * F.col("q")
    both = sizes.where("n > 0").join(asked, how="inner", on=F.lit(True)).select(*own, "n", F.explode(F.array(F.floor(place), F.ceil(place))).alias("rank")).distinct()
    # rank counts from 0 within the open interval from low to high (null: no border), which has n values.
    left = cut(both.select(*own, F.col("rank").cast("long").alias("asked"), F.col("rank").cast("long").alias("rank"), "n", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")))
    ids, interval = [*own, "asked"], [*own, "low", "high"]
    within = "(_r_low IS NULL OR v > _r_low) AND (_r_high IS NULL OR v < _r_high)"
    found = left.where("false").select(*ids, F.lit(None).cast("double").alias("v"))
    while True:
        n_few, n_many = left.agg(F.count_if(F.col("n") <= FEW), F.count_if(F.col("n") > FEW)).first()
        small = n_few + n_many <= SMALL
        if n_few:
            # A value of an interval that has at most FEW of them: its place among these is the rank.
            few = left.where(F.col("n") <= FEW)
            listed = _with(values, few.select(*interval).distinct(), own, small, where=within).groupBy(*interval).agg(F.sort_array(F.collect_list("v")).alias("some"))
            done = _with(few, listed, interval, False).select(*ids, F.element_at("some", (F.col("rank") + 1).cast("int")).alias("v"))
            found = found.unionByName(cut(done))
        if not n_many:
            break
        many = cut(left.where(F.col("n") > FEW))
        grid = F.percentile_approx("v", [i / STEPS for i in range(STEPS + 1)], ACCURACY)
        sketched = _with(values, many.select(*interval).distinct(), own, small, where=within).groupBy(*interval).agg(grid.alias("grid"))
        # Borders one part further than the rank's own: the sketch is off by less.
        part = F.floor(F.col("rank") / F.col("n") * STEPS).cast("int")
        borders = cut(_with(many, sketched, interval, False).select(*ids, "rank", "n", "low", "high", F.element_at("grid", F.greatest(part, F.lit(1))).alias("a"), F.element_at("grid", F.least(part + 3, F.lit(STEPS + 1))).alias("b")))
        counted = _with(values, borders.select(*interval, "a", "b").distinct(), own, small, where=within).groupBy(*interval, "a", "b")
        counted = counted.agg(*(F.count_if(c).alias(n) for n, c in {"below": F.col("v") < F.col("a"), "at_a": F.col("v") == F.col("a"), "upto": F.col("v") < F.col("b"), "at_b": F.col("v") == F.col("b")}.items()))
        counts = cut(_with(borders, counted, [*interval, "a", "b"], False))
        r = F.col("rank")
        settled = F.when((r >= F.col("below")) & (r < F.col("below") + F.col("at_a")), F.col("a")).when((r >= F.col("upto")) & (r < F.col("upto") + F.col("at_b")), F.col("b"))
        found = found.unionByName(counts.select(*ids, settled.alias("v")).where("v IS NOT NULL"))
        ends = F.when(r < F.col("below"), F.struct(F.col("low"), F.col("a").alias("high"), r.alias("rank"), F.col("below").alias("n"))).when(
            r < F.col("upto"), F.struct(F.col("a").alias("low"), F.col("b").alias("high"), (r - F.col("below") - F.col("at_a")).alias("rank"), (F.col("upto") - F.col("below") - F.col("at_a")).alias("n"))
        ).otherwise(F.struct(F.col("b").alias("low"), F.col("high"), (r - F.col("upto") - F.col("at_b")).alias("rank"), (F.col("n") - F.col("upto") - F.col("at_b")).alias("n")))
        left = cut(counts.where(settled.isNull()).select(*ids, ends.alias("e")).select(*ids, "e.rank", "e.n", "e.low", "e.high"))
        values = written(_with(values, left.select(*interval).distinct(), own, small, "left_semi", where=within))
    found = cut(found)
    forget(spark, since)
    of = found.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("asked", "v"))).alias("at"))  # two ranks a quantile
    out = _with(sizes, of, own, False, "left")

    def quantile(q: float) -> Column:
        place = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.floor(place), F.ceil(place)
        low, high = F.try_element_at("at", lo), F.try_element_at("at", hi)
        return F.when(low == high, low).otherwise((hi - place) * low + (place - lo) * high)

    return out.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), *(quantile(q).alias(n) for n, q in probabilities.items()))
