"""Feature columns of a model: Fourier terms, external columns and events, in that order, as JVM expressions."""

from __future__ import annotations

import logging
import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.columns import diff_us, fourier, ntz
from tidecast.functions.durations import UNITS
from tidecast.functions.holidays import holidays
from tidecast.operators.anchors import from_anchors
from tidecast.operators.grid import differences
from tidecast.plans.spec import EVENT_KINDS, Calendric, Event, ModelSpec

log = logging.getLogger(__name__)

LEAST_IMPACT = 0.1
DAY = UNITS["d"]
#: Period in microseconds and default order of the automatic seasonalities; fixed values.
CALENDAR = {"yearly": (365.25 * DAY, 10), "quarterly": (365.25 * DAY / 4, 2), "monthly": (365.25 * DAY / 12, 3), "weekly": (7 * DAY, 3), "daily": (DAY, 4)}


@dataclass(frozen=True)
class Feature:
    name: str
    kind: str
    part: str
    prior_scale: float
    column: Column


def _us(delta: timedelta) -> int:
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def anchors_of(event: Event, lo: datetime, hi: datetime) -> list[datetime]:
    """An event's anchors for data from lo to hi. Periodic ones reach two periods beyond either end."""
    if event.kind == "periodic":
        first = event.anchors[0]
        n0, n1 = (_us(end - first) // event.period_us for end in (lo, hi))
        return [first + timedelta(microseconds=n * event.period_us) for n in range(n0 - 2, n1 + 3)]
    if event.kind == "holiday":
        named = holidays(event.country, range(lo.year, hi.year + 1), event.subdiv)
        days = [datetime.combine(d, time()) for d, name in named if name == (event.holiday or event.name)]
        return [d for d in days if lo <= d <= hi]
    if made := EVENT_KINDS[event.kind]:
        return list(made(event, lo, hi))
    return list(event.anchors)


def holiday_frame(spark: SparkSession, country: str, lo: datetime, hi: datetime, subdiv: str | None = None) -> DataFrame:
    """holiday_date, holiday of the days whose midnight lies within lo and hi."""
    rows = [(d, n) for d, n in holidays(country, range(lo.year, hi.year + 1), subdiv) if lo <= datetime.combine(d, time()) <= hi]
    return spark.createDataFrame(rows, "holiday_date date, holiday string")


def anchor_table(event: Event) -> DataFrame:
    spark = SparkSession.active()
    return spark.read.parquet(event.table) if "/" in event.table else spark.table(event.table)


def impact(event: Event, lo: datetime, hi: datetime) -> float:
    """Share of the anchors that lie within the data; zero without anchors."""
    if event.kind == "table":
        at = F.col(event.column).cast("timestamp_ntz")
        return float(anchor_table(event).agg(F.coalesce(F.avg(at.between(ntz(lo), ntz(hi)).cast("double")), F.lit(0.0))).first()[0])
    at = anchors_of(event, lo, hi)
    return sum(lo <= a <= hi for a in at) / len(at) if at else 0.0


def event_column(event: Event, ts: Column, lo: datetime, hi: datetime) -> Column:
    """Sum of the profile over the anchors; for a table's the column that ``with_anchored`` makes."""
    if event.kind == "table":
        return F.col(f"_anchored_{event.name}")
    if event.kind == "periodic":
        return periodic_column(event, ts, lo, hi)
    at = anchors_of(event, lo, hi)
    if not at:
        return F.lit(0.0)
    if len(at) == 1:
        return event.profile.at(diff_us(ntz(at[0]), ts))
    base = at[0]
    offsets = F.array(*[F.lit(_us(a - base)).cast("long") for a in at])
    since = diff_us(ntz(base), ts)
    return F.aggregate(offsets, F.lit(0.0), lambda acc, o: acc + event.profile.at(since - o))


def periodic_column(event: Event, ts: Column, lo: datetime, hi: datetime) -> Column:
    """Of the anchors that ``anchors_of`` lists, by number, those that reach a time: found by its remainder, and not listed."""
    first, period, reach = event.anchors[0], event.period_us, event.profile.reach()
    n0, n1 = (F.lit(_us(end - first) // period + more) for end, more in ((lo, -2), (hi, 2)))
    since = diff_us(ntz(first), ts)
    begin, end = n0, n1
    if reach is not None:
        at = F.call_function("div", since - F.pmod(since, F.lit(period)), F.lit(period))  # the last anchor before
        begin, end = F.greatest(n0, at - (reach[1] // period + 1)), F.least(n1, at + (reach[0] // period + 1))
    numbers = F.when(begin <= end, F.sequence(begin, end)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(numbers, F.lit(0.0), lambda acc, n: acc + event.profile.at(since - n * F.lit(period)))


def with_anchored(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """The rows with a column for each event whose anchors are a table."""
    for e in spec.events:
        if e.kind == "table":
            own = [f"_key{i}" if f"_key{i}" in df.columns else k for i, k in enumerate(spec.keys)][: len(e.by)]
            anchors = anchor_table(e).select(*(F.col(b).alias(k) for b, k in zip(e.by, own, strict=True)), F.col(e.column).alias("_at"))
            df = from_anchors(df, spec.timestamp_name, anchors, e.profile, "_at", own, f"_anchored_{e.name}")
    return df


def features(spec: ModelSpec, t: Column, ts: Column, lo: datetime, hi: datetime) -> list[Feature]:
    """All feature columns; t is the integer time."""
    out = []
    for s in spec.seasonalities:
        period = s.period_us / spec.step_us
        for part in ("sin", "cos"):
            out += [Feature(f"{s.name}_{part}_{n}", "seasonality", s.name, s.prior_scale, fourier(t, period, n, part)) for n in range(1, s.order + 1)]
    out += [Feature(e.name, "external", e.name, e.prior_scale, F.col(e.name).cast("double")) for e in spec.externals]
    out += [Feature(e.name, "event", e.name, e.prior_scale, event_column(e, ts, lo, hi)) for e in spec.events]
    return out


def feature_matrix(df: DataFrame, spec: ModelSpec, lo: datetime, hi: datetime, t: str = "t", out: str = "x") -> DataFrame:
    """The rows with one array of all features, in order."""
    made = [f.column for f in features(spec, F.col(t), F.col(spec.timestamp_name), lo, hi)]
    placed = with_anchored(df, spec).withColumn(out, F.array(*made) if made else F.array().cast("array<double>"))
    return placed.drop(*(f"_anchored_{e.name}" for e in spec.events if e.kind == "table"))


def prune_events(spec: ModelSpec, lo: datetime, hi: datetime) -> ModelSpec:
    """The spec without events that hardly touch the data: ``auto`` ones go, those to include stay with a warning."""
    kept = []
    for e in spec.events:
        if e.include is False:
            continue
        share = impact(e, lo, hi)
        if share < LEAST_IMPACT:
            if e.include == "auto":
                log.info("event %s has %.0f %% of its anchors in the data and is left out", e.name, 100 * share)
                continue
            log.warning("event %s has only %.0f %% of its anchors in the data", e.name, 100 * share)
        kept.append(e)
    return replace(spec, events=tuple(kept))


def seasonality_orders(protocol: Calendric, span_us: float, sample_us: float) -> dict[str, int]:
    """Orders of the automatic seasonalities for a span and a sampling period."""
    asked = {n: getattr(protocol, n) for n in CALENDAR}
    yearly = asked["yearly"]
    has_year = yearly is True or (yearly == "auto" and span_us >= 2 * CALENDAR["yearly"][0]) or (not isinstance(yearly, bool | str) and yearly > 3)
    out = {}
    for name, (period, default) in CALENDAR.items():
        v = asked[name]
        if v is False or (name == "quarterly" and has_year):
            continue
        if v == "auto":
            order = min(default, math.floor(period / (2 * sample_us))) if span_us >= 2 * period else 0
        else:
            order = default if v is True else v
        if order > 0:
            out[name] = order
    return out


def apply_protocols(spec: ModelSpec, history: DataFrame, lo: datetime, hi: datetime) -> ModelSpec:
    """Settle protocols by one aggregate of the history; terms of a name that is there stay as they are."""
    if not spec.protocols:
        return spec
    sample = differences(history.select(*spec.keys, spec.timestamp_name), spec.timestamp_name, spec.keys).agg(F.percentile("diff_us", 0.3).alias("q")).first()["q"]
    span = _us(hi - lo) + sample
    for p in spec.protocols:
        if not isinstance(p, Calendric):
            spec = p.settle(spec, history, lo, hi)
            continue
        if p.country:
            for name in sorted({n for d, n in holidays(p.country, range(lo.year, hi.year + 1), p.subdiv) if lo <= datetime.combine(d, time()) <= hi}):
                if name not in {e.name for e in spec.events}:
                    spec = spec.add_event(name, p.profile, "holiday", country=p.country, subdiv=p.subdiv, holiday=name, prior_scale=p.event_prior_scale)
        for name, order in seasonality_orders(p, span, sample).items():
            if name not in {s.name for s in spec.seasonalities}:
                spec = spec.add_seasonality(name, round(CALENDAR[name][0]), order, p.seasonality_prior_scale)
    return replace(spec, protocols=())


def strengths(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Euclidean length of each feature column relative to the median length: name, strength."""
    row = df.agg(*[F.sqrt(F.sum(F.col(n) * F.col(n))).alias(n) for n in names])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("norm")) for n in names])).alias("s")).select("s.name", "s.norm")
    middle = long.agg(F.percentile("norm", 0.5).alias("m")).first()["m"]
    return long.select("name", F.try_divide("norm", F.lit(middle)).alias("strength"))
