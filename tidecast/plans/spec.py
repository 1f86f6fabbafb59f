"""What a model is made of, as immutable values; fitting and scoring read them and change nothing."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace
from datetime import datetime

from tidecast.functions.durations import instant, micros
from tidecast.functions.profiles import BoxCar, Profile
from tidecast.operators.validate import WORKING, check_name

log = logging.getLogger(__name__)

FAMILIES = ("normal", "poisson", "binomial", "negative binomial", "gamma", "beta", "beta-binomial")
#: The default of each prior scale; a fixed value.
PRIOR = 3.0


def _positive(**values: float) -> None:
    for name, v in values.items():
        if not v > 0:
            raise ValueError(f"{name} must be positive, not {v!r}")


@dataclass(frozen=True)
class Seasonality:
    name: str
    period_us: int
    order: int
    prior_scale: float = PRIOR

    def __post_init__(self) -> None:
        _positive(period=self.period_us, order=self.order, prior_scale=self.prior_scale)


@dataclass(frozen=True)
class External:
    name: str
    prior_scale: float = PRIOR

    def __post_init__(self) -> None:
        _positive(prior_scale=self.prior_scale)


#: Kinds of events; those that users add have a function of (event, first, last) that gives the anchors.
EVENT_KINDS: dict[str, Callable | None] = {"single": None, "intermittent": None, "periodic": None, "holiday": None, "table": None}


def register_event_kind(kind: str, anchors: Callable) -> None:
    """Add a kind of event: ``anchors(event, first, last)`` gives its anchors for data from first to last."""
    EVENT_KINDS[kind] = anchors


@dataclass(frozen=True)
class Event:
    """``kind`` single or intermittent: ``anchors``; periodic: one anchor and ``period_us``; holiday: by name and country.

    Kind table: any number of anchors, the timestamps in ``column`` of a table (a name, or the path of a Parquet table) that is read
    whenever the features are made; its columns ``by``, in the order of the spec's keys, say whose anchors they are, if they differ.
    """

    name: str
    kind: str
    profile: Profile
    anchors: tuple[datetime, ...] = ()
    period_us: int | None = None
    country: str | None = None
    subdiv: str | None = None
    holiday: str | None = None
    prior_scale: float = PRIOR
    include: bool | str = "auto"
    table: str | None = None
    column: str = "ds"
    by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _positive(prior_scale=self.prior_scale)
        if self.kind not in EVENT_KINDS:
            raise NotImplementedError(f"no event kind {self.kind!r}")
        if self.include not in (True, False, "auto"):
            raise ValueError("include is True, False or 'auto'")
        if self.kind in ("single", "periodic") and len(self.anchors) != 1:
            raise ValueError(f"a {self.kind} event has one anchor")
        if self.kind == "periodic":
            _positive(period=self.period_us or 0)
        if self.kind == "holiday" and not self.country:
            raise ValueError("a holiday needs its country")
        if (self.kind == "table") != (self.table is not None):
            raise ValueError("a table of anchors is what a table event has")
        if self.kind == "table" and self.profile.reach() is None:
            raise ValueError("anchors from a table need a profile that ends")

    def to_dict(self) -> dict:
        out = asdict(self) | {"profile": self.profile.to_dict(), "anchors": [a.isoformat() for a in self.anchors], "by": list(self.by)}
        return out if self.kind == "table" else {k: v for k, v in out.items() if k not in ("table", "column", "by")}

    @staticmethod
    def from_dict(data: dict) -> Event:
        for k in ("name", "kind", "profile"):
            if k not in data:
                raise KeyError(f"an event needs {k}")
        return Event(**{**data, "profile": Profile.from_dict(data["profile"]), "anchors": tuple(instant(a) for a in data.get("anchors", ())), "by": tuple(data.get("by", ()))})


@dataclass(frozen=True)
class Calendric:
    """Automatic seasonalities and holiday events, settled at the fit from the history's span."""

    country: str | None = None
    subdiv: str | None = None
    profile: Profile = BoxCar("1d")
    yearly: bool | int | str = "auto"
    quarterly: bool | int | str = False
    monthly: bool | int | str = False
    weekly: bool | int | str = "auto"
    daily: bool | int | str = "auto"
    seasonality_prior_scale: float | None = None
    event_prior_scale: float | None = None

    def __post_init__(self) -> None:
        for name in ("yearly", "quarterly", "monthly", "weekly", "daily"):
            v = getattr(self, name)
            if not (v is True or v is False or v == "auto" or (isinstance(v, int) and v >= 1)):
                raise ValueError(f"{name} must be True, False, 'auto' or a whole number >= 1")

    def to_dict(self) -> dict:
        return {"type": "Calendric", **asdict(self), "profile": self.profile.to_dict()}

    @staticmethod
    def from_dict(data: dict) -> Calendric:
        if data.get("type", "Calendric") != "Calendric":
            raise NotImplementedError(f"no protocol {data['type']!r}")
        profile = {"profile": Profile.from_dict(data["profile"])} if data.get("profile") else {}
        return Calendric(**{k: v for k, v in data.items() if k not in ("type", "profile")}, **profile)


#: Protocols by name; one of a user's own has to_dict and from_dict, and ``settle(spec, history, first, last)``, which gives the spec
#: with the terms that it adds.
PROTOCOLS: dict[str, type] = {"Calendric": Calendric}


def register_protocol(cls: type) -> type:
    """Make a protocol of one's own known by its name; usable as a decorator."""
    PROTOCOLS[cls.__name__] = cls
    return cls


def protocol_from_dict(data: dict) -> object:
    if data.get("type", "Calendric") not in PROTOCOLS:
        raise NotImplementedError(f"no protocol {data['type']!r}")
    return PROTOCOLS[data.get("type", "Calendric")].from_dict(data)


@dataclass(frozen=True)
class ModelSpec:
    model: str = "normal"
    sampling_period: str | int = "1d"
    timestamp_name: str = "ds"
    metric_name: str = "y"
    capacity_name: str = ""
    changepoints: tuple[datetime, ...] | None = None
    n_changepoints: int = 25
    changepoint_range: float = 0.8
    seasonality_prior_scale: float = PRIOR
    event_prior_scale: float = PRIOR
    changepoint_prior_scale: float = PRIOR
    dispersion_prior_scale: float = PRIOR
    interval_width: float = 0.8
    trend_samples: int = 1000
    keys: tuple[str, ...] = ()
    seasonalities: tuple[Seasonality, ...] = ()
    externals: tuple[External, ...] = ()
    events: tuple[Event, ...] = ()
    protocols: tuple[Calendric, ...] = ()
    seed: int = 0
    meta: dict = field(default_factory=dict, hash=False, compare=False)
    #: Settings of fit, predict and load_data that go with the model, by table.
    config: dict = field(default_factory=dict, hash=False, compare=False)

    def __post_init__(self) -> None:
        if self.model not in FAMILIES:
            raise NotImplementedError(f"no model {self.model!r}; there are {', '.join(FAMILIES)}")
        if {self.timestamp_name, self.metric_name, self.capacity_name} & WORKING:
            raise ValueError("a column has the name of a parameter or working column")
        if micros(self.sampling_period) <= 0:
            raise ValueError("sampling_period must be positive")
        if self.changepoints is not None:
            object.__setattr__(self, "changepoints", tuple(sorted(instant(c) for c in self.changepoints)))
            object.__setattr__(self, "n_changepoints", len(self.changepoints))
        if self.n_changepoints < 0 or self.trend_samples < 0:
            raise ValueError("n_changepoints and trend_samples must not be negative")
        for name in ("changepoint_range", "interval_width"):
            if not 0 < getattr(self, name) < 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        _positive(**{n: getattr(self, n) for n in ("seasonality_prior_scale", "event_prior_scale", "changepoint_prior_scale", "dispersion_prior_scale")})

    @property
    def step_us(self) -> int:
        return micros(self.sampling_period)

    @property
    def is_fitted(self) -> bool:
        return False

    @property
    def panels(self) -> list[str]:
        """What a component view shows, in order: the trend, each seasonality, events, external regressors."""
        return ["trend", *(s.name for s in self.seasonalities), *["events"] * bool(self.events), *["externals"] * bool(self.externals)]

    @property
    def inner_keys(self) -> list[str]:
        """Names of the key columns within the library, where no name of the data can clash."""
        return [f"_key{i}" for i in range(len(self.keys))]

    def _add(self, kind: str, term: Seasonality | External | Event) -> ModelSpec:
        others = [t.name for k in ("seasonalities", "externals", "events") if k != kind for t in getattr(self, k)]
        check_name(term.name, others, [self.timestamp_name, self.metric_name, *filter(None, [self.capacity_name])])
        same = [t for t in getattr(self, kind) if t.name != term.name]
        if len(same) < len(getattr(self, kind)):
            log.info("%s replaces the term of that name", term.name)
        return replace(self, **{kind: (*same, term)})

    def add_seasonality(self, name: str, period: str | int, order: int, prior_scale: float | None = None) -> ModelSpec:
        return self._add("seasonalities", Seasonality(name, micros(period), order, prior_scale or self.seasonality_prior_scale))

    def add_external(self, name: str, prior_scale: float | None = None) -> ModelSpec:
        return self._add("externals", External(name, prior_scale or self.event_prior_scale))

    def add_event(self, name: str, profile: Profile, kind: str = "single", anchors: list | tuple | str | datetime = (), period: str | int | None = None, country: str | None = None, subdiv: str | None = None, holiday: str | None = None, prior_scale: float | None = None, include: bool | str = "auto", table: str | None = None, column: str = "ds", by: tuple[str, ...] = ()) -> ModelSpec:
        at = (anchors,) if isinstance(anchors, str | datetime) else anchors
        return self._add("events", Event(name, kind, profile, tuple(instant(a) for a in at), micros(period) if period is not None else None, country, subdiv, holiday, prior_scale or self.event_prior_scale, include, table, column, tuple(by)))

    def add_protocol(self, protocol: Calendric) -> ModelSpec:
        return replace(self, protocols=(*self.protocols, protocol))

    def to_dict(self) -> dict:
        out = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("seasonalities", "externals", "events", "protocols", "changepoints")}
        return out | {
            "changepoints": None if self.changepoints is None else [c.isoformat() for c in self.changepoints],
            "keys": list(self.keys), "seasonalities": [asdict(s) for s in self.seasonalities], "externals": [asdict(e) for e in self.externals],
            "events": [e.to_dict() for e in self.events], "protocols": [p.to_dict() for p in self.protocols],
        }

    @staticmethod
    def from_dict(data: dict) -> ModelSpec:
        known = {f.name for f in fields(ModelSpec)}
        for k in set(data) - known:
            log.warning("unknown setting %s", k)
        d = {k: v for k, v in data.items() if k in known}
        made = {"seasonalities": lambda x: Seasonality(**x), "externals": lambda x: External(**x), "events": Event.from_dict, "protocols": protocol_from_dict}
        d |= {k: tuple(f(x) for x in d.get(k, ())) for k, f in made.items()}
        return ModelSpec(**d | {"keys": tuple(d.get("keys", ())), "changepoints": None if d.get("changepoints") is None else tuple(d["changepoints"])})
