"""Settings in layers: defaults, then a global TOML file, then the call's, then arguments."""

from __future__ import annotations

import copy
import json
import logging
import tomllib
from collections.abc import Iterable
from dataclasses import fields, replace

from tidecast.functions.durations import micros
from tidecast.functions.profiles import Profile
from tidecast.plans.spec import ModelSpec, protocol_from_dict

log = logging.getLogger(__name__)

#: Defaults of each table; fixed values.
DEFAULTS = {
    "fit": {"optimize_mode": "MAP", "use_laplace": False, "capacity": None, "capacity_mode": "scale", "capacity_value": 0.5},
    "predict": {"periods": 1, "include_history": True},
    "load_data": {"source": "", "dtype_kind": "f"},
}


def _capacity(layer: dict) -> dict:
    """A layer that names one form of capacity clears the other."""
    if layer.get("capacity") is not None:
        return {"capacity_mode": None, "capacity_value": None} | layer
    if layer.get("capacity_mode") is not None or layer.get("capacity_value") is not None:
        return {"capacity": None} | layer
    return layer


def read_toml(path: str | None) -> dict:
    if path is None:
        return {}
    with open(path, "rb") as f:
        return tomllib.load(f)


def given(**values: object) -> dict:
    """The arguments that a caller has set: those that are not None."""
    return {k: v for k, v in values.items() if v is not None}


def settings(table: str, model_config: dict | None = None, toml_path: str | None = None, **kwargs: object) -> dict:
    """The settled settings of fit, predict or load_data; unknown keys are dropped with a warning."""
    out = copy.deepcopy(DEFAULTS[table])
    for layer in ((model_config or {}).get(table, {}), read_toml(toml_path).get(table, {}), kwargs):
        known = {k: v for k, v in layer.items() if k in out}
        for k in set(layer) - set(known):
            log.warning("unknown setting %s in [%s]", k, table)
        out |= _capacity(known) if table == "fit" else known
    return out


def model_from_toml(path: str, ignore: Iterable[str] = (), **overrides: object) -> tuple[ModelSpec, dict]:
    """The spec that [model], [[seasonalities]], [[events]], [[external_regressors]] and [[protocols]] tell, and the file.

    The spec keeps [fit], [predict] and [load_data] as its own settings. ``ignore`` names tables of the file to leave out.
    """
    data = {k: v for k, v in read_toml(path).items() if k not in set(ignore)}
    names = {f.name for f in fields(ModelSpec)}
    base = data.get("model", {}) | overrides
    for k in set(base) - names:
        log.warning("unknown setting %s in [model]", k)
    spec = ModelSpec.from_dict({k: v for k, v in base.items() if k in names})
    for s in data.get("seasonalities", ()):
        spec = spec.add_seasonality(s["name"], s["period"], s.get("order", s.get("fourier_order")), s.get("prior_scale"))
    for e in data.get("external_regressors", ()):
        spec = spec.add_external(e["name"], e.get("prior_scale"))
    for e in data.get("events", ()):
        spec = spec.add_event(**{**e, "profile": Profile.from_dict(e["profile"])})
    for p in data.get("protocols", ()):
        spec = spec.add_protocol(protocol_from_dict(dict(p)))
    micros(spec.sampling_period)
    return replace(spec, config={k: data[k] for k in DEFAULTS if k in data}), data


def to_json(spec: ModelSpec, path: str | None = None) -> str:
    text = json.dumps(spec.to_dict(), indent=2)
    if path is not None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return text


def from_json(text_or_path: str) -> ModelSpec:
    if not text_or_path.lstrip().startswith("{"):
        with open(text_or_path, encoding="utf-8") as f:
            text_or_path = f.read()
    return ModelSpec.from_dict(json.loads(text_or_path))
