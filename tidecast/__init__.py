"""Explainable forecasting of many time series on Spark."""

from tidecast.functions.holidays import holidays
from tidecast.functions.profiles import BoxCar, Cauchy, Exponential, Gaussian, register_profile
from tidecast.operators.diagnostics import anomalies, capacity_line, components, cross_validation, performance_metrics
from tidecast.operators.features import holiday_frame
from tidecast.operators.fit import FittedModel, fit
from tidecast.operators.grid import cast_kind, future_frame, sampling_period, time_index
from tidecast.operators.predict import predict
from tidecast.plans.config import from_json, model_from_toml, to_json
from tidecast.plans.errors import FittedError, NotFittedError, ValidationError
from tidecast.plans.logs import configure_logging
from tidecast.plans.spec import Calendric, Event, External, ModelSpec, Seasonality, register_event_kind, register_protocol
from tidecast.sources.tables import load_data, load_model, model_from_json, model_to_json, save_model

__all__ = [
    "BoxCar", "Calendric", "Cauchy", "Event", "Exponential", "External", "FittedError", "FittedModel", "Gaussian", "ModelSpec", "NotFittedError", "Seasonality", "ValidationError",
    "anomalies", "capacity_line", "cast_kind", "configure_logging", "components", "cross_validation", "fit", "from_json", "future_frame", "holiday_frame", "holidays", "load_data", "load_model", "model_from_json", "model_from_toml", "model_to_json", "performance_metrics",
    "predict", "register_event_kind", "register_profile", "register_protocol", "sampling_period", "save_model", "time_index", "to_json",
]
