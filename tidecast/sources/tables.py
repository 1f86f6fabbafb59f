"""Histories from files and tables; models to and from a folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidecast.functions.durations import instant
from tidecast.operators.fit import FittedModel
from tidecast.operators.grid import cast_kind
from tidecast.plans.config import given, settings
from tidecast.plans.spec import ModelSpec


def load_data(spark: SparkSession, source: str | None = None, timestamp_name: str = "ds", metric_name: str = "y", dtype_kind: str | None = None, format: str = "csv", schema: str | None = None, config: dict | None = None, toml_path: str | None = None) -> DataFrame:  # noqa: A002
    """Read a history, make its timestamp one without a zone, and cast its metric by kind.

    ``source`` and ``dtype_kind`` come from [load_data] of the TOML file or of ``config`` (a spec's own settings) if not given.
    """
    asked = settings("load_data", config, toml_path, **given(source=source, dtype_kind=dtype_kind))
    source, dtype_kind = asked["source"], asked["dtype_kind"]
    if not source:
        raise ValueError("no source to read from")
    if format == "table":
        df = spark.table(source)
    elif format == "csv":
        df = spark.read.csv(source, header=True, schema=schema, inferSchema=schema is None)
    else:
        reader = spark.read.format(format)
        df = (reader.schema(schema) if schema else reader).load(source)
    return df.withColumn(timestamp_name, F.col(timestamp_name).cast("timestamp_ntz")).withColumn(metric_name, cast_kind(F.col(metric_name), dtype_kind))


def save_model(model: FittedModel, path: str) -> None:
    """Parameters as Parquet, the rest as one JSON line; overwrites."""
    model.params.write.mode("overwrite").parquet(f"{path}/params")
    text = json.dumps({"spec": model.spec.to_dict(), "start": model.start.isoformat(), "end": model.end.isoformat(), "options": model.options})
    model.params.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> FittedModel:
    data = json.loads(spark.read.text(f"{path}/model").first()["value"])
    return FittedModel(ModelSpec.from_dict(data["spec"]), spark.read.parquet(f"{path}/params"), instant(data["start"]), instant(data["end"]), data["options"])


def model_to_json(model: FittedModel) -> str:
    """A fitted model as one text. Its parameters come to the driver: for a few series; for many there is ``save_model``."""
    rows = [json.loads(r) for r in model.params.toJSON().collect()]
    return json.dumps({"spec": model.spec.to_dict(), "start": model.start.isoformat(), "end": model.end.isoformat(), "options": model.options, "schema": model.params.schema.json(), "params": rows})


def model_from_json(spark: SparkSession, text: str) -> FittedModel:
    data = json.loads(text)
    schema = StructType.fromJson(json.loads(data["schema"]))
    lines = spark.createDataFrame([(json.dumps(r),) for r in data["params"]], "value string")
    params = lines.select(F.from_json("value", schema).alias("p")).select("p.*")
    return FittedModel(ModelSpec.from_dict(data["spec"]), params, instant(data["start"]), instant(data["end"]), data["options"])
