"""The stored model: fitted pipeline, lookups, evaluation and metadata in one folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadcurve.constants import ABSOLUTE_FEATURE_COLUMNS, FEATURE_COLUMNS
from leadcurve.sources import sinks

MODEL_KIND = "relative_remaining"
ABSOLUTE_KIND = "absolute_fare"
MODEL_VERSION = "0.1.0"


@dataclass(frozen=True)
class Bundle:
    model: PipelineModel
    kind: str
    version: str
    feature_columns: list[str]
    routes: DataFrame  # route names the model knows
    route_lookup: DataFrame
    global_lookup: DataFrame
    evaluation: DataFrame


def save_bundle(
    path: str,
    model: PipelineModel,
    routes: DataFrame,
    route_lookup: DataFrame,
    global_lookup: DataFrame,
    evaluation: DataFrame,
    kind: str = MODEL_KIND,
) -> None:
    model.write().overwrite().save(f"{path}/model")
    sinks.write_table(routes.select("route").distinct(), f"{path}/routes")
    sinks.write_table(route_lookup, f"{path}/route_lookup")
    sinks.write_table(global_lookup, f"{path}/global_lookup")
    sinks.write_record(evaluation, f"{path}/evaluation")
    columns = ABSOLUTE_FEATURE_COLUMNS if kind == ABSOLUTE_KIND else FEATURE_COLUMNS
    about = route_lookup.sparkSession.range(1).select(
        F.lit(kind).alias("kind"),
        F.lit(MODEL_VERSION).alias("version"),
        F.array(*[F.lit(c) for c in columns]).alias("feature_columns"),
    )
    sinks.write_record(about, f"{path}/about")


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    about = spark.read.json(f"{path}/about").first()
    return Bundle(
        model=PipelineModel.load(f"{path}/model"),
        kind=about["kind"],
        version=about["version"],
        feature_columns=list(about["feature_columns"]),
        routes=spark.read.parquet(f"{path}/routes"),
        route_lookup=spark.read.parquet(f"{path}/route_lookup"),
        global_lookup=spark.read.parquet(f"{path}/global_lookup"),
        evaluation=spark.read.json(f"{path}/evaluation"),
    )
