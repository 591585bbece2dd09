"""Stored feature sets, models and run records."""

from __future__ import annotations

import json

from pyspark.ml.linalg import VectorUDT
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import exists


def write_features(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ids, ``features`` vector and ``label`` as Parquet; a text label stays text."""
    if not isinstance(df.schema["label"].dataType, T.StringType):
        df = df.withColumn("label", F.col("label").cast("double"))
    df.write.mode(mode).parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Read a feature set back; 0/1 labels become whole numbers."""
    if not exists(spark, path):
        raise FileNotFoundError(f"File not found: {path}")
    df = spark.read.parquet(path)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if not isinstance(kinds.get("features"), VectorUDT) or "label" not in kinds:
        raise ValueError("expected a vector column 'features' and a column 'label'")
    if isinstance(kinds["label"], (T.DoubleType, T.FloatType)):
        other = df.filter(F.col("label").isNotNull() & ~F.col("label").isin(0.0, 1.0)).isEmpty()
        if other:
            df = df.withColumn("label", F.col("label").cast("int"))
    return df


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str):
    """Load any saved Spark ML model; its class is part of what was saved."""
    if not exists(spark, path):
        raise FileNotFoundError(f"Model not found: {path}")
    return DefaultParamsReader.loadParamsInstance(path, spark.sparkContext)


def write_metadata(spark: SparkSession, metadata: dict, path: str) -> None:
    """Store run settings as one JSON row."""
    row = spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "settings string")
    row.coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    if not exists(spark, path):
        raise FileNotFoundError(f"File not found: {path}")
    return json.loads(spark.read.text(path).first()[0])


def write_metrics(df: DataFrame, path: str, run: str) -> None:
    """Store ``(model, metric, value)`` rows as those of a run; an earlier run of that name is replaced."""
    df.select("model", "metric", "value").write.mode("overwrite").parquet(_run_path(path, run))


def read_metrics(spark: SparkSession, path: str, run: str) -> DataFrame:
    return spark.read.parquet(_run_path(path, run))


def _run_path(path: str, run: str) -> str:
    if not run or set(run) & set("/\\=*?[]{}:"):
        raise ValueError(f"unusable run name {run!r}")
    return f"{path}/run={run}"


def save_report(df: DataFrame, path: str) -> None:
    """Write the six-row evaluation report as CSV."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
