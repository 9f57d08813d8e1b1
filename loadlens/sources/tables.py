"""Versioned feature tables, prediction tables, aggregates and flat reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "v1"

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("Timestamp", T.TimestampType()),
        T.StructField("Actual", T.DoubleType()),
        T.StructField("Predicted", T.DoubleType()),
        T.StructField("Task", T.StringType()),
        T.StructField("Model", T.StringType()),
    ]
)


def save_features(df: DataFrame, base: str, version: str = VERSION, *, overwrite: bool = False) -> str:
    """Write one version of a feature table; an existing version is an error unless ``overwrite``."""
    path = f"{base}/{version}"
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    return path


def load_features(spark: SparkSession, base: str, version: str = VERSION) -> DataFrame:
    """Read one version of a feature table; a version that is not there is an error."""
    return spark.read.parquet(f"{base}/{version}")


def save_predictions(df: DataFrame, base: str, version: str = VERSION, *, overwrite: bool = False) -> str:
    """Write predictions partitioned by task and model below their version.

    Rows are rebalanced by partition first, so that each folder gets few files and a
    large one is still written by many tasks.
    """
    path = f"{base}/version={version}"
    df.hint("rebalance", "Task", "Model").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("Task", "Model").parquet(path)
    return path


def load_predictions(
    spark: SparkSession, base: str, task: str | None = None, model: str | None = None, version: str = VERSION
) -> DataFrame:
    """Read predictions; task, model and version are partitions, so others are not scanned."""
    found = spark.read.option("basePath", base).parquet(f"{base}/version={version}")
    if task is not None:
        found = found.where(F.col("Task") == task)
    if model is not None:
        found = found.where(F.col("Model") == model)
    return found


def save_aggregates(frames: dict[str, DataFrame], base: str) -> None:
    """Write each aggregate, such as hourly energy, to its own folder, replacing the last."""
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{base}/{name}")


def load_aggregate(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}")


def save_flat_report(df: DataFrame, base: str, formats: tuple[str, ...] = ("json", "csv")) -> dict[str, str]:
    """Write a report table once per format: ``csv`` with header, ``json`` or ``parquet``."""
    paths = {}
    for kind in formats:
        paths[kind] = f"{base}/{kind}"
        writer = df.write.mode("overwrite")
        if kind == "csv":
            writer.option("header", True).csv(paths[kind])
        elif kind == "json":
            writer.option("ignoreNullFields", False).json(paths[kind])
        elif kind == "parquet":
            writer.parquet(paths[kind])
        else:
            raise ValueError(f"unknown report format {kind}")
    return paths


def load_flat_report(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    """Read a report table back with its declared schema."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)
