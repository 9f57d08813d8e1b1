"""Candidate metrics and the nested experiment log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens.operators.ranking import METRICS

RAW_METRICS = [raw for raw, _ in METRICS.values()]
NORMALISED_METRICS = [name for _, name in METRICS.values()]


def save_candidates(ranked_and_failed: DataFrame, path: str) -> None:
    """Write candidate rows, ranked and failed, as one table."""
    ranked_and_failed.write.mode("overwrite").parquet(path)


def experiment_records(ranked: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One nested record per task and experiment.

    ``ranked`` has ``experiment_id`` and ``timestamp`` columns. The arrays hold the
    candidates of one experiment in rank order, so their size is the number of models.
    """
    keys = ["task_name", "experiment_id"]
    model = ["rank", "model_name"]
    ordered = F.array_sort(
        F.collect_list(F.struct(*model, *RAW_METRICS, *NORMALISED_METRICS, "composite_score", "is_selected"))
    )
    records = ranked.groupBy(*keys).agg(
        F.max("timestamp").alias("timestamp"),
        F.first("selection_profile").alias("selection_profile"),
        F.first("profile_weights").alias("profile_weights"),
        ordered.alias("__c"),
    )

    def part(*fields: str):
        return F.transform("__c", lambda c: F.struct(*[c[f].alias(f) for f in fields]))

    made = records.select(
        *keys,
        "timestamp",
        "selection_profile",
        "profile_weights",
        F.transform("__c", lambda c: c["model_name"]).alias("candidates"),
        F.get("__c", F.lit(0))["model_name"].alias("selected_model"),
        part("model_name", *RAW_METRICS).alias("raw_metrics"),
        part("model_name", *NORMALISED_METRICS).alias("normalised_metrics"),
        part("model_name", "composite_score", "rank", "is_selected").alias("composite_scores"),
    )
    if failed is None:
        return made
    errors = failed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("model_name", "error"))).alias("failed_candidates")
    )
    return made.join(errors, keys, "left")


def append_records(records: DataFrame, path: str) -> None:
    """Write experiment records, one partition per task and experiment; a rerun replaces its own."""
    # marked, so that an id of digits is not read as a number
    marked = records.withColumn("__experiment", F.concat(F.lit("x_"), "experiment_id"))
    writer = marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("task_name", "__experiment").parquet(path)


def load_records(spark: SparkSession, path: str, task: str | None = None) -> DataFrame:
    found = spark.read.parquet(path).drop("__experiment")
    return found if task is None else found.where(F.col("task_name") == task)


def latest_per_task(records: DataFrame) -> DataFrame:
    """The newest record of every task; equal times fall to the greater experiment id."""
    newest = F.max_by(F.struct("*"), F.struct("timestamp", "experiment_id")).alias("__r")
    return records.groupBy(F.col("task_name").alias("__task")).agg(newest).select("__r.*")


def keep_newest(records: DataFrame, per_task: int = 50) -> DataFrame:
    """The ``per_task`` newest records of every task."""
    newest_first = Window.partitionBy("task_name").orderBy(F.desc("timestamp"), F.desc("experiment_id"))
    numbered = records.withColumn("__age", F.row_number().over(newest_first))
    return numbered.where(F.col("__age") <= per_task).drop("__age")


def explode_candidates(records: DataFrame) -> DataFrame:
    """Candidate rows of nested records: the three arrays are matched by position."""
    zipped = F.explode(F.arrays_zip("raw_metrics", "normalised_metrics", "composite_scores")).alias("c")
    return records.select("task_name", "experiment_id", "timestamp", "selection_profile", zipped).select(
        "task_name",
        "experiment_id",
        "timestamp",
        "selection_profile",
        F.col("c.raw_metrics.model_name").alias("model_name"),
        *[F.col(f"c.raw_metrics.{m}").alias(m) for m in RAW_METRICS],
        *[F.col(f"c.normalised_metrics.{m}").alias(m) for m in NORMALISED_METRICS],
        F.col("c.composite_scores.composite_score").alias("composite_score"),
        F.col("c.composite_scores.rank").alias("rank"),
        F.col("c.composite_scores.is_selected").alias("is_selected"),
    )


def flatten_records(records: DataFrame) -> DataFrame:
    """One row per record with its counts and selected model."""
    return records.select(
        "task_name",
        "experiment_id",
        "timestamp",
        "selection_profile",
        "selected_model",
        F.size("candidates").alias("candidate_count"),
        F.array_join("candidates", ", ").alias("candidate_list"),
        F.round(F.get("composite_scores", F.lit(0))["composite_score"], 6).alias("best_score"),
    )
