"""From a delimited file of readings to energy tables, selected models and report tables.

Each step takes and returns tables; ``run`` puts them in a row and writes every result
below one folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.functions.calendar import text_timestamp
from loadlens.operators import chartdata, clean, energy, evaluate, features, models, prep, quality, ranking
from loadlens.operators.ordered import OrderedRows, order_rows
from loadlens.sources import experiments, readings, tables
from loadlens.sources.shared import stage, staging


@dataclass
class Options:
    """Settings of a run; the defaults are those of the single steps."""

    delimiter: str = readings.DELIMITER
    missing: str = readings.MISSING
    max_null_percentage: float = quality.MAX_NULL_PERCENTAGE
    quantile_error: float = clean.QUANTILE_ERROR
    skip_zero_iqr: bool = False
    feature_set: str = "reference"
    test_ratio: float = prep.TEST_RATIO
    profile: str = ranking.ACTIVE_PROFILE
    model_settings: dict[str, dict] = field(default_factory=lambda: models.SETTINGS)
    tune: bool = True
    search_spaces: dict[str, dict] = field(default_factory=lambda: models.SEARCH_SPACES)
    fold_strategy: str = "chronological"
    folds: int = prep.FOLDS
    fold_width: int | None = None
    validation_ratio: float | None = None  # the last share of the training rows validates, in one fold
    tuning_metric: str = "rmse"
    search_strategy: str = "grid_search"
    search_combinations: int | None = None
    search_seed: int = models.SEARCH_SEED
    test: str = "wilcoxon"
    alpha: float = evaluate.ALPHA
    correction: str = "bonferroni"


def read_valid(spark: SparkSession, path: str, options: Options, report_path: str | None = None) -> DataFrame:
    """Text readings; raises when a check of the validation report fails, which is kept at ``report_path``."""
    raw = readings.read_readings(spark, path, delimiter=options.delimiter, missing=options.missing, keep_corrupt=True)
    report = quality.validation_report(raw, max_null_percentage=options.max_null_percentage)
    if report_path:
        report = stage(report, "validation")
        tables.save_flat_report(report, report_path)
    quality.require_valid(report)
    return raw.drop(readings.CORRUPT)


def cleaned(raw: DataFrame, options: Options) -> OrderedRows:
    """Typed, distinct, filled and capped readings in time order."""
    typed = clean.drop_duplicate_rows(clean.cast_numeric(raw))
    stamped = typed.select(
        text_timestamp(F.col("Date"), F.col("Time")).alias("Timestamp"), *clean.READING_COLUMNS
    )
    # distinct rows: time and readings together are a unique order
    ordered = order_rows(stamped, ["Timestamp", *clean.READING_COLUMNS])
    return clean.clean_rows(
        ordered, relative_error=options.quantile_error, skip_zero_iqr=options.skip_zero_iqr
    )


def train_and_rank(
    spark: SparkSession, ordered: OrderedRows, experiment_id: str, options: Options, models_path: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Ranked candidates, failed candidates, predictions and importances of all tasks.

    All fitted models are kept below ``models_path``.
    """
    tasks = prep.tasks(options.feature_set)
    data = [models.prepare_task(ordered, task, test_ratio=options.test_ratio) for task in tasks.values()]

    def folds(task: models.TaskData) -> list[prep.Fold]:
        if options.validation_ratio is not None:
            return prep.chronological_folds(task.train_rows, val_ratio=options.validation_ratio)
        return prep.series_folds(options.fold_strategy, options.folds, width=options.fold_width)

    search = {
        "metric": options.tuning_metric, "strategy": options.search_strategy, "combinations": options.search_combinations,
        "seed": options.search_seed,
    }
    found = models.train_all(
        data, folds if options.tune else None, settings=options.model_settings, spaces=options.search_spaces, search=search
    )
    at = {"experiment_id": F.lit(experiment_id), "timestamp": F.current_timestamp()}
    metrics = models.candidate_metrics(spark, found).withColumns(at)
    ranked = stage(ranking.rank_candidates(metrics, options.profile), "ranked")
    if models_path:
        # one row per task
        selected = {r["task_name"]: r["model_name"] for r in ranking.winners(ranked).select("task_name", "model_name").collect()}
        models.save_models(spark, found, tasks, models_path, experiment_id, selected, overwrite=True)
    failed = models.failed_candidates(spark, found).withColumn("experiment_id", F.lit(experiment_id))
    return ranked, failed, models.predictions_of(spark, found), models.feature_importance(spark, found, tasks)


def report_tables(
    ranked: DataFrame, predictions: DataFrame, importances: DataFrame, options: Options
) -> dict[str, DataFrame]:
    """Performance, resources, selection, tests, top features and the summary over tasks."""
    metrics = evaluate.regression_metrics(predictions)
    selected = ranking.winners(ranked).select(F.col("task_name").alias("Task"), F.col("model_name").alias("Model"))
    tested = evaluate.compare_predictors(
        predictions, selected, on=("Row",), test=options.test, alpha=options.alpha, correction=options.correction
    )
    return {
        "performance": chartdata.performance_table(metrics, selected),
        "resources": chartdata.resource_table(ranked),
        "selection": chartdata.selection_table(ranked),
        "statistics": chartdata.statistics_table(tested),
        "top_features": chartdata.top_feature_list(importances),
        "cross_task": evaluate.cross_task_summary(metrics, ranking.composite_vs_rmse(ranked)),
    }


def run(
    spark: SparkSession, path: str, out: str, experiment_id: str, options: Options | None = None
) -> dict[str, str]:
    """Run every step and return the paths of what was written; nothing stays in the shared folder."""
    with staging(spark):
        return _run(spark, path, out, experiment_id, options or Options())


def _run(spark: SparkSession, path: str, out: str, experiment_id: str, options: Options) -> dict[str, str]:
    written = {"energy": f"{out}/energy", "validation": f"{out}/report/validation", "models": f"{out}/models"}
    ordered = cleaned(read_valid(spark, path, options, written["validation"]), options)
    written["dataset"] = f"{out}/report/dataset"
    tables.save_flat_report(quality.dataset_summary(ordered.df, clean.READING_COLUMNS), written["dataset"])
    tables.save_aggregates(energy.energy_tables(ordered.df), written["energy"])
    made = features.add_features(ordered)
    written["features"] = tables.save_features(made.df, f"{out}/features", overwrite=True)
    # later steps read the saved features instead of computing them again
    stored = made.with_df(tables.load_features(spark, f"{out}/features"))
    ranked, failed, predicted, importances = train_and_rank(
        spark, stored, experiment_id, options, written["models"]
    )
    written["importances"] = f"{out}/importances/{experiment_id}"
    importances.write.mode("overwrite").parquet(written["importances"])
    written["predictions"] = tables.save_predictions(predicted, f"{out}/predictions", experiment_id, overwrite=True)
    written["candidates"] = f"{out}/candidates/{experiment_id}"
    experiments.save_candidates(ranking.with_failed(ranked, failed), written["candidates"])
    written["experiments"] = f"{out}/experiments"
    experiments.append_records(experiments.experiment_records(ranked, failed), written["experiments"])
    kept = tables.load_predictions(spark, f"{out}/predictions", version=experiment_id)
    for name, table in report_tables(ranked, kept, importances, options).items():
        written[name] = f"{out}/report/{name}"
        tables.save_flat_report(table, written[name])
    return written
