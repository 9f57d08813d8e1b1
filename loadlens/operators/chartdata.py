"""The data behind the usual charts and report tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions.formatting import NOT_AVAILABLE, number_text, scientific_text, selected_mark, yes_no
from loadlens.operators.ordered import order_rows, series_position
from loadlens.operators.ranking import METRICS
from loadlens.sources.shared import stage

# Fixed values
HISTOGRAM_BINS = 60
KDE_POINTS = 300
DISPLAY_POINTS = 5000
TOP_FEATURES = 15
RESOURCE_PAIRS = [
    ("training_time", "rmse"),
    ("prediction_time", "rmse"),
    ("memory_usage_mb", "rmse"),
    ("training_time", "mae"),
    ("composite_score", "rmse"),
]
GRID_METRICS = ["rmse", "mae", "r2", "training_time", "prediction_time"]

SERIES = ("Task", "Model")
# a Gaussian further than this many bandwidths away is 0 in double precision
_KERNEL_REACH = 39.0
_CELLS, _ORDER = 16, 12  # cells in a bandwidth, highest power of the series


def _residual(actual: str, predicted: str) -> Column:
    return F.col(actual) - F.col(predicted)


def _summary(df: DataFrame) -> DataFrame:
    """A table with one row per series, staged: its size is known when a join is planned.

    A small one is broadcast and the rows are not shuffled by series, where one series
    may hold most of them; a large one is joined by sorting, with skewed parts split.
    """
    return stage(df, "summary")


def residual_series(
    predictions: DataFrame,
    *,
    order_by: Sequence[str] = ("Timestamp",),
    keys: Sequence[str] = SERIES,
    actual: str = "Actual",
    predicted: str = "Predicted",
) -> DataFrame:
    """Residuals with their step number within each series."""
    made = predictions.select(*keys, *order_by, _residual(actual, predicted).alias("residual"))
    return series_position(order_rows(made, order_by, keys), "step").df.drop("__rn")


def display_sample(
    positioned: DataFrame, *, keys: Sequence[str] = SERIES, step: str = "step", points: int = DISPLAY_POINTS
) -> DataFrame:
    """At most ``points`` evenly spaced rows of each series, first and last included."""
    counted = _summary(positioned.groupBy(*keys).agg(F.count("*").alias("__n")))
    rows = positioned.join(counted, list(keys))
    width = (F.col("__n") - 1) / F.lit(points - 1)
    near = F.rint(F.col(step) / width)
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        point = near + shift
        hit = hit | (point.between(0, points - 1) & (F.rint(point * width) == F.col(step)))
    return rows.where((F.col("__n") <= points) | hit).drop("__n")


def residual_histogram(
    predictions: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    bins: int = HISTOGRAM_BINS,
    actual: str = "Actual",
    predicted: str = "Predicted",
) -> DataFrame:
    """Equal-width bins of the residuals with counts and density, empty bins included."""
    residuals = predictions.select(*keys, _residual(actual, predicted).alias("x"))
    found = residuals.groupBy(*keys).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n"))
    flat = F.col("low") == F.col("high")
    ranges = _summary(
        found.select(
            *keys,
            "n",
            F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
            F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
        )
    )
    place = F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins)
    counts = (
        residuals.where(F.col("x").isNotNull())
        .join(ranges, list(keys))
        .select(*keys, F.least(place, F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy(*keys, "bin")
        .agg(F.count("*").alias("count"))
    )
    width = (F.col("high") - F.col("low")) / bins
    all_bins = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return all_bins.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("low") + F.col("bin") * width).alias("left_edge"),
        (F.col("low") + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("count", F.lit(0)).alias("count"),
        (F.coalesce("count", F.lit(0)) / (F.col("n") * width)).alias("density"),
    )


def residual_kde(
    predictions: DataFrame,
    *,
    keys: Sequence[str] = SERIES,
    points: int = KDE_POINTS,
    actual: str = "Actual",
    predicted: str = "Predicted",
) -> DataFrame:
    """Gaussian kernel density of the residuals on an even grid, Scott's bandwidth.

    Residuals are summed up in cells of a sixteenth of the bandwidth, as power sums around
    the cell's centre; each cell then adds to the grid points its kernel reaches, by the
    kernel's Taylor series there. What is cut off is below 1e-12 of the term itself within 20
    bandwidths, beyond which terms are below 1e-86. So the rows are read once and only cells, whose number hardly grows, meet the grid.
    """
    residuals = predictions.select(*keys, _residual(actual, predicted).alias("x")).where(F.col("x").isNotNull())
    found = residuals.groupBy(*keys).agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n"), F.stddev_samp("x").alias("sd")
    )
    # a series of one value has no density
    grids = _summary(
        found.where(F.col("sd") > 0).select(
            *keys,
            "low",
            "n",
            (F.pow(F.col("n"), F.lit(-0.2)) * F.col("sd")).alias("h"),
            ((F.col("high") - F.col("low")) / (points - 1)).alias("gap"),
            # a number is cheaper to group by than the names, once per kernel and grid point
            F.monotonically_increasing_id().alias("series"),
        )
    )
    cell = F.floor((F.col("x") - F.col("low")) / (F.col("h") / _CELLS))
    centre = F.col("low") + (F.col("cell") + 0.5) * (F.col("h") / _CELLS)
    offset = (F.col("x") - centre) / F.col("h")
    powers = (
        residuals.join(grids.select(*keys, "series", "low", "h"), list(keys))
        .withColumn("cell", cell)
        .groupBy("series", "cell")
        .agg(*[F.sum(F.pow(offset, F.lit(k))).alias(f"m{k}") for k in range(_ORDER + 1)])
    )
    # coefficients of powers of the distance: power sums weigh Hermite polynomials
    coefficients = [np.zeros(_ORDER + 1) for _ in range(_ORDER + 1)]
    for k in range(_ORDER + 1):
        weights = np.polynomial.hermite_e.herme2poly([0] * k + [1]) / math.factorial(k)
        for j, w in enumerate(weights):
            coefficients[j][k] = w
    sums_of = [
        sum((F.col(f"m{k}") * float(c[k]) for k in range(_ORDER + 1) if c[k]), F.lit(0.0)).alias(f"c{j}")
        for j, c in enumerate(coefficients)
    ]
    rows = powers.select("series", "cell", *sums_of).join(grids, "series").withColumn("centre", centre)
    middle, reach = (F.col("centre") - F.col("low")) / F.col("gap"), F.col("h") * _KERNEL_REACH / F.col("gap")
    first = F.greatest(F.floor(middle - reach), F.lit(0))
    last = F.least(F.ceil(middle + reach), F.lit(points - 1))
    spread = rows.withColumn("point", F.explode(F.sequence(first, last)))
    spread = spread.withColumn("d", (F.col("low") + F.col("point") * F.col("gap") - F.col("centre")) / F.col("h"))
    series_sum = F.col(f"c{_ORDER}")
    for j in reversed(range(_ORDER)):
        series_sum = series_sum * F.col("d") + F.col(f"c{j}")
    sums = spread.groupBy("series", "point").agg(F.sum(F.exp(-0.5 * F.col("d") * F.col("d")) * series_sum).alias("s"))
    all_points = grids.withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))))
    return all_points.join(sums, ["series", "point"], "left").select(
        *keys,
        F.col("point").cast("int").alias("point"),
        (F.col("low") + F.col("point") * F.col("gap")).alias("x"),
        (F.coalesce("s", F.lit(0.0)) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"),
    )


def extent(
    predictions: DataFrame, *, keys: Sequence[str] = SERIES, actual: str = "Actual", predicted: str = "Predicted"
) -> DataFrame:
    """Smallest and largest of actual and predicted values."""
    return predictions.groupBy(*keys).agg(
        F.least(F.min(actual), F.min(predicted)).alias("low"),
        F.greatest(F.max(actual), F.max(predicted)).alias("high"),
    )


# ---------------------------------------------------------------- candidates (one row per task and model)


def pareto_frontier(
    ranked: DataFrame, x: str = "training_time", y: str = "rmse", group: Sequence[str] = ("task_name",)
) -> DataFrame:
    """Candidates that no cheaper candidate beats: y below that of all with smaller x."""
    window = Window.partitionBy(*group).orderBy(x, y, "model_name").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(y).over(window)
    known = ranked.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.withColumn("__best", best).where(F.col("__best").isNull() | (F.col(y) < F.col("__best"))).drop("__best")


def resource_pairs(ranked: DataFrame, pairs: Sequence[tuple[str, str]] = tuple(RESOURCE_PAIRS)) -> DataFrame:
    """Points of the accuracy against resource charts; points with a missing side are left out."""
    points = F.array(
        *[
            F.struct(
                F.lit(x).alias("x_metric"), F.lit(y).alias("y_metric"), F.col(x).alias("x"), F.col(y).alias("y")
            )
            for x, y in pairs
        ]
    )
    made = ranked.select("task_name", "model_name", "rank", F.explode(points).alias("p"))
    return made.select("task_name", "model_name", "rank", "p.*").where(F.col("x").isNotNull() & F.col("y").isNotNull())


def score_breakdown(ranked: DataFrame) -> DataFrame:
    """Weight times normalised value for every metric of every candidate."""
    parts = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric"),
                F.col("profile_weights")[metric].alias("weight"),
                F.col(name).alias("normalised"),
            )
            for metric, (_, name) in METRICS.items()
        ]
    )
    made = ranked.select("task_name", "model_name", "rank", F.explode(parts).alias("p")).select(
        "task_name", "model_name", "rank", "p.*"
    )
    return made.where(F.col("weight") > 0).withColumn("contribution", F.col("weight") * F.col("normalised"))


def dual_rank(ranked: DataFrame) -> DataFrame:
    """Rank by RMSE beside the composite rank."""
    by_rmse = Window.partitionBy("task_name").orderBy(F.asc_nulls_last("rmse"), "rank")
    return ranked.select(
        "task_name", "model_name", "rmse", "composite_score", "rank", F.row_number().over(by_rmse).alias("rmse_rank")
    )


def metric_grid(ranked: DataFrame, metrics: Sequence[str] = tuple(GRID_METRICS)) -> DataFrame:
    """Raw metrics of each candidate, one column per metric."""
    return ranked.select("task_name", "model_name", *metrics)


def model_order(metrics: DataFrame) -> DataFrame:
    """Order of the models per task and metric: R2 falling, the rest rising.

    MAPE is left out of tasks where no model's MAPE is reliable.
    """
    task = Window.partitionBy("Task")
    usable = metrics.withColumn("__any", F.bool_or("mape_is_reliable").over(task))
    values = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("rmse", "mae", "r2")],
        F.struct(F.lit("mape").alias("metric"), F.when(F.col("__any"), F.col("mape")).alias("value")),
    )
    long = usable.select("Task", "Model", F.explode(values).alias("m")).select("Task", "Model", "m.*")
    cost = F.when(F.col("metric") == "r2", -F.col("value")).otherwise(F.col("value"))
    window = Window.partitionBy("Task", "metric").orderBy(cost, "Model")
    return long.where(F.col("value").isNotNull()).withColumn("position", F.row_number().over(window))


def task_order(ranked: DataFrame, metric: str = "rmse") -> DataFrame:
    """The selected model's metric per task, sorted."""
    chosen = ranked.where(F.col("rank") == 1)
    return chosen.select("task_name", "model_name", F.col(metric).alias("value")).orderBy("value", "task_name")


def rmse_matrix(ranked: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """RMSE per task (rows) and model (columns); NaN where a task lacks the model."""
    pivoted = ranked.groupBy("task_name").pivot("model_name", list(models) if models else None).agg(F.first("rmse"))
    return pivoted.fillna(float("nan"), subset=[c for c in pivoted.columns if c != "task_name"])


def top_importances(importances: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    """The n most important features per task and model; text that is no number is left out."""
    typed = importances.withColumn("importance", F.col("importance").try_cast("double"))
    window = Window.partitionBy("task", "model").orderBy(F.desc("importance"), "feature")
    numbered = typed.where(F.col("importance").isNotNull()).withColumn("rank", F.row_number().over(window))
    return numbered.where(F.col("rank") <= n)


def mean_absolute_values(wide: DataFrame, columns: Sequence[str], n: int = TOP_FEATURES) -> DataFrame:
    """Columns of a wide table of attributions by their mean absolute value, the n largest."""
    means = wide.agg(*[F.avg(F.abs(c)).alias(c) for c in columns])
    long = means.unpivot([], list(columns), "feature", "mean_abs")
    window = Window.orderBy(F.desc_nulls_last("mean_abs"), "feature")  # one row per column of the table
    return long.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def candidate_settings(candidates: DataFrame, settings: dict[str, dict[str, object]]) -> DataFrame:
    """Configured parameters of every model that took part, one row per parameter."""
    texts = {
        model: F.create_map(*[F.lit(str(x)) for pair in given.items() for x in pair])
        for model, given in settings.items()
        if given
    }
    parameters = F.coalesce(*[F.when(F.col("model_name") == m, text) for m, text in texts.items()])
    models = candidates.select("model_name").distinct()
    return models.select("model_name", F.explode(parameters).alias("parameter", "setting"))


# ---------------------------------------------------------------- report tables


def performance_table(metrics: DataFrame, selected: DataFrame) -> DataFrame:
    """Metrics per task and model with the selected ones marked."""
    chosen = selected.select("Task", F.col("Model").alias("__selected"))
    mape = F.when(F.col("mape_is_reliable"), number_text(F.col("mape"), 6)).otherwise(f"{NOT_AVAILABLE} (unreliable)")
    return metrics.join(chosen, "Task", "left").select(
        "Task",
        "Model",
        selected_mark(F.col("Model") == F.col("__selected")).alias("Selected"),
        *[number_text(F.col(m), 6).alias(m.upper()) for m in ("rmse", "mae", "r2")],
        mape.alias("MAPE"),
        F.col("num_rows").alias("Num_Test_Rows"),
    )


def resource_table(ranked: DataFrame) -> DataFrame:
    """Times, memory, CPU and score of each candidate as text."""
    shown = ["training_time", "prediction_time", "memory_usage_mb", "cpu_usage_pct", "composite_score"]
    return ranked.select("task_name", "model_name", "rank", *[number_text(F.col(c)).alias(c) for c in shown])


def selection_table(ranked: DataFrame) -> DataFrame:
    """Score, rank and selection of each candidate."""
    return ranked.select(
        "task_name",
        "model_name",
        number_text(F.col("composite_score")).alias("composite_score"),
        "rank",
        selected_mark(F.col("is_selected")).alias("selected"),
        "selection_profile",
    )


def statistics_table(comparisons: DataFrame) -> DataFrame:
    """Test results as text."""
    return comparisons.select(
        "Task",
        "baseline_model",
        "candidate_model",
        "test_name",
        number_text(F.col("statistic")).alias("statistic"),
        scientific_text(F.col("p_value")).alias("p_value"),
        number_text(F.col("alpha")).alias("alpha"),
        yes_no(F.col("is_significant")).alias("significant"),
        "correction_method",
        "sample_size",
        number_text(F.col("ci_lower")).alias("ci_lower"),
        number_text(F.col("ci_upper")).alias("ci_upper"),
        "notes",
    )


def top_feature_list(importances: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    """The n most important features of each task and model in one text."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "feature")))  # n entries at the most
    return (
        top_importances(importances, n)
        .groupBy("task", "model")
        .agg(F.array_join(F.transform(listed, lambda s: s["feature"]), ", ").alias("top_features"))
    )
