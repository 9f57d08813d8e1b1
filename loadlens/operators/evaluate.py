"""Regression metrics and paired tests between predictors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadlens.functions import stats
from loadlens.operators.ordered import order_rows, running_total
from loadlens.sources.shared import stage

# Fixed values
MAPE_EPSILON = 1e-6
MAPE_NEAR_ZERO_SHARE = 0.05
ALPHA = 0.05
MIN_PAIRS = 30

SERIES = ("Task", "Model")
PAIR = ("Task", "baseline_model", "candidate_model")


def regression_metrics(
    predictions: DataFrame,
    keys: Sequence[str] = SERIES,
    *,
    actual: str = "Actual",
    predicted: str = "Predicted",
    epsilon: float = MAPE_EPSILON,
) -> DataFrame:
    """RMSE, MAE, R2 and MAPE (a fraction) of each predictor in one aggregation.

    Only rows with both a target and a prediction count. R2 is null for a constant
    target. MAPE divides by ``epsilon`` at least and is reliable while under 5 % of the
    targets lie below it. Without rows and keys all is null and no row is counted.
    """
    e = F.col(actual) - F.col(predicted)
    a = F.when(e.isNotNull(), F.col(actual))
    near_zero = F.try_divide(F.count_if(F.abs(a) < epsilon), F.count(e))
    return predictions.groupBy(*keys).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(a))).alias("r2"),
        F.avg(F.abs(e) / F.greatest(F.abs(a), F.lit(epsilon))).alias("mape"),
        (near_zero < MAPE_NEAR_ZERO_SHARE).alias("mape_is_reliable"),
        F.count(e).alias("num_rows"),
    )


def with_expected(metrics: DataFrame, expected: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Metrics of all ``expected`` predictors: zeros and unreliable where there are no rows."""
    joined = expected.select(*keys).join(metrics, list(keys), "left")
    filled = joined.fillna({"rmse": 0.0, "mae": 0.0, "mape": 0.0, "mape_is_reliable": False})
    empty = F.col("num_rows").isNull()
    return filled.withColumns(
        {"r2": F.when(empty, 0.0).otherwise(F.col("r2")), "num_rows": F.coalesce("num_rows", F.lit(0))}
    )


def paired_errors(
    predictions: DataFrame,
    baseline: str | DataFrame,
    *,
    on: Sequence[str] = ("Timestamp",),
    actual: str = "Actual",
    predicted: str = "Predicted",
) -> DataFrame:
    """Absolute errors of every other predictor beside those of the baseline, row by row.

    ``baseline`` names one model for all tasks or is a table of ``Task`` and ``Model``.
    """
    if isinstance(baseline, str):
        tagged = predictions.withColumn("baseline_model", F.lit(baseline))
    else:
        # one row per task, staged: small, it is broadcast and the predictions are not shuffled by task
        chosen = stage(baseline.select("Task", F.col("Model").alias("baseline_model")), "baseline")
        tagged = predictions.join(chosen, "Task")
    is_base = F.col("Model") == F.col("baseline_model")
    base = tagged.where(is_base).select(
        "Task", *on, F.col(actual).alias("__actual"), F.col(predicted).alias("__base"), "baseline_model"
    )
    rest = tagged.where(~is_base).select(
        "Task", *on, F.col("Model").alias("candidate_model"), F.col(predicted).alias("__candidate")
    )
    return base.join(rest, ["Task", *on]).select(
        "Task",
        *on,
        "baseline_model",
        "candidate_model",
        F.abs(F.col("__actual") - F.col("__base")).alias("err_base"),
        F.abs(F.col("__actual") - F.col("__candidate")).alias("err_cand"),
    )


def sample_pairs(errors: DataFrame, fraction: float, on: Sequence[str] = ("Timestamp",)) -> DataFrame:
    """About ``fraction`` of the pairs, by a digest of their row key; the tests here need none.

    All models of a row are in or out together, and the same rows on every run.
    """
    if not 0 <= fraction <= 1:
        raise ValueError(f"fraction must lie between 0 and 1, got {fraction}")
    digest = F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in on])), 1, 8)
    below = f"{min(int(fraction * 2**32), 2**32 - 1):08x}"
    return errors if fraction == 1 else errors.where(digest < below)


def paired_t(errors: DataFrame) -> DataFrame:
    """Mean difference (candidate - baseline), its standard error and the paired t of each pair."""
    d = F.col("err_cand") - F.col("err_base")
    sem = F.stddev_samp(d) / F.sqrt(F.count("*"))
    return errors.groupBy(*PAIR).agg(
        F.count("*").alias("sample_size"),
        F.avg(d).alias("mean_diff"),
        sem.alias("sem_diff"),
        F.try_divide(-F.avg(d), sem).alias("t"),
    )


def wilcoxon(errors: DataFrame) -> DataFrame:
    """Signed-rank sums of baseline - candidate errors with half of the zeros on each side.

    Equal sizes are counted first. Ranks follow from a running total over the distinct
    sizes, which is spread over slices and not done per pair in one task.
    """
    d = F.col("err_base") - F.col("err_cand")
    sizes = errors.groupBy(*PAIR, F.abs(d).alias("size")).agg(
        F.count("*").alias("n"), F.count_if(d > 0).alias("above"), F.count_if(d < 0).alias("below")
    )
    ordered = running_total(order_rows(sizes, ["size"], PAIR), {"through": F.col("n")})
    n = F.col("n").cast("double")
    average_rank = F.col("through") - (n - 1) / 2
    zeros = F.when(F.col("size") == 0, n / 2).otherwise(0.0)
    sums = ordered.df.groupBy(*PAIR).agg(
        F.sum("n").alias("sample_size"),
        F.sum(average_rank * (F.col("above") + zeros)).alias("r_plus"),
        F.sum(average_rank * (F.col("below") + zeros)).alias("r_minus"),
        F.sum(n * (n * n - 1)).alias("tie_term"),
        F.bool_or(F.col("size") == 0).alias("has_zeros"),
    )
    rows = F.col("sample_size").cast("double")
    variance = (rows * (rows + 1) * (2 * rows + 1) - F.col("tie_term") / 2) / 24
    statistic = F.least("r_plus", "r_minus")
    return sums.withColumns(
        {
            "statistic": statistic,
            "z": F.try_divide(statistic - rows * (rows + 1) / 4, F.sqrt(variance)),
        }
    )


def wilcoxon_p_value(tested: DataFrame, method: str = "normal") -> DataFrame:
    """Add ``p_value``, by the normal limit or, ``exact``, by counting rank sums.

    ``exact`` supposes no ties and no zeros and raises beyond 1,000 pairs.
    """
    if method not in ("normal", "exact"):
        raise ValueError(f"unknown method {method}")
    if method == "exact":
        p = stats.rank_sum_p_value(F.col("statistic"), F.col("sample_size"))
    else:
        p = stats.normal_p_value(F.col("z"))
    return tested.withColumn("p_value", F.coalesce(p, F.lit(1.0)))


def with_adjusted_alpha(pairs: DataFrame, alpha: float = ALPHA, correction: str = "bonferroni") -> DataFrame:
    """Add the significance level of each pair, divided by the comparisons of its task."""
    comparisons = F.count("*").over(Window.partitionBy("Task"))
    if correction == "none":
        comparisons = F.lit(1)
    elif correction != "bonferroni":
        raise ValueError(f"unknown correction {correction}")
    corrected = F.when(comparisons > 1, correction).otherwise("none")
    return pairs.withColumns({"alpha": alpha / comparisons, "correction_method": corrected})


def compare_predictors(
    predictions: DataFrame,
    baseline: str | DataFrame,
    *,
    on: Sequence[str] = ("Timestamp",),
    test: str = "wilcoxon",
    alpha: float = ALPHA,
    correction: str = "bonferroni",
    method: str = "normal",
    min_pairs: int = MIN_PAIRS,
    **columns: str,
) -> DataFrame:
    """Test the baseline against every other predictor of its task.

    With fewer than ``min_pairs`` rows there is no test: p is 1 and a note says so.
    ``method`` is that of ``wilcoxon_p_value``.
    """
    if test not in ("wilcoxon", "paired_t"):
        raise ValueError(f"unknown test {test}")
    errors = paired_errors(predictions, baseline, on=on, **columns).select(*PAIR, "err_base", "err_cand")
    if test == "wilcoxon":
        errors = stage(errors, "errors")  # read for the ranks and for the mean differences
    means = paired_t(errors)
    if test == "wilcoxon":
        ranked = wilcoxon_p_value(wilcoxon(errors), method).select(*PAIR, "statistic", "p_value")
        tested = means.join(ranked, list(PAIR))
    else:
        p = stats.t_p_value(F.col("t"), F.col("sample_size") - 1)
        tested = means.withColumns({"statistic": F.col("t"), "p_value": p})
    enough = F.col("sample_size") >= min_pairs
    adjusted = with_adjusted_alpha(tested, alpha, correction)
    reach = F.when(
        F.col("sem_diff") > 0,
        F.col("sem_diff") * stats.t_upper_quantile(F.col("alpha") / 2, F.col("sample_size") - 1),
    ).otherwise(0.0)
    note = F.format_string("not tested: %d pairs, %d are needed", F.col("sample_size"), F.lit(min_pairs))
    return adjusted.withColumn("__reach", reach).select(
        *PAIR,
        F.lit(test).alias("test_name"),
        F.when(enough, F.col("statistic")).otherwise(0.0).alias("statistic"),
        F.when(enough, F.col("p_value")).otherwise(1.0).alias("p_value"),
        F.when(enough, F.col("alpha")).otherwise(alpha).alias("alpha"),
        (enough & F.coalesce(F.col("p_value") < F.col("alpha"), F.lit(False))).alias("is_significant"),
        F.when(enough, F.col("correction_method")).otherwise("none").alias("correction_method"),
        "sample_size",
        F.when(enough, F.col("mean_diff") - F.col("__reach")).alias("ci_lower"),
        F.when(enough, F.col("mean_diff") + F.col("__reach")).alias("ci_upper"),
        F.when(enough, "").otherwise(note).alias("notes"),
    )


def best_by_rmse(metrics: DataFrame) -> DataFrame:
    """Task and model with the lowest RMSE."""
    best = F.min_by("Model", F.struct("rmse", "Model")).alias("Model")
    return metrics.groupBy("Task").agg(best)


def cross_task_summary(metrics: DataFrame, versus_rmse: DataFrame) -> DataFrame:
    """One row per task: selected model, its metrics and its distance to the RMSE winner, by RMSE."""
    chosen = versus_rmse.select(
        F.col("task_name"),
        F.col("composite_winner").alias("selected_model"),
        F.col("same_model_selected").alias("composite_vs_rmse_same"),
        F.coalesce("composite_score_diff", F.lit(0.0)).alias("composite_score_diff"),
        F.coalesce("rmse_diff", F.lit(0.0)).alias("rmse_penalty_vs_baseline"),
    )
    found = metrics.select(
        F.col("Task").alias("task_name"), F.col("Model").alias("selected_model"), "rmse", "mae", "r2", "mape"
    )
    joined = chosen.join(found, ["task_name", "selected_model"], "left")
    return joined.orderBy(F.asc_nulls_last("rmse"), "task_name")
