"""Composite ranking of candidate models.

A candidate table has one row per task, experiment and model: groups are as large
as the list of configured models, so windows per group are small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values
PROFILES = {
    "accuracy_focused": {
        "rmse": 0.40, "mae": 0.20, "r2_penalty": 0.20, "training_time": 0.08,
        "prediction_time": 0.06, "memory_usage": 0.04, "cpu_usage": 0.02,
    },
    "balanced": {
        "rmse": 0.30, "mae": 0.15, "r2_penalty": 0.15, "training_time": 0.15,
        "prediction_time": 0.10, "memory_usage": 0.10, "cpu_usage": 0.05,
    },
    "efficiency_focused": {
        "rmse": 0.15, "mae": 0.10, "r2_penalty": 0.10, "training_time": 0.25,
        "prediction_time": 0.20, "memory_usage": 0.15, "cpu_usage": 0.05,
    },
}
ACTIVE_PROFILE = "balanced"
TIE_TOLERANCE = 1e-6
WEIGHT_TOLERANCE = 1e-4
# weight -> (raw column, normalised column)
METRICS = {
    "rmse": ("rmse", "normalised_rmse"),
    "mae": ("mae", "normalised_mae"),
    "r2_penalty": ("r2", "normalised_r2_penalty"),
    "training_time": ("training_time", "normalised_training_time"),
    "prediction_time": ("prediction_time", "normalised_prediction_time"),
    "memory_usage": ("memory_usage_mb", "normalised_memory_mb"),
    "cpu_usage": ("cpu_usage_pct", "normalised_cpu_pct"),
}
HIGHER_IS_BETTER = {"r2_penalty"}
OPTIONAL_METRICS = {"memory_usage", "cpu_usage"}
EQUAL_TOLERANCE = 1e-12

GROUP = ("task_name",)


def check_weights(weights: dict[str, float]) -> None:
    """Raise unless every metric has a weight and the weights sum to 1."""
    if missing := [m for m in METRICS if m not in weights]:
        raise ValueError(f"missing weights: {', '.join(missing)}")
    if abs(sum(weights.values()) - 1.0) > WEIGHT_TOLERANCE:
        raise ValueError(f"weights sum to {sum(weights.values())}, not 1")


def _usable(metric: str) -> Column:
    """The raw metric with NaN as null, and 0 for an optional metric that was not taken."""
    raw = F.col(METRICS[metric][0])
    if metric in OPTIONAL_METRICS:
        raw = F.coalesce(raw, F.lit(0.0))
    return F.when(~F.isnan(raw), raw)


def normalise(candidates: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Scale each metric to 0 (best) .. 1 (worst) within its group.

    NaN counts as worst; where all values agree they are all 0.
    """
    window = Window.partitionBy(*group)
    made = {}
    for metric, (_, name) in METRICS.items():
        value = _usable(metric)
        low, high = F.min(value).over(window), F.max(value).over(window)
        closeness = F.greatest(F.greatest(F.abs(low), F.abs(high)) * EQUAL_TOLERANCE, F.lit(EQUAL_TOLERANCE))
        distance = high - value if metric in HIGHER_IS_BETTER else value - low
        made[name] = (
            F.when(value.isNull(), 1.0)
            .when(high - low <= closeness, 0.0)
            .otherwise(F.try_divide(distance, high - low))
        )
    return candidates.withColumns(made)


def _weighted(weights: dict[str, Column]) -> Column:
    score = F.lit(0.0)
    for metric, (_, name) in METRICS.items():
        score = score + weights[metric] * F.col(name)
    return score


def _weight_map(weights: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])


def score(normalised: DataFrame, profile: str = ACTIVE_PROFILE, weights: dict[str, float] | None = None) -> DataFrame:
    """Add the weighted composite score of one profile; lower is better."""
    weights = weights or PROFILES[profile]
    check_weights(weights)
    return normalised.withColumns(
        {
            "selection_profile": F.lit(profile),
            "composite_score": _weighted({m: F.lit(w) for m, w in weights.items()}),
            "profile_weights": _weight_map(weights),
        }
    )


def score_all_profiles(normalised: DataFrame, profiles: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """One row per candidate and profile with the composite score of that profile."""
    profiles = profiles or PROFILES
    for weights in profiles.values():
        check_weights(weights)
    options = [
        F.struct(F.lit(name).alias("selection_profile"), _weight_map(weights).alias("profile_weights"))
        for name, weights in profiles.items()
    ]
    spread = normalised.select("*", F.explode(F.array(*options)).alias("__profile")).select("*", "__profile.*")
    weights = {m: F.col("profile_weights")[m] for m in METRICS}
    return spread.drop("__profile").withColumn("composite_score", _weighted(weights))


def _last_if_nan(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(float("nan"))).asc()  # NaN sorts after every number


def rank(
    scored: DataFrame, group: Sequence[str] = GROUP, tolerance: float = TIE_TOLERANCE
) -> DataFrame:
    """Add ``rank`` from 1 and ``is_selected``.

    Scores in one ``tolerance`` bucket tie; lower RMSE, MAE, prediction time and then
    the model name decide.
    """
    bucket = F.bround(F.col("composite_score") / tolerance) if tolerance > 0 else F.col("composite_score")
    window = Window.partitionBy(*group).orderBy(
        F.coalesce(bucket, F.lit(float("nan"))).asc(),
        _last_if_nan("rmse"),
        _last_if_nan("mae"),
        _last_if_nan("prediction_time"),
        "model_name",
    )
    return scored.withColumn("rank", F.row_number().over(window)).withColumn("is_selected", F.col("rank") == 1)


def rank_candidates(
    candidates: DataFrame,
    profile: str = ACTIVE_PROFILE,
    *,
    weights: dict[str, float] | None = None,
    group: Sequence[str] = GROUP,
    tolerance: float = TIE_TOLERANCE,
) -> DataFrame:
    """Normalise, score and rank."""
    return rank(score(normalise(candidates, group), profile, weights), group, tolerance)


def winners(ranked: DataFrame) -> DataFrame:
    """The selected candidates."""
    return ranked.where(F.col("rank") == 1)


def profile_sensitivity(candidates: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Ranking under every profile at once."""
    return rank(score_all_profiles(normalise(candidates, group)), (*group, "selection_profile"))


def weight_check(ranked: DataFrame) -> DataFrame:
    """Weights stored with the candidates: their number, sum and whether they are valid."""
    values = F.map_values("profile_weights")
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    named = F.size(F.array_intersect(F.map_keys("profile_weights"), F.array(*[F.lit(m) for m in METRICS])))
    return ranked.groupBy("selection_profile").agg(
        F.count("*").alias("candidates"),
        F.min(named).alias("weight_count"),
        F.round(F.min(total), 6).alias("weight_sum"),
        F.bool_and((named == len(METRICS)) & (F.abs(total - 1) <= WEIGHT_TOLERANCE)).alias("is_valid"),
    )


def composite_vs_rmse(ranked: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    """Composite winner against the winner by RMSE alone, with their differences.

    Differences are winner minus RMSE winner, null where both are one model or a side is null.
    """
    metrics = ["rmse", "mae", "training_time", "prediction_time", "composite_score", "memory_usage_mb", "cpu_usage_pct"]
    row = F.struct("model_name", *metrics)
    by_rmse = F.struct(F.coalesce("rmse", F.lit(float("nan"))), F.col("rank"))
    best = ranked.groupBy(*group).agg(F.min_by(row, "rank").alias("w"), F.min_by(row, by_rmse).alias("r"))
    same = F.col("w.model_name") == F.col("r.model_name")
    names = {"memory_usage_mb": "memory_diff_mb", "cpu_usage_pct": "cpu_diff_pct"}
    return best.select(
        *group,
        F.col("w.model_name").alias("composite_winner"),
        F.col("r.model_name").alias("rmse_winner"),
        same.alias("same_model_selected"),
        *[F.when(~same, F.col(f"w.{m}") - F.col(f"r.{m}")).alias(names.get(m, f"{m}_diff")) for m in metrics],
    )


ACCURACY_EFFICIENCY = [
    "task_name", "model_name", "rank", "rmse", "mae", "training_time", "prediction_time",
    "memory_usage_mb", "cpu_usage_pct", "composite_score",
]


def accuracy_efficiency(ranked: DataFrame) -> DataFrame:
    """Accuracy and cost of each candidate."""
    return ranked.select(*ACCURACY_EFFICIENCY)


def with_failed(ranked: DataFrame, failed: DataFrame) -> DataFrame:
    """Ranked candidates and, unranked, those that failed with their error."""
    good = ranked.withColumns({"failed": F.lit(False), "error": F.lit(None).cast("string")})
    bad = failed.withColumn("failed", F.lit(True))
    return good.unionByName(bad, allowMissingColumns=True)
