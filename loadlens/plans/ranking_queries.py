"""Ranking and experiment-log queries."""

from __future__ import annotations

from loadlens.operators import ranking as rk
from loadlens.plans.fixtures import candidates, failed_candidates, runs
from loadlens.plans.registry import query, rounded
from loadlens.sources import experiments as ex
from loadlens.sources.shared import shared_path

NORMALISED = [name for _, name in rk.METRICS.values()]
RANKED_COLUMNS = ["task_name", "model_name", "rank", "composite_score", "is_selected"]


def _scaled(column: str, name: str, inverted: bool = False, by: str = "task_name") -> str:
    low, high = f"MIN({column}) OVER (PARTITION BY {by})", f"MAX({column}) OVER (PARTITION BY {by})"
    distance = f"{high} - {column}" if inverted else f"{column} - {low}"
    return f"""CASE WHEN {column} IS NULL THEN 1e0 WHEN {high} - {low} <= 1e-12 THEN 0e0
  ELSE ({distance})/({high} - {low}) END AS {name}"""


def _normalised_sql(source: str, by: str = "task_name") -> str:
    return f"""raw_metrics AS (SELECT * EXCLUDE (memory_usage_mb, cpu_usage_pct),
 memory_usage_mb, cpu_usage_pct, COALESCE(memory_usage_mb, 0e0) AS mem0, COALESCE(cpu_usage_pct, 0e0) AS cpu0 FROM {source}),
scaled AS (SELECT *, {_scaled("rmse", "normalised_rmse", by=by)}, {_scaled("mae", "normalised_mae", by=by)},
 {_scaled("r2", "normalised_r2_penalty", True, by)}, {_scaled("training_time", "normalised_training_time", by=by)},
 {_scaled("prediction_time", "normalised_prediction_time", by=by)}, {_scaled("mem0", "normalised_memory_mb", by=by)},
 {_scaled("cpu0", "normalised_cpu_pct", by=by)} FROM raw_metrics)"""


def _score_sql(profile: str) -> str:
    w = rk.PROFILES[profile]
    return " + ".join(f"{w[m]}::DOUBLE*{name}" for m, (_, name) in rk.METRICS.items())


def _rank_sql(by: str) -> str:
    return f"""CAST(ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY round_even(composite_score/1e-6, 0), rmse NULLS LAST,
 mae NULLS LAST, prediction_time NULLS LAST, model_name) AS INTEGER)"""


NORMALISED_SQL = _normalised_sql("cand")
RANKED_SQL = f"""{NORMALISED_SQL}, scored AS (SELECT *, {_score_sql("balanced")} AS composite_score FROM scaled),
ranked0 AS (SELECT *, {_rank_sql("task_name")} AS rank FROM scored),
ranked AS (SELECT *, rank = 1 AS is_selected FROM ranked0)"""

ROUND_NORMALISED = ", ".join(f"ROUND({c}, 9) AS {c}" for c in NORMALISED)


@query("rk_normalise", f"WITH {NORMALISED_SQL} SELECT task_name, model_name, {ROUND_NORMALISED} FROM scaled", ("cand",))
def rk_normalise(spark, sf_dir):
    made = rk.normalise(candidates(spark, sf_dir)).select("task_name", "model_name", *NORMALISED)
    return rounded(made, *NORMALISED)


@query(
    "rk_composite",
    f"WITH {RANKED_SQL} SELECT task_name, model_name, ROUND(composite_score, 9) AS composite_score FROM ranked",
    ("cand",),
)
def rk_composite(spark, sf_dir):
    made = rk.score(rk.normalise(candidates(spark, sf_dir)))
    return rounded(made.select("task_name", "model_name", "composite_score"), "composite_score")


RANKED_OUT = "task_name, model_name, rank, ROUND(composite_score, 9) AS composite_score, is_selected"


@query("rk_rank", f"WITH {RANKED_SQL} SELECT {RANKED_OUT} FROM ranked", ("cand",))
def rk_rank(spark, sf_dir):
    made = rk.rank_candidates(candidates(spark, sf_dir)).select(*RANKED_COLUMNS)
    return rounded(made, "composite_score")


@query("rk_winner", f"WITH {RANKED_SQL} SELECT {RANKED_OUT} FROM ranked WHERE rank = 1", ("cand",))
def rk_winner(spark, sf_dir):
    made = rk.winners(rk.rank_candidates(candidates(spark, sf_dir))).select(*RANKED_COLUMNS)
    return rounded(made, "composite_score")


SENSITIVITY_SQL = f"""{NORMALISED_SQL}, scored AS (
 {" UNION ALL ".join(f"SELECT *, '{p}' AS selection_profile, {_score_sql(p)} AS composite_score FROM scaled" for p in rk.PROFILES)})"""


@query(
    "rk_profile_sensitivity",
    f"""WITH {SENSITIVITY_SQL}
SELECT task_name, model_name, selection_profile, ROUND(composite_score, 9) AS composite_score,
 {_rank_sql("task_name, selection_profile")} AS rank FROM scored""",
    ("cand",),
)
def rk_profile_sensitivity(spark, sf_dir):
    made = rk.profile_sensitivity(candidates(spark, sf_dir))
    return rounded(made.select("task_name", "model_name", "selection_profile", "composite_score", "rank"), "composite_score")


@query(
    "rk_profile_check",
    """SELECT p AS selection_profile, COUNT(*) AS candidates, 7 AS weight_count, 1e0 AS weight_sum, TRUE AS is_valid
FROM cand CROSS JOIN (SELECT unnest(['accuracy_focused', 'balanced', 'efficiency_focused']) AS p) t GROUP BY p""",
    ("cand",),
)
def rk_profile_check(spark, sf_dir):
    return rk.weight_check(rk.profile_sensitivity(candidates(spark, sf_dir)))


def _diff(column: str, name: str) -> str:
    return f"CASE WHEN w.model_name <> r.model_name THEN ROUND(w.{column} - r.{column}, 9) END AS {name}"


DIFFS = {
    "rmse": "rmse_diff", "mae": "mae_diff", "training_time": "training_time_diff",
    "prediction_time": "prediction_time_diff", "composite_score": "composite_score_diff",
    "memory_usage_mb": "memory_diff_mb", "cpu_usage_pct": "cpu_diff_pct",
}
VS_RMSE_SQL = f"""{RANKED_SQL}, by_rmse AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY task_name
 ORDER BY rmse NULLS LAST, rank) AS rmse_rank FROM ranked)"""


@query(
    "rk_vs_rmse",
    f"""WITH {VS_RMSE_SQL}
SELECT w.task_name, w.model_name AS composite_winner, r.model_name AS rmse_winner,
 w.model_name = r.model_name AS same_model_selected, {", ".join(_diff(c, n) for c, n in DIFFS.items())}
FROM by_rmse w JOIN by_rmse r ON w.task_name = r.task_name AND w.rank = 1 AND r.rmse_rank = 1""",
    ("cand",),
)
def rk_vs_rmse(spark, sf_dir):
    return rounded(rk.composite_vs_rmse(rk.rank_candidates(candidates(spark, sf_dir))), *DIFFS.values())


@query(
    "rk_acc_eff",
    f"""WITH {RANKED_SQL} SELECT task_name, model_name, rank, rmse, mae, training_time, prediction_time,
 memory_usage_mb, cpu_usage_pct, ROUND(composite_score, 9) AS composite_score FROM ranked""",
    ("cand",),
)
def rk_acc_eff(spark, sf_dir):
    return rounded(rk.accuracy_efficiency(rk.rank_candidates(candidates(spark, sf_dir))), "composite_score")


@query(
    "rk_with_failed",
    f"""WITH {RANKED_SQL}
SELECT task_name, model_name, rank, ROUND(composite_score, 9) AS composite_score, FALSE AS failed,
 CAST(NULL AS VARCHAR) AS error FROM ranked
UNION ALL SELECT task_name, model_name, NULL, NULL, TRUE, error FROM failed""",
    ("cand", "failed"),
)
def rk_with_failed(spark, sf_dir):
    both = rk.with_failed(rk.rank_candidates(candidates(spark, sf_dir)), failed_candidates(spark, sf_dir))
    return rounded(both.select("task_name", "model_name", "rank", "composite_score", "failed", "error"), "composite_score")


# ---------------------------------------------------------------- experiment log

RUN_KEYS = ("task_name", "experiment_id")
RUNS_RANKED_SQL = f"""{_normalised_sql("runs", "task_name, experiment_id")},
scored AS (SELECT *, {_score_sql("balanced")} AS composite_score FROM scaled),
ranked0 AS (SELECT *, {_rank_sql("task_name, experiment_id")} AS rank FROM scored),
ranked AS (SELECT *, rank = 1 AS is_selected, MAX(timestamp_max) OVER (PARTITION BY task_name, experiment_id) AS last_ts FROM ranked0)"""


def experiment_log(spark, sf_dir):
    """Every experiment written to the log and read back."""
    path = shared_path(spark, "experiments")
    ranked = rk.rank_candidates(runs(spark, sf_dir), group=RUN_KEYS)
    ex.append_records(ex.experiment_records(ranked), path)
    return ex.load_records(spark, path)


@query(
    "exp_log_flatten",
    f"""WITH {RUNS_RANKED_SQL}
SELECT task_name, experiment_id, MAX(last_ts) AS timestamp, 'balanced' AS selection_profile,
 MAX(CASE WHEN rank = 1 THEN model_name END) AS selected_model, CAST(COUNT(*) AS INTEGER) AS candidate_count,
 STRING_AGG(model_name, ', ' ORDER BY rank) AS candidate_list,
 ROUND(MAX(CASE WHEN rank = 1 THEN composite_score END), 6) AS best_score
FROM ranked GROUP BY task_name, experiment_id""",
    ("runs",),
)
def exp_log_flatten(spark, sf_dir):
    return ex.flatten_records(experiment_log(spark, sf_dir))


@query(
    "exp_latest_per_task",
    """WITH e AS (SELECT task_name, experiment_id, MAX(timestamp_max) AS last_ts FROM runs GROUP BY 1, 2)
SELECT task_name, experiment_id, last_ts AS timestamp FROM e
QUALIFY ROW_NUMBER() OVER (PARTITION BY task_name ORDER BY last_ts DESC, experiment_id DESC) = 1""",
    ("runs",),
)
def exp_latest_per_task(spark, sf_dir):
    return ex.latest_per_task(experiment_log(spark, sf_dir)).select("task_name", "experiment_id", "timestamp")


@query(
    "exp_keep_newest",
    """WITH e AS (SELECT task_name, experiment_id, MAX(timestamp_max) AS last_ts FROM runs GROUP BY 1, 2)
SELECT task_name, experiment_id, last_ts AS timestamp FROM e
QUALIFY ROW_NUMBER() OVER (PARTITION BY task_name ORDER BY last_ts DESC, experiment_id DESC) <= 5""",
    ("runs",),
)
def exp_keep_newest(spark, sf_dir):
    return ex.keep_newest(experiment_log(spark, sf_dir), 5).select("task_name", "experiment_id", "timestamp")


@query(
    "exp_candidates_explode",
    f"""WITH {RUNS_RANKED_SQL}
SELECT task_name, experiment_id, last_ts AS timestamp, 'balanced' AS selection_profile, model_name, rmse, mae, r2,
 training_time, prediction_time, memory_usage_mb, cpu_usage_pct, {ROUND_NORMALISED},
 ROUND(composite_score, 9) AS composite_score, rank, is_selected FROM ranked""",
    ("runs",),
)
def exp_candidates_explode(spark, sf_dir):
    return rounded(ex.explode_candidates(experiment_log(spark, sf_dir)), *NORMALISED, "composite_score")
