"""Metric, paired-test, chart-data and report-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.functions.formatting import number_text
from loadlens.operators import chartdata as ch
from loadlens.operators import evaluate as ev
from loadlens.operators import ranking as rk
from loadlens.plans.fixtures import METER_COLUMNS, candidates, meter, predictions, table
from loadlens.plans.ranking_queries import RANKED_SQL, _diff, _rank_sql, _scaled
from loadlens.plans.registry import query, rounded

KEYS = ["obs_ts", "event_id"]

METRICS_SQL = """metrics AS (SELECT Task, Model, SQRT(AVG((Actual-Predicted)*(Actual-Predicted))) AS rmse,
 AVG(ABS(Actual-Predicted)) AS mae,
 1 - AVG((Actual-Predicted)*(Actual-Predicted))/NULLIF(VAR_POP(Actual), 0) AS r2,
 AVG(ABS(Actual-Predicted)/GREATEST(ABS(Actual), 1e-6)) AS mape,
 COUNT(*) FILTER (WHERE ABS(Actual) < 1e-6)/COUNT(*) < 0.05 AS mape_is_reliable, COUNT(*) AS num_rows
 FROM pred GROUP BY Task, Model)"""


@query(
    "ev_regression_metrics",
    f"""WITH {METRICS_SQL} SELECT Task, Model, ROUND(rmse, 6) AS rmse, ROUND(mae, 6) AS mae, ROUND(r2, 6) AS r2,
 ROUND(mape, 6) AS mape, mape_is_reliable, num_rows FROM metrics""",
    ("pred",),
)
def ev_regression_metrics(spark, sf_dir):
    made = ev.regression_metrics(predictions(spark, sf_dir))
    return rounded(made, "rmse", "mae", "r2", "mape", digits=6)


@query(
    "ev_expected_metrics",
    f"""WITH {METRICS_SQL}, expected AS (SELECT * FROM (SELECT DISTINCT Task FROM pred) t
 CROSS JOIN (SELECT unnest(['m_bias', 'm_noise', 'm_mean', 'm_absent']) AS Model) m)
SELECT Task, Model, ROUND(COALESCE(rmse, 0e0), 6) AS rmse, ROUND(COALESCE(mae, 0e0), 6) AS mae,
 ROUND(COALESCE(r2, 0e0), 6) AS r2, ROUND(COALESCE(mape, 0e0), 6) AS mape,
 COALESCE(mape_is_reliable, FALSE) AS mape_is_reliable, COALESCE(num_rows, 0) AS num_rows
FROM expected LEFT JOIN metrics USING (Task, Model)""",
    ("pred",),
)
def ev_expected_metrics(spark, sf_dir):
    made = predictions(spark, sf_dir)
    names = F.explode(F.array(*[F.lit(m) for m in ("m_bias", "m_noise", "m_mean", "m_absent")])).alias("Model")
    expected = made.select("Task").distinct().select("Task", names)
    metrics = ev.with_expected(ev.regression_metrics(made), expected)
    return rounded(metrics, "rmse", "mae", "r2", "mape", digits=6)


ERRORS_SQL = """errors AS (SELECT b.Task, b.obs_ts, b.event_id, b.Model AS baseline_model, c.Model AS candidate_model,
 ABS(b.Actual - b.Predicted) AS err_base, ABS(b.Actual - c.Predicted) AS err_cand
 FROM pred b JOIN pred c ON b.Task = c.Task AND b.obs_ts = c.obs_ts AND b.event_id = c.event_id
 WHERE b.Model = 'm_bias' AND c.Model <> 'm_bias')"""


def errors(spark, sf_dir):
    return ev.paired_errors(predictions(spark, sf_dir), "m_bias", on=KEYS)


@query("ev_paired_errors", f"WITH {ERRORS_SQL} SELECT * FROM errors", ("pred",))
def ev_paired_errors(spark, sf_dir):
    return errors(spark, sf_dir)


@query(
    "ev_sample_pairs",
    f"""WITH {ERRORS_SQL} SELECT * FROM errors
WHERE substring(md5(concat_ws('|', strftime(obs_ts, '%Y-%m-%d %H:%M:%S'), CAST(event_id AS VARCHAR))), 1, 8) < '40000000'""",
    ("pred",),
)
def ev_sample_pairs(spark, sf_dir):
    # whole seconds are written alike by both engines
    keyed = errors(spark, sf_dir).withColumn("__second", F.date_format("obs_ts", "yyyy-MM-dd HH:mm:ss"))
    return ev.sample_pairs(keyed, 0.25, ["__second", "event_id"]).drop("__second")


T_SQL = """t AS (SELECT Task, baseline_model, candidate_model, COUNT(*) AS sample_size,
 AVG(err_cand - err_base) AS mean_diff, STDDEV_SAMP(err_cand - err_base)/SQRT(COUNT(*)) AS sem_diff
 FROM errors GROUP BY ALL)"""


@query(
    "ev_paired_t",
    f"""WITH {ERRORS_SQL}, {T_SQL} SELECT Task, baseline_model, candidate_model, sample_size,
 ROUND(-mean_diff/sem_diff, 6) AS t FROM t""",
    ("pred",),
)
def ev_paired_t(spark, sf_dir):
    return rounded(ev.paired_t(errors(spark, sf_dir)).drop("mean_diff", "sem_diff"), "t", digits=6)


@query(
    "ev_mean_diff_ci",
    f"""WITH {ERRORS_SQL}, {T_SQL} SELECT Task, baseline_model, candidate_model, sample_size,
 ROUND(mean_diff, 6) AS mean_diff, ROUND(sem_diff, 6) AS sem_diff FROM t""",
    ("pred",),
)
def ev_mean_diff_ci(spark, sf_dir):
    return rounded(ev.paired_t(errors(spark, sf_dir)).drop("t"), "mean_diff", "sem_diff", digits=6)


WILCOXON_SQL = """d AS (SELECT Task, baseline_model, candidate_model, err_base - err_cand AS d FROM errors),
ranks AS (SELECT *, RANK() OVER (PARTITION BY Task, baseline_model, candidate_model ORDER BY ABS(d)) AS r,
 COUNT(*) OVER (PARTITION BY Task, baseline_model, candidate_model, ABS(d)) AS c FROM d),
sums AS (SELECT Task, baseline_model, candidate_model, COUNT(*) AS sample_size,
 SUM(CASE WHEN d > 0 THEN r + (c - 1)/2e0 WHEN d = 0 THEN (r + (c - 1)/2e0)/2e0 ELSE 0e0 END) AS r_plus,
 SUM(CASE WHEN d < 0 THEN r + (c - 1)/2e0 WHEN d = 0 THEN (r + (c - 1)/2e0)/2e0 ELSE 0e0 END) AS r_minus,
 SUM(CAST(c AS DOUBLE)*c - 1) AS tie_term FROM ranks GROUP BY ALL),
w AS (SELECT *, LEAST(r_plus, r_minus) AS statistic,
 (LEAST(r_plus, r_minus) - sample_size*(sample_size + 1e0)/4)
 / SQRT((sample_size*(sample_size + 1e0)*(2e0*sample_size + 1) - tie_term/2)/24) AS z FROM sums)"""


@query(
    "ev_wilcoxon",
    f"""WITH {ERRORS_SQL}, {WILCOXON_SQL} SELECT Task, baseline_model, candidate_model, sample_size,
 r_plus, r_minus, statistic, ROUND(z, 6) AS z FROM w""",
    ("pred",),
)
def ev_wilcoxon(spark, sf_dir):
    made = ev.wilcoxon(errors(spark, sf_dir)).drop("tie_term", "has_zeros")
    return rounded(made, "z", digits=6)


@query(
    "ev_bonferroni",
    f"""WITH {ERRORS_SQL}, {T_SQL} SELECT Task, baseline_model, candidate_model, sample_size,
 0.05::DOUBLE/COUNT(*) OVER (PARTITION BY Task) AS alpha,
 CASE WHEN COUNT(*) OVER (PARTITION BY Task) > 1 THEN 'bonferroni' ELSE 'none' END AS correction_method FROM t""",
    ("pred",),
)
def ev_bonferroni(spark, sf_dir):
    pairs = ev.paired_t(errors(spark, sf_dir)).drop("mean_diff", "sem_diff", "t")
    return ev.with_adjusted_alpha(pairs)


SELECTED_SQL = f"""{METRICS_SQL}, best AS (SELECT Task, Model FROM metrics
 QUALIFY ROW_NUMBER() OVER (PARTITION BY Task ORDER BY rmse, Model) = 1),
errors AS (SELECT b.Task, b.Model AS baseline_model, c.Model AS candidate_model,
 ABS(b.Actual - b.Predicted) AS err_base, ABS(b.Actual - c.Predicted) AS err_cand
 FROM pred b JOIN best s ON b.Task = s.Task AND b.Model = s.Model
 JOIN pred c ON b.Task = c.Task AND b.obs_ts = c.obs_ts AND b.event_id = c.event_id AND c.Model <> b.Model)"""


def comparisons(spark, sf_dir, test="wilcoxon"):
    """The best predictor of each task by RMSE against all others."""
    made = predictions(spark, sf_dir)
    best = ev.best_by_rmse(ev.regression_metrics(made))
    return ev.compare_predictors(made, best, on=KEYS, test=test)


@query(
    "ev_all_comparisons",
    f"""WITH {SELECTED_SQL}, {WILCOXON_SQL}, {T_SQL}
SELECT Task, baseline_model, candidate_model, 'wilcoxon' AS test_name, statistic, t.sample_size,
 0.05::DOUBLE/COUNT(*) OVER (PARTITION BY Task) AS alpha, ROUND(mean_diff, 6) AS mean_diff
FROM w JOIN t USING (Task, baseline_model, candidate_model)""",
    ("pred",),
)
def ev_all_comparisons(spark, sf_dir):
    tested = comparisons(spark, sf_dir)
    middle = (F.col("ci_lower") + F.col("ci_upper")) / 2
    named = ["Task", "baseline_model", "candidate_model", "test_name", "statistic", "sample_size", "alpha"]
    return rounded(tested.select(*named, middle.alias("mean_diff")), "mean_diff", digits=6)


# SQL has no error function and no Student's t: the oracles integrate the densities with Simpson's
# rule over 4000 steps, the normal over 12 units from |z| on, the t over its angle.
def _simpson(density: str) -> str:
    weight = "CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"SUM({weight}*({density}))"


TESTED = "Task, baseline_model, candidate_model, test_name, ROUND(p_value, 8) AS p_value, p_value < alpha AS is_significant"


@query(
    "ev_wilcoxon_p",
    f"""WITH {SELECTED_SQL}, {WILCOXON_SQL},
areas AS (SELECT Task, baseline_model, candidate_model, z,
 {_simpson("EXP(-0.5e0*(ABS(z) + i*0.003e0)*(ABS(z) + i*0.003e0))")} * 0.003e0/3*2/SQRT(2*pi()) AS p_value
 FROM w, range(4001) r(i) GROUP BY ALL),
tested AS (SELECT *, 'wilcoxon' AS test_name, 0.05::DOUBLE/COUNT(*) OVER (PARTITION BY Task) AS alpha FROM areas)
SELECT {TESTED} FROM tested""",
    ("pred",),
)
def ev_wilcoxon_p(spark, sf_dir):
    tested = comparisons(spark, sf_dir)
    named = ["Task", "baseline_model", "candidate_model", "test_name", "p_value", "is_significant"]
    return rounded(tested.select(*named), "p_value", digits=8)


@query(
    "ev_paired_t_p",
    f"""WITH {SELECTED_SQL}, {T_SQL},
angles AS (SELECT *, sample_size - 1e0 AS df, ATAN(ABS(mean_diff/sem_diff)/SQRT(sample_size - 1e0)) AS a FROM t),
areas AS (SELECT Task, baseline_model, candidate_model, df, a,
 {_simpson("POW(COS(LEAST(a + i*(pi()/2 - a)/4000, pi()/2)), df - 1)")} * (pi()/2 - a)/4000/3
 * 2*EXP(lgamma((df + 1)/2) - lgamma(df/2))/SQRT(pi()) AS p_value
 FROM angles, range(4001) r(i) GROUP BY Task, baseline_model, candidate_model, df, a),
tested AS (SELECT *, 'paired_t' AS test_name, 0.05::DOUBLE/COUNT(*) OVER (PARTITION BY Task) AS alpha FROM areas)
SELECT {TESTED} FROM tested""",
    ("pred",),
)
def ev_paired_t_p(spark, sf_dir):
    tested = comparisons(spark, sf_dir, "paired_t")
    named = ["Task", "baseline_model", "candidate_model", "test_name", "p_value", "is_significant"]
    return rounded(tested.select(*named), "p_value", digits=8)


# the two comparisons of a task leave a tail of 0.0125 on each side; the t quantile follows from
# the normal one (z) by the expansion in 1/df up to its fourth power
T_QUANTILE_SQL = """(z + (POW(z, 3) + z)/(4*df) + (5*POW(z, 5) + 16*POW(z, 3) + 3*z)/(96*df*df)
 + (3*POW(z, 7) + 19*POW(z, 5) + 17*POW(z, 3) - 15*z)/(384*POW(df, 3))
 + (79*POW(z, 9) + 776*POW(z, 7) + 1482*POW(z, 5) - 1920*POW(z, 3) - 945*z)/(92160*POW(df, 4)))"""


@query(
    "ev_confidence_interval",
    f"""WITH {SELECTED_SQL}, {T_SQL}, q AS (SELECT *, 2.241402727604947e0 AS z, sample_size - 1e0 AS df FROM t)
SELECT Task, baseline_model, candidate_model, ROUND(mean_diff - sem_diff*{T_QUANTILE_SQL}, 6) AS ci_lower,
 ROUND(mean_diff + sem_diff*{T_QUANTILE_SQL}, 6) AS ci_upper FROM q""",
    ("pred",),
)
def ev_confidence_interval(spark, sf_dir):
    tested = comparisons(spark, sf_dir, "paired_t")
    named = ["Task", "baseline_model", "candidate_model", "ci_lower", "ci_upper"]
    return rounded(tested.select(*named), "ci_lower", "ci_upper", digits=6)


def metric_candidates(metrics):
    """Metrics as candidates that differ in accuracy only."""
    same = [F.lit(0.0).alias(c) for c in ("training_time", "prediction_time", "memory_usage_mb", "cpu_usage_pct")]
    return metrics.select(F.col("Task").alias("task_name"), F.col("Model").alias("model_name"), "rmse", "mae", "r2", *same)


CROSS_SQL = f"""{METRICS_SQL}, named AS (SELECT Task AS task_name, Model AS model_name, rmse, mae, r2, mape,
 0e0 AS training_time, 0e0 AS prediction_time, 0e0 AS memory_usage_mb, 0e0 AS cpu_usage_pct FROM metrics),
scaled AS (SELECT *, {_scaled("rmse", "nr")}, {_scaled("mae", "nm")}, {_scaled("r2", "np", True)} FROM named),
scored AS (SELECT *, 0.30::DOUBLE*nr + 0.15::DOUBLE*nm + 0.15::DOUBLE*np AS composite_score FROM scaled),
ranked AS (SELECT *, {_rank_sql("task_name")} AS rank FROM scored),
by_rmse AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY task_name ORDER BY rmse, rank) AS rmse_rank FROM ranked)"""


@query(
    "ev_cross_task",
    f"""WITH {CROSS_SQL} SELECT w.task_name, w.model_name AS selected_model, ROUND(w.rmse, 6) AS rmse,
 ROUND(w.mae, 6) AS mae, ROUND(w.r2, 6) AS r2, ROUND(w.mape, 6) AS mape,
 w.model_name = r.model_name AS composite_vs_rmse_same,
 COALESCE({_diff("composite_score", "x").replace(" AS x", "")}, 0e0) AS composite_score_diff,
 COALESCE({_diff("rmse", "x").replace(" AS x", "")}, 0e0) AS rmse_penalty_vs_baseline
FROM by_rmse w JOIN by_rmse r ON w.task_name = r.task_name AND w.rank = 1 AND r.rmse_rank = 1""",
    ("pred",),
)
def ev_cross_task(spark, sf_dir):
    metrics = ev.regression_metrics(predictions(spark, sf_dir))
    versus = rk.composite_vs_rmse(rk.rank_candidates(metric_candidates(metrics)))
    made = ev.cross_task_summary(metrics, versus)
    made = rounded(made, "rmse", "mae", "r2", "mape", digits=6)
    return rounded(made, "composite_score_diff", "rmse_penalty_vs_baseline")


# ---------------------------------------------------------------- chart data over predictions

STEPS_SQL = """steps AS (SELECT Task, Model, obs_ts, event_id, Actual - Predicted AS residual,
 ROW_NUMBER() OVER (PARTITION BY Task, Model ORDER BY obs_ts, event_id) - 1 AS step,
 COUNT(*) OVER (PARTITION BY Task, Model) AS n FROM pred)"""


def steps(spark, sf_dir):
    return ch.residual_series(predictions(spark, sf_dir), order_by=KEYS)


@query(
    "ch_residuals",
    f"WITH {STEPS_SQL} SELECT Task, Model, obs_ts, event_id, step, ROUND(residual, 9) AS residual FROM steps",
    ("pred",),
)
def ch_residuals(spark, sf_dir):
    return rounded(steps(spark, sf_dir), "residual")


@query(
    "ch_uniform_sample",
    f"""WITH {STEPS_SQL}, wanted AS (SELECT DISTINCT Task, Model,
 CASE WHEN n <= 500 THEN k ELSE CAST(round_even(k*((n - 1)/499e0), 0) AS BIGINT) END AS step
 FROM (SELECT DISTINCT Task, Model, n FROM steps) s, range(500) r(k) WHERE n > 500 OR k < n)
SELECT Task, Model, obs_ts, event_id, step, ROUND(residual, 9) AS residual
FROM steps JOIN wanted USING (Task, Model, step)""",
    ("pred",),
)
def ch_uniform_sample(spark, sf_dir):
    return rounded(ch.display_sample(steps(spark, sf_dir), points=500), "residual")


HIST_SQL = """r AS (SELECT Task, Model, Actual - Predicted AS x FROM pred),
ranges AS (SELECT Task, Model, MIN(x) AS low, MAX(x) AS high, COUNT(x) AS n FROM r GROUP BY 1, 2),
binned AS (SELECT Task, Model, LEAST(FLOOR((x - low)/(high - low)*60), 59) AS bin FROM r JOIN ranges USING (Task, Model)),
counts AS (SELECT Task, Model, bin, COUNT(*) AS c FROM binned GROUP BY 1, 2, 3)"""


@query(
    "ch_residual_hist",
    f"""WITH {HIST_SQL}
SELECT g.Task, g.Model, CAST(g.b AS INTEGER) AS bin, ROUND(low + b*((high - low)/60), 6) AS left_edge,
 ROUND(low + (b + 1)*((high - low)/60), 6) AS right_edge, COALESCE(c, 0) AS count,
 ROUND(COALESCE(c, 0)/(n*((high - low)/60)), 6) AS density
FROM (SELECT * FROM ranges, range(60) t(b)) g
LEFT JOIN counts k ON g.Task = k.Task AND g.Model = k.Model AND g.b = k.bin""",
    ("pred",),
)
def ch_residual_hist(spark, sf_dir):
    made = ch.residual_histogram(predictions(spark, sf_dir))
    return rounded(made, "left_edge", "right_edge", "density", digits=6)


@query(
    "ch_residual_kde",
    """WITH r AS (SELECT Task, Model, Actual - Predicted AS x FROM pred),
grids AS (SELECT Task, Model, MIN(x) AS low, (MAX(x) - MIN(x))/299 AS gap, COUNT(*) AS n,
 POW(COUNT(*), -0.2)*STDDEV_SAMP(x) AS h FROM r GROUP BY 1, 2),
points AS (SELECT *, low + p*gap AS g FROM grids, range(300) t(p))
SELECT Task, Model, CAST(p AS INTEGER) AS point, ROUND(g, 6) AS x,
 ROUND(SUM(EXP(-0.5e0*((g - r.x)/h)*((g - r.x)/h)))/(n*h*SQRT(2*pi())), 6) AS density
FROM points JOIN r USING (Task, Model) GROUP BY Task, Model, p, g, n, h""",
    ("pred",),
)
def ch_residual_kde(spark, sf_dir):
    return rounded(ch.residual_kde(predictions(spark, sf_dir)), "x", "density", digits=6)


@query(
    "ch_extent",
    """SELECT Task, Model, LEAST(MIN(Actual), MIN(Predicted)) AS low, GREATEST(MAX(Actual), MAX(Predicted)) AS high
FROM pred GROUP BY 1, 2""",
    ("pred",),
)
def ch_extent(spark, sf_dir):
    return ch.extent(predictions(spark, sf_dir))


# ---------------------------------------------------------------- chart data over candidates


def ranked_candidates(spark, sf_dir):
    return rk.rank_candidates(candidates(spark, sf_dir))


@query(
    "ch_pareto",
    f"""WITH {RANKED_SQL}, p AS (SELECT *, MIN(rmse) OVER (PARTITION BY task_name ORDER BY training_time, rmse, model_name
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ranked)
SELECT task_name, model_name, training_time, rmse FROM p WHERE best IS NULL OR rmse < best""",
    ("cand",),
)
def ch_pareto(spark, sf_dir):
    made = ch.pareto_frontier(ranked_candidates(spark, sf_dir))
    return made.select("task_name", "model_name", "training_time", "rmse")


@query(
    "ch_resource_pairs",
    f"WITH {RANKED_SQL}\n"
    + "\nUNION ALL ".join(
        f"""SELECT task_name, model_name, rank, '{x}' AS x_metric, '{y}' AS y_metric, ROUND({x}, 9) AS x, ROUND({y}, 9) AS y
FROM ranked WHERE {x} IS NOT NULL AND {y} IS NOT NULL"""
        for x, y in ch.RESOURCE_PAIRS
    ),
    ("cand",),
)
def ch_resource_pairs(spark, sf_dir):
    return rounded(ch.resource_pairs(ranked_candidates(spark, sf_dir)), "x", "y")


@query(
    "ch_score_breakdown",
    f"WITH {RANKED_SQL}\n"
    + "\nUNION ALL ".join(
        f"""SELECT task_name, model_name, rank, '{m}' AS metric, {rk.PROFILES["balanced"][m]}::DOUBLE AS weight,
 ROUND({name}, 9) AS normalised, ROUND({rk.PROFILES["balanced"][m]}::DOUBLE*{name}, 9) AS contribution FROM ranked"""
        for m, (_, name) in rk.METRICS.items()
    ),
    ("cand",),
)
def ch_score_breakdown(spark, sf_dir):
    return rounded(ch.score_breakdown(ranked_candidates(spark, sf_dir)), "normalised", "contribution")


@query(
    "ch_dual_rank",
    f"""WITH {RANKED_SQL} SELECT task_name, model_name, rmse, ROUND(composite_score, 9) AS composite_score, rank,
 CAST(ROW_NUMBER() OVER (PARTITION BY task_name ORDER BY rmse, rank) AS INTEGER) AS rmse_rank FROM ranked""",
    ("cand",),
)
def ch_dual_rank(spark, sf_dir):
    return rounded(ch.dual_rank(ranked_candidates(spark, sf_dir)), "composite_score")


@query("ch_metric_grid", "SELECT task_name, model_name, rmse, mae, r2, training_time, prediction_time FROM cand", ("cand",))
def ch_metric_grid(spark, sf_dir):
    return ch.metric_grid(candidates(spark, sf_dir))


@query(
    "ch_model_order",
    f"""WITH {METRICS_SQL}, l AS (
 SELECT Task, Model, 'rmse' AS metric, rmse AS value, rmse AS cost FROM metrics
 UNION ALL SELECT Task, Model, 'mae', mae, mae FROM metrics
 UNION ALL SELECT Task, Model, 'r2', r2, -r2 FROM metrics
 UNION ALL SELECT Task, Model, 'mape', mape, mape FROM metrics
 WHERE Task IN (SELECT Task FROM metrics WHERE mape_is_reliable))
SELECT Task, Model, metric, ROUND(value, 6) AS value,
 CAST(ROW_NUMBER() OVER (PARTITION BY Task, metric ORDER BY cost, Model) AS INTEGER) AS position FROM l""",
    ("pred",),
)
def ch_model_order(spark, sf_dir):
    made = ch.model_order(ev.regression_metrics(predictions(spark, sf_dir)))
    return rounded(made, "value", digits=6)


@query(
    "ch_task_order",
    f"WITH {RANKED_SQL} SELECT task_name, model_name, rmse AS value FROM ranked WHERE rank = 1",
    ("cand",),
)
def ch_task_order(spark, sf_dir):
    return ch.task_order(ranked_candidates(spark, sf_dir))


@query(
    "ch_rmse_pivot",
    "SELECT task_name, "
    + ", ".join(f"MAX(CASE WHEN model_name = 'model_{i}' THEN rmse END) AS model_{i}" for i in range(4))
    + ", CAST('nan' AS DOUBLE) AS model_4 FROM cand GROUP BY task_name",
    ("cand",),
)
def ch_rmse_pivot(spark, sf_dir):
    return ch.rmse_matrix(candidates(spark, sf_dir), [f"model_{i}" for i in range(5)])


IMPORTANCE_SQL = """imp AS (SELECT event_type AS task, CONCAT('model_', CAST(user_id % 4 AS VARCHAR)) AS model,
 CONCAT('user_', CAST(user_id AS VARCHAR)) AS feature,
 CASE WHEN user_id % 50 = 7 THEN 'not known' ELSE CAST(CAST(SUM(value) AS DECIMAL(18,2)) AS VARCHAR) END AS importance
 FROM events GROUP BY event_type, user_id)"""


def importances(spark, sf_dir):
    """Importances as text, with some that are no number."""
    total = F.sum("value").cast("decimal(18,2)").cast("string")
    grouped = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(total.alias("total"))
    return grouped.select(
        F.col("event_type").alias("task"),
        F.concat(F.lit("model_"), (F.col("user_id") % 4).cast("string")).alias("model"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("feature"),
        F.when(F.col("user_id") % 50 == 7, "not known").otherwise(F.col("total")).alias("importance"),
    )


TOP_SQL = f"""{IMPORTANCE_SQL}, top AS (SELECT task, model, feature, TRY_CAST(importance AS DOUBLE) AS importance,
 CAST(ROW_NUMBER() OVER (PARTITION BY task, model ORDER BY TRY_CAST(importance AS DOUBLE) DESC, feature) AS INTEGER) AS rank
 FROM imp WHERE TRY_CAST(importance AS DOUBLE) IS NOT NULL)"""


@query("ch_topn_importance", f"WITH {TOP_SQL} SELECT * FROM top WHERE rank <= 15")
def ch_topn_importance(spark, sf_dir):
    return ch.top_importances(importances(spark, sf_dir))


@query(
    "tb_top_features",
    f"""WITH {TOP_SQL} SELECT task, model, STRING_AGG(feature, ', ' ORDER BY rank) AS top_features
FROM top WHERE rank <= 15 GROUP BY 1, 2""",
)
def tb_top_features(spark, sf_dir):
    return ch.top_feature_list(importances(spark, sf_dir))


@query(
    "ch_mean_abs_shap",
    "WITH m AS ("
    + "\nUNION ALL ".join(f"SELECT '{c}' AS feature, AVG(ABS({c})) AS mean_abs FROM meter" for c in METER_COLUMNS)
    + """) SELECT feature, ROUND(mean_abs, 6) AS mean_abs,
 CAST(ROW_NUMBER() OVER (ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank FROM m QUALIFY rank <= 5""",
    ("meter",),
)
def ch_mean_abs_shap(spark, sf_dir):
    return rounded(ch.mean_absolute_values(meter(spark, sf_dir), METER_COLUMNS, 5), "mean_abs", digits=6)


# ---------------------------------------------------------------- report tables


def _text(column: str, digits: int = 4) -> str:
    return f"CASE WHEN {column} IS NULL OR isnan({column}) THEN 'N/A' ELSE printf('%.{digits}f', {column}) END"


@query(
    "tb_performance",
    f"""WITH {METRICS_SQL}, best AS (SELECT Task, Model FROM metrics
 QUALIFY ROW_NUMBER() OVER (PARTITION BY Task ORDER BY rmse, Model) = 1)
SELECT m.Task, m.Model, CASE WHEN m.Model = b.Model THEN '✓' ELSE '' END AS Selected,
 {_text("rmse", 6)} AS RMSE, {_text("mae", 6)} AS MAE, {_text("r2", 6)} AS R2,
 CASE WHEN mape_is_reliable THEN {_text("mape", 6)} ELSE 'N/A (unreliable)' END AS MAPE, num_rows AS Num_Test_Rows
FROM metrics m LEFT JOIN best b ON m.Task = b.Task""",
    ("pred",),
)
def tb_performance(spark, sf_dir):
    metrics = ev.regression_metrics(predictions(spark, sf_dir))
    return ch.performance_table(metrics, ev.best_by_rmse(metrics))


@query(
    "tb_resources",
    f"""WITH {RANKED_SQL} SELECT task_name, model_name, rank, {_text("training_time")} AS training_time,
 {_text("prediction_time")} AS prediction_time, {_text("memory_usage_mb")} AS memory_usage_mb,
 {_text("cpu_usage_pct")} AS cpu_usage_pct, {_text("composite_score")} AS composite_score FROM ranked""",
    ("cand",),
)
def tb_resources(spark, sf_dir):
    return ch.resource_table(ranked_candidates(spark, sf_dir))


@query(
    "tb_selection",
    f"""WITH {RANKED_SQL} SELECT task_name, model_name, {_text("composite_score")} AS composite_score, rank,
 CASE WHEN is_selected THEN '✓' ELSE '' END AS selected, 'balanced' AS selection_profile FROM ranked""",
    ("cand",),
)
def tb_selection(spark, sf_dir):
    return ch.selection_table(ranked_candidates(spark, sf_dir))


@query(
    "tb_statistics",
    f"""WITH {SELECTED_SQL}, {WILCOXON_SQL}, {T_SQL},
areas AS (SELECT Task, baseline_model, candidate_model, statistic, sample_size,
 {_simpson("EXP(-0.5e0*(ABS(z) + i*0.003e0)*(ABS(z) + i*0.003e0))")} * 0.003e0/3*2/SQRT(2*pi()) AS p
 FROM w, range(4001) r(i) GROUP BY Task, baseline_model, candidate_model, statistic, sample_size, z),
q AS (SELECT Task, baseline_model, candidate_model, mean_diff, sem_diff, 2.241402727604947e0 AS z, sample_size - 1e0 AS df FROM t),
tested AS (SELECT areas.*, 0.05::DOUBLE/COUNT(*) OVER (PARTITION BY Task) AS level, mean_diff, sem_diff*{T_QUANTILE_SQL} AS reach
 FROM areas JOIN q USING (Task, baseline_model, candidate_model))
SELECT Task, baseline_model, candidate_model, 'wilcoxon' AS test_name, {_text("statistic")} AS statistic,
 printf('%.4e', p) AS p_value, {_text("level")} AS alpha, CASE WHEN p < level THEN 'Yes' ELSE 'No' END AS significant,
 'bonferroni' AS correction_method, sample_size, {_text("mean_diff - reach")} AS ci_lower, {_text("mean_diff + reach")} AS ci_upper,
 '' AS notes FROM tested""",
    ("pred",),
)
def tb_statistics(spark, sf_dir):
    return ch.statistics_table(comparisons(spark, sf_dir))


@query(
    "ev_few_pairs",
    f"""WITH {SELECTED_SQL}, {T_SQL} SELECT Task, baseline_model, candidate_model, 0e0 AS statistic, 1e0 AS p_value, 0.05::DOUBLE AS alpha,
 FALSE AS is_significant, 'none' AS correction_method, sample_size, CAST(NULL AS DOUBLE) AS ci_lower, CAST(NULL AS DOUBLE) AS ci_upper,
 'not tested: ' || sample_size || ' pairs, ' || (MAX(sample_size) OVER () + 1) || ' are needed' AS notes FROM t""",
    ("pred",),
)
def ev_few_pairs(spark, sf_dir):
    """One pair short of what a test needs, in every task."""
    made = predictions(spark, sf_dir)
    metrics = ev.stage(ev.regression_metrics(made), "metrics")
    needed = metrics.agg(F.max("num_rows")).first()[0] + 1
    tested = ev.compare_predictors(made, ev.best_by_rmse(metrics), on=KEYS, min_pairs=needed)
    return tested.drop("test_name")


@query(
    "tb_format",
    f"""SELECT event_id, {_text("Global_active_power")} AS Global_active_power, {_text("Voltage", 2)} AS Voltage FROM meter""",
    ("meter",),
)
def tb_format(spark, sf_dir):
    return meter(spark, sf_dir).select(
        "event_id",
        number_text(F.col("Global_active_power")).alias("Global_active_power"),
        number_text(F.col("Voltage"), 2).alias("Voltage"),
    )
