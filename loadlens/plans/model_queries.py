"""Training, tuning, scoring and forecast queries on the readings."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.operators import chartdata as ch
from loadlens.operators import models as ml
from loadlens.operators import prep
from loadlens.operators.features import add_calendar, add_electrical, add_features
from loadlens.operators.ordered import order_rows
from loadlens.operators.ranking import rank_candidates
from loadlens.plans.fixtures import METER_COLUMNS, candidates, meter
from loadlens.plans.registry import query, rounded
from loadlens.plans.series_queries import CLEAN_METER, KEYS, ORDER, clean_meter, ordered_meter
from loadlens.sources.shared import shared_path

TASKS = prep.tasks("leak_free")


def task_data(spark, sf_dir):
    """Vectors of all tasks, from one pass over the features."""
    made = add_features(ordered_meter(spark, sf_dir, *METER_COLUMNS), ts="obs_ts", by_chunks=True)
    return ml.prepare_tasks(made, list(TASKS.values()), ts="obs_ts", keep=["event_id"])


@query(
    "ml_assemble",
    f"""SELECT event_id, Global_active_power AS f0, Voltage AS f1, Global_intensity AS f2,
 CAST(hour(obs_ts) AS DOUBLE) AS f3 FROM meter
WHERE Global_active_power IS NOT NULL AND Voltage IS NOT NULL AND Global_intensity IS NOT NULL""",
    ("meter",),
)
def ml_assemble(spark, sf_dir):
    columns = ["Global_active_power", "Voltage", "Global_intensity", "Hour"]
    vectors = ml.assembler(columns).transform(add_calendar(meter(spark, sf_dir), "obs_ts"))
    array = vectors.select("event_id", vector_to_array(ml.FEATURES).alias("a"))
    return array.select("event_id", *[F.get("a", F.lit(i)).alias(f"f{i}") for i in range(len(columns))])


@query(
    "ml_linreg_coef",
    f"""WITH {CLEAN_METER} SELECT ROUND(regr_slope(Global_intensity, Voltage), 6) AS slope,
 ROUND(regr_intercept(Global_intensity, Voltage), 6) AS intercept FROM readings""",
    ("meter",),
)
def ml_linreg_coef(spark, sf_dir):
    rows = clean_meter(spark, sf_dir).select("Voltage", F.col("Global_intensity").alias(ml.LABEL))
    model, _ = ml.fit_pipeline(rows, ["Voltage"], ml.estimator("linear_regression"))
    fitted = model.stages[-1]
    table = spark.createDataFrame([(float(fitted.coefficients[0]), float(fitted.intercept))], "slope double, intercept double")
    return rounded(table, "slope", "intercept", digits=6)


def _predicted(spark, sf_dir, name):
    """Predictions of one model for the test rows of every task."""
    tasks = task_data(spark, sf_dir)
    models = ml.fit_models(tasks, name)
    made = [ml.score(m, data.test, data.task.name, name, "obs_ts") for m, data in zip(models, tasks, strict=True)]
    return reduce(DataFrame.unionByName, made)


ONE_FEATURE = prep.Task("intensity", "Global_intensity", ("Voltage",))
ONE_FEATURE_SQL = f"""{CLEAN_METER}, numbered AS (SELECT Voltage AS x, Global_intensity AS y, obs_ts, event_id,
 ROW_NUMBER() OVER (ORDER BY obs_ts, event_id) - 1 AS rn, COUNT(*) OVER () AS n FROM readings)"""


def one_feature_data(spark, sf_dir):
    rows = clean_meter(spark, sf_dir).select(*KEYS, "Voltage", "Global_intensity")
    return ml.prepare_task(order_rows(rows, ORDER), ONE_FEATURE, ts="obs_ts", keep=["event_id"])


@query(
    "ml_linreg_holdout",
    f"""WITH {ONE_FEATURE_SQL}, fit AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM numbered
 WHERE rn < FLOOR(n*0.8))
SELECT obs_ts AS Timestamp, 'intensity' AS Task, 'linear_regression' AS Model, y AS Actual,
 ROUND(a + b*x, 6) AS Predicted FROM numbered CROSS JOIN fit WHERE rn >= FLOOR(n*0.8)""",
    ("meter",),
)
def ml_linreg_holdout(spark, sf_dir):
    data = one_feature_data(spark, sf_dir)
    model = ml.estimator("linear_regression").fit(data.train)
    made = ml.score(model, data.test, data.task.name, "linear_regression", "obs_ts").drop("Row")
    return rounded(made, "Predicted", digits=6)


@query(
    "ml_linreg_holdout_by_series",
    f"""WITH {CLEAN_METER}, numbered AS (SELECT Voltage AS x, Global_intensity AS y, obs_ts, event_id, event_id % 7 AS series_no,
 ROW_NUMBER() OVER (PARTITION BY event_id % 7 ORDER BY obs_ts, event_id) - 1 AS rn,
 COUNT(*) OVER (PARTITION BY event_id % 7) AS n FROM readings),
fit AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM numbered WHERE rn < FLOOR(n*0.8))
SELECT series_no, obs_ts AS Timestamp, 'intensity' AS Task, 'linear_regression' AS Model, y AS Actual,
 ROUND(a + b*x, 6) AS Predicted FROM numbered CROSS JOIN fit WHERE rn >= FLOOR(n*0.8)""",
    ("meter",),
)
def ml_linreg_holdout_by_series(spark, sf_dir):
    rows = clean_meter(spark, sf_dir).select(*KEYS, "Voltage", "Global_intensity", (F.col("event_id") % 7).alias("series_no"))
    data = ml.prepare_task(order_rows(rows, ORDER, ["series_no"]), ONE_FEATURE, ts="obs_ts")
    model = ml.estimator("linear_regression").fit(data.train)
    made = ml.score(model, data.test, data.task.name, "linear_regression", "obs_ts", ["series_no"]).drop("Row")
    return rounded(made, "Predicted", digits=6)


@query(
    "ml_tune_linear",
    f"""WITH {ONE_FEATURE_SQL}, t AS (SELECT x, y, rn, CAST(FLOOR(n*0.8) AS BIGINT) AS m FROM numbered WHERE rn < FLOOR(n*0.8)),
f1 AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t WHERE rn < m//3),
f2 AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t WHERE rn < 2*m//3),
s AS (SELECT (SELECT SQRT(AVG((y - a - b*x)*(y - a - b*x))) FROM t, f1 WHERE rn >= m//3 AND rn < 2*m//3) AS s1,
 (SELECT SQRT(AVG((y - a - b*x)*(y - a - b*x))) FROM t, f2 WHERE rn >= 2*m//3) AS s2)
SELECT 'intensity' AS task, 'linear_regression' AS model, CAST(2 AS INTEGER) AS folds,
 ROUND((s1 + s2)/2, 6) AS mean_score, CAST(1 AS INTEGER) AS rank FROM s""",
    ("meter",),
)
def ml_tune_linear(spark, sf_dir):
    data = one_feature_data(spark, sf_dir)
    folds = prep.expanding_folds(data.train_rows)
    results = ml.tune(data, "linear_regression", folds, space={"max_iter": [100]})
    return rounded(ml.tuning_table(spark, "intensity", results).drop("parameters"), "mean_score", digits=6)


@query("ml_linreg_predict")
def ml_linreg_predict(spark, sf_dir):
    return _predicted(spark, sf_dir, "linear_regression")


@query("ml_tree_predict")
def ml_tree_predict(spark, sf_dir):
    return _predicted(spark, sf_dir, "decision_tree")


@query("ml_forest_predict")
def ml_forest_predict(spark, sf_dir):
    return _predicted(spark, sf_dir, "random_forest")


@query("ml_gbt_predict")
def ml_gbt_predict(spark, sf_dir):
    return _predicted(spark, sf_dir, "gradient_boosted_tree")


def folds_of(data):
    return prep.expanding_folds(data.train_rows)


@query("ml_tune")
def ml_tune(spark, sf_dir):
    found = ml.tune_all(task_data(spark, sf_dir), folds_of)
    return reduce(DataFrame.unionByName, [ml.tuning_table(spark, task, results) for task, results in found])


def trained(spark, sf_dir, *, tuned=False):
    """All tasks and models, with ``tuned`` at the best parameters over the folds of their training rows."""
    return ml.train_all(task_data(spark, sf_dir), folds_of if tuned else None, ts="obs_ts")


@query("ml_train_all")
def ml_train_all(spark, sf_dir):
    return rank_candidates(ml.candidate_metrics(spark, trained(spark, sf_dir, tuned=True)))


@query("ml_predictions_long")
def ml_predictions_long(spark, sf_dir):
    return ml.predictions_of(spark, trained(spark, sf_dir))


@query("ml_feature_importance")
def ml_feature_importance(spark, sf_dir):
    return ml.feature_importance(spark, trained(spark, sf_dir), TASKS)


@query("ml_model_roundtrip")
def ml_model_roundtrip(spark, sf_dir):
    readings = add_electrical(add_calendar(clean_meter(spark, sf_dir), "obs_ts"))
    rows = readings.withColumn(ml.LABEL, F.col("Sub_metering_3"))
    model, _ = ml.fit_pipeline(rows, ["Hour", "Voltage", "Global_intensity"], ml.estimator("decision_tree"))
    path = ml.save_model(model, shared_path(spark, "model"))
    return ml.load_model(path).transform(rows).select(*KEYS, ml.LABEL, "prediction")


@query("ml_forecast_tail")
def ml_forecast_tail(spark, sf_dir):
    ordered = order_rows(clean_meter(spark, sf_dir).select(*KEYS, "Global_active_power"), ORDER)
    # the readings cover 30 days: a day is a thirtieth of the rows, ten days are a third
    return ml.forecast_tail(
        ordered, ts="obs_ts", holdout_rows=ordered.total // 3, day_rows=ordered.total // 30
    )


@query(
    "tb_candidate_config",
    "\nUNION ALL ".join(
        f"SELECT DISTINCT model_name, '{k}' AS parameter, '{v}' AS setting FROM cand WHERE model_name = 'model_{i}'"
        for i, given in enumerate(ml.SETTINGS.values())
        for k, v in given.items()
    ),
    ("cand",),
)
def tb_candidate_config(spark, sf_dir):
    settings = {f"model_{i}": given for i, given in enumerate(ml.SETTINGS.values())}
    return ch.candidate_settings(candidates(spark, sf_dir), settings)
