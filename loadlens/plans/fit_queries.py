"""Fits whose values SQL can work out: penalties, series, small trees, shares and recursive forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.functions.calendar import calendar_columns
from loadlens.operators import gram, prep, trees
from loadlens.operators import models as ml
from loadlens.operators.ordered import order_rows
from loadlens.plans.model_queries import ONE_FEATURE_SQL, one_feature_data
from loadlens.plans.registry import query, rounded
from loadlens.plans.series_queries import CLEAN_METER, KEYS, ORDER, clean_meter

PENALTIES = {"reg_param": [0.0, 0.1, 1.0], "elastic_net_param": [0.0, 0.5]}

# slope of one standardized feature: the correlation, shrunk by the lasso and the ridge part
_FOLD_SQL = """fit{k} AS (SELECT reg, net, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, corr(x, y) AS r
 FROM t CROSS JOIN penalties WHERE rn < {end} GROUP BY reg, net),
line{k} AS (SELECT reg, net, mx, my, sign(r)*GREATEST(abs(r) - net*reg/sy, 0)/(1 + (1 - net)*reg/sy)*sy/sx AS b FROM fit{k}),
s{k} AS (SELECT reg, net, SQRT(AVG((y - my - b*(x - mx))*(y - my - b*(x - mx)))) AS score
 FROM t CROSS JOIN line{k} WHERE rn >= {end} AND rn < {stop} GROUP BY reg, net)"""


@query(
    "ml_tune_penalties",
    f"""WITH {ONE_FEATURE_SQL}, t AS (SELECT x, y, rn, CAST(FLOOR(n*0.8) AS BIGINT) AS m FROM numbered WHERE rn < FLOOR(n*0.8)),
penalties AS (SELECT reg, net FROM (SELECT unnest([0e0, 0.1e0, 1e0]) AS reg) CROSS JOIN (SELECT unnest([0e0, 0.5e0]) AS net)),
{_FOLD_SQL.format(k=1, end="m//3", stop="2*m//3")}, {_FOLD_SQL.format(k=2, end="2*m//3", stop="m")}
SELECT CAST(reg AS VARCHAR) AS reg_param, CAST(net AS VARCHAR) AS elastic_net_param,
 ROUND((s1.score + s2.score)/2, 6) AS mean_score FROM s1 JOIN s2 USING (reg, net)""",
    ("meter",),
)
def ml_tune_penalties(spark, sf_dir):
    data = one_feature_data(spark, sf_dir)
    results = ml.tune(data, "linear_regression", prep.expanding_folds(data.train_rows), space=PENALTIES)
    table = ml.tuning_table(spark, "intensity", results)
    picked = [F.col("parameters")[name].alias(name) for name in PENALTIES]
    return rounded(table.select(*picked, "mean_score"), "mean_score", digits=6)


def series_vectors(spark, sf_dir):
    """Voltage as the only feature of the intensity, in seven series."""
    rows = clean_meter(spark, sf_dir).select(*KEYS, (F.col("event_id") % 7).alias("series_no"), "Voltage", "Global_intensity")
    return ml.assembler(["Voltage"]).transform(rows).withColumnRenamed("Global_intensity", ml.LABEL)


@query(
    "ml_fit_by_series",
    f"""WITH {CLEAN_METER} SELECT event_id % 7 AS series_no, COUNT(*) AS n,
 ROUND(regr_slope(Global_intensity, Voltage), 6) AS slope, ROUND(regr_intercept(Global_intensity, Voltage), 6) AS intercept
FROM readings GROUP BY 1""",
    ("meter",),
)
def ml_fit_by_series(spark, sf_dir):
    fits = gram.fit_by_series(series_vectors(spark, sf_dir), ["series_no"])
    return rounded(fits.select("series_no", "n", F.col("coefficients")[0].alias("slope"), "intercept"), "slope", "intercept", digits=6)


@query(
    "ml_predict_by_series",
    f"""WITH {CLEAN_METER}, fits AS (SELECT event_id % 7 AS series_no, regr_slope(Global_intensity, Voltage) AS b,
 regr_intercept(Global_intensity, Voltage) AS a FROM readings GROUP BY 1)
SELECT event_id, series_no, Global_intensity AS label, ROUND(a + b*Voltage, 6) AS prediction
FROM readings JOIN fits ON event_id % 7 = series_no""",
    ("meter",),
)
def ml_predict_by_series(spark, sf_dir):
    vectors = series_vectors(spark, sf_dir)
    made = gram.predict_by_series(vectors, gram.fit_by_series(vectors, ["series_no"]), ["series_no"])
    return rounded(made.select("event_id", "series_no", ml.LABEL, "prediction"), "prediction", digits=6)


@query(
    "ml_forecast_by_series",
    f"""WITH {CLEAN_METER}, lagged AS (SELECT event_id % 7 AS series_no, Global_active_power AS y,
 LAG(Global_active_power) OVER w AS x, ROW_NUMBER() OVER (PARTITION BY event_id % 7 ORDER BY obs_ts DESC, event_id DESC) AS from_end
 FROM readings WINDOW w AS (PARTITION BY event_id % 7 ORDER BY obs_ts, event_id)),
fits AS (SELECT series_no, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM lagged WHERE x IS NOT NULL GROUP BY 1)
SELECT series_no, CAST(step AS INTEGER) AS step, ROUND(a*(1 - POWER(b, step))/(1 - b) + POWER(b, step)*y, 6) AS prediction
FROM lagged JOIN fits USING (series_no) CROSS JOIN (SELECT unnest(range(1, 25)) AS step) WHERE from_end = 1""",
    ("meter",),
)
def ml_forecast_by_series(spark, sf_dir):
    rows = clean_meter(spark, sf_dir).select(*KEYS, (F.col("event_id") % 7).alias("series_no"), "Global_active_power")
    made = ml.forecast_by_series(order_rows(rows, ORDER, ["series_no"]), "Global_active_power", horizon=24)
    return rounded(made, "prediction", digits=6)


def hours(spark, sf_dir):
    """The hour, of which there are fewer values than bins, as the only feature."""
    rows = clean_meter(spark, sf_dir).withColumns({"Hour": calendar_columns(F.col("obs_ts"))["Hour"], ml.LABEL: F.col("Global_active_power")})
    return ml.assembler(["Hour"]).transform(rows.select(*KEYS, "Hour", ml.LABEL))


# the cut with the least squares left on both sides; ties do not occur in these readings
_STUMP_SQL = """cuts{k} AS (SELECT c, SUM(CASE WHEN h <= c THEN {y} END) AS sl, COUNT(CASE WHEN h <= c THEN 1 END) AS nl,
 SUM(CASE WHEN h > c THEN {y} END) AS sr, COUNT(CASE WHEN h > c THEN 1 END) AS nr
 FROM {source} CROSS JOIN (SELECT unnest(range(0, 23)) AS c) GROUP BY c),
stump{k} AS (SELECT c, sl/nl AS low, sr/nr AS high FROM cuts{k} ORDER BY sl*sl/nl + sr*sr/nr DESC LIMIT 1)"""
_HOURS_SQL = f"WITH {CLEAN_METER}, r AS (SELECT event_id, hour(obs_ts) AS h, Global_active_power AS y FROM readings)"


@query(
    "ml_tree_stump",
    f"""{_HOURS_SQL}, {_STUMP_SQL.format(k=1, y="y", source="r")}
SELECT m.model, event_id, ROUND(CASE WHEN h <= c THEN low ELSE high END, 9) AS prediction,
 ROUND((SELECT AVG(y) FROM r), 9) AS base, ROUND(CASE WHEN h <= c THEN low ELSE high END - (SELECT AVG(y) FROM r), 9) AS Hour
FROM r CROSS JOIN stump1 CROSS JOIN (SELECT unnest(['decision_tree', 'random_forest']) AS model) m""",
    ("meter",),
)
def ml_tree_stump(spark, sf_dir):
    """A tree of one cut, also as a forest of one tree, and the hour's share in every prediction."""
    rows = ml.stage(hours(spark, sf_dir), "hours")
    made = []
    for name, settings in (("decision_tree", {"max_depth": 1}), ("random_forest", {"max_depth": 1, "num_trees": 1, "bootstrap": False, "seed": 1})):
        model = ml.estimator(name, settings).fit(rows)
        shares = trees.attributions(model.transform(rows), trees.read_trees(spark, model), ["Hour"], ["event_id", "prediction"])
        made.append(shares.withColumn("model", F.lit(name)))
    return rounded(made[0].unionByName(made[1]), "prediction", "base", "Hour")


@query(
    "ml_boosted_stumps",
    f"""{_HOURS_SQL}, {_STUMP_SQL.format(k=1, y="y", source="r")},
r2 AS (SELECT event_id, h, y, CASE WHEN h <= c THEN low ELSE high END AS first, 2*(y - CASE WHEN h <= c THEN low ELSE high END) AS left_over
 FROM r CROSS JOIN stump1), {_STUMP_SQL.format(k=2, y="left_over", source="r2")}
SELECT event_id, ROUND(first + 0.1e0*CASE WHEN h <= c THEN low ELSE high END, 9) AS prediction FROM r2 CROSS JOIN stump2""",
    ("meter",),
)
def ml_boosted_stumps(spark, sf_dir):
    """Two rounds of boosting with trees of one cut."""
    rows = ml.stage(hours(spark, sf_dir), "hours")
    model = ml.estimator("gradient_boosted_tree", {"max_depth": 1, "max_iter": 2, "step_size": 0.1}).fit(rows)
    return rounded(model.transform(rows).select("event_id", "prediction"), "prediction")


@query(
    "ml_models_of_version",
    f"""{_HOURS_SQL}, {_STUMP_SQL.format(k=1, y="y", source="r")}, line AS (SELECT regr_slope(y, h) AS b, regr_intercept(y, h) AS a FROM r)
SELECT 'v7' AS version, 'power' AS task, model, model = 'decision_tree' AS is_selected, 'Global_active_power' AS target, event_id,
 ROUND(CASE WHEN model = 'decision_tree' THEN CASE WHEN h <= c THEN low ELSE high END ELSE a + b*h END, 6) AS prediction
FROM r CROSS JOIN stump1 CROSS JOIN line CROSS JOIN (SELECT unnest(['decision_tree', 'linear_regression']) AS model)""",
    ("meter",),
)
def ml_models_of_version(spark, sf_dir):
    """All models of a version as they are read back, and what each predicts."""
    task = prep.Task("power", "Global_active_power", ("Hour",))
    rows = ml.stage(hours(spark, sf_dir), "hours")
    found = [
        ml.TrainedCandidate("power", name, settings, ml.estimator(name, settings).fit(rows))
        for name, settings in (("decision_tree", {"max_depth": 1}), ("linear_regression", {"max_iter": 10}))
    ]
    base = ml.shared_path(spark, "models")
    ml.save_models(spark, found, {"power": task}, base, "v7", {"power": "decision_tree"})
    made = None
    for r in ml.model_records(spark, base, "v7").collect():  # a row for each model
        model = ml.load_selected(spark, base, "v7", "power") if r["is_selected"] else ml.load_model(r["path"])
        told = {k: F.lit(r[k]) for k in ("version", "task", "model", "is_selected", "target")}
        one = model.transform(rows.select("event_id", "Hour")).select("event_id", "prediction").withColumns(told)
        made = one if made is None else made.unionByName(one)
    return rounded(made.select("version", "task", "model", "is_selected", "target", "event_id", "prediction"), "prediction", digits=6)
