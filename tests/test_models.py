import pytest
from pyspark.sql import functions as F

from loadlens.operators import models as ml
from loadlens.operators import prep
from loadlens.operators.ordered import RN, order_rows

TASK = prep.Task("y_task", "y", ("a", "b"))
QUICK = {
    "linear_regression": ml.SETTINGS["linear_regression"],
    "decision_tree": {**ml.SETTINGS["decision_tree"], "max_depth": 2},
}


@pytest.fixture(scope="module")
def data(spark):
    df = spark.range(200).select(
        "id",
        F.timestamp_seconds(F.col("id") * 60).alias("Timestamp"),
        # every tenth row lacks a feature
        F.when(F.col("id") % 10 == 4, None).otherwise((F.col("id") % 7).cast("double")).alias("a"),
        (F.col("id") % 5).cast("double").alias("b"),
    )
    df = df.withColumn("y", 3 * F.coalesce("a", F.lit(0.0)) - F.col("b") + 1)
    return ml.prepare_task(order_rows(df, ["Timestamp"]), TASK)


def test_split_counts_complete_rows(data):
    assert (data.train.count(), data.test.count()) == (144, 36)
    assert data.train.agg(F.max(RN)).first()[0] < data.test.agg(F.min(RN)).first()[0]


def test_linear_coefficients(data):
    model = ml.estimator("linear_regression").fit(data.train)
    assert model.coefficients.toArray().tolist() == pytest.approx([3.0, -1.0], abs=1e-6)
    assert model.intercept == pytest.approx(1.0, abs=1e-6)


def test_unknown_model():
    with pytest.raises(ValueError, match="unknown model"):
        ml.estimator("oracle")


def test_disabled_models_are_left_out():
    assert ml.candidate_models({"a": {"enabled": False}, "b": {}}) == ["b"]


def test_grids():
    sizes = {name: len(ml.param_grid(space)) for name, space in ml.SEARCH_SPACES.items()}
    assert sizes == {"linear_regression": 6, "decision_tree": 12, "random_forest": 8, "gradient_boosted_tree": 8}
    few = ml.param_grid(ml.SEARCH_SPACES["decision_tree"], strategy="random_search", combinations=5)
    assert len(few) == 5
    assert few == ml.param_grid(ml.SEARCH_SPACES["decision_tree"], strategy="random_search", combinations=5)
    assert ml.param_grid({}) == []
    wide = {"a": list(range(5)), "b": list(range(5))}
    assert len(ml.param_grid(wide)) == 25
    with pytest.raises(ValueError, match="25 combinations"):
        ml.param_grid(wide, combinations=12)
    with pytest.raises(ValueError, match="needs a number"):
        ml.param_grid(wide, strategy="random_search")


def test_series_are_split_and_folded_at_their_own_points(spark):
    df = spark.range(60).select(
        F.when(F.col("id") < 20, "a").otherwise("b").alias("meter"),
        F.timestamp_seconds(F.col("id") * 60).alias("Timestamp"),
        F.when(F.col("id") < 10, None).otherwise(F.col("id").cast("double")).alias("a"),
        (F.col("id") % 5).cast("double").alias("b"),
        F.col("id").cast("double").alias("y"),
    )
    made = ml.prepare_task(order_rows(df, ["Timestamp"], ["meter"]), TASK)
    assert made.rows.total == 50  # ten rows of the first meter lack a feature
    counts = {r["meter"]: r["count"] for r in made.test.groupBy("meter").count().collect()}
    assert counts == {"a": 2, "b": 8}
    for fold, (train, validation) in zip((1, 2), ((2, 3), (5, 3)), strict=True):
        frames = made.fold_frames(prep.series_folds("expanding", 3)[fold - 1])
        assert tuple(f.where("meter = 'a'").count() for f in frames) == (train, validation)
    scored = ml.score(ml.estimator("linear_regression").fit(made.train), made.test, "t", "m", series=["meter"])
    assert scored.columns[:2] == ["meter", "Row"] and scored.select("Row").distinct().count() == 10


def test_gaps_leave_no_empty_fold_and_empty_spaces_do_not_tune(spark):
    df = spark.range(120).select(
        F.timestamp_seconds(F.col("id") * 60).alias("Timestamp"),
        F.when(F.col("id") < 60, None).otherwise(F.col("id").cast("double")).alias("a"),
        (F.col("id") % 5).cast("double").alias("b"), F.col("id").cast("double").alias("y"),
    )
    made = ml.prepare_task(order_rows(df, ["Timestamp"]), TASK)
    frames = [made.fold_frames(f) for f in prep.series_folds("expanding", 3)]
    assert [[f.count() for f in pair] for pair in frames] == [[16, 16], [32, 16]]
    (only,) = ml.tune(made, "linear_regression", prep.series_folds("expanding", 3), space={})
    assert only.parameters == {} and len(only.fold_scores) == 2


def test_tuning_drops_sets_that_fail(data):
    folds = prep.expanding_folds(data.train_rows, 3)
    results = ml.tune(data, "decision_tree", folds, space={"max_depth": [1, 4, 99]}, settings={"seed": 42})
    assert [r.parameters["max_depth"] for r in results] == [4, 1, 99]
    assert [r.error is None for r in results] == [True, True, False]
    with pytest.raises(RuntimeError, match="no parameter set"):
        ml.tune(data, "decision_tree", folds, space={"max_depth": [99]})
    with pytest.raises(ValueError, match="no rows"):
        ml.tune(data, "decision_tree", [prep.Fold(1, (0, 0), (0, 9))])
    best = ml.tune(data, "decision_tree", folds, space={"max_depth": [1, 4]}, settings={"seed": 42}, metric="r2")
    assert best[0].parameters == {"max_depth": 4} and len(best[0].fold_scores) == 2


def test_training_keeps_failures(spark, data):
    settings = {**QUICK, "random_forest": {"num_trees": -1}}
    made = ml.train_candidates(data, settings=settings)
    assert [c.error is None for c in made] == [True, True, False]
    metrics = {r["model_name"]: r for r in ml.candidate_metrics(spark, made).collect()}
    assert set(metrics) == {"linear_regression", "decision_tree"}
    assert metrics["linear_regression"]["rmse"] == pytest.approx(0.0, abs=1e-6)
    assert metrics["decision_tree"]["num_rows"] == 36
    assert [r["model_name"] for r in ml.failed_candidates(spark, made).collect()] == ["random_forest"]
    importance = ml.feature_importance(spark, made, {"y_task": TASK}).orderBy("rank").collect()
    assert [r["feature"] for r in importance] == ["a", "b"]


def test_every_model_failing_is_an_error(data):
    with pytest.raises(RuntimeError, match="every model failed"):
        ml.train_candidates(data, settings={"random_forest": {"num_trees": -1}})


def test_model_roundtrip(spark, data, tmp_path):
    df = data.train.select("label", F.col("label").alias("a"))
    model, seconds = ml.fit_pipeline(df, ["a"], ml.estimator("decision_tree"))
    path = ml.save_model(model, str(tmp_path / "model"))
    want = [r["prediction"] for r in model.transform(df).collect()]
    assert [r["prediction"] for r in ml.load_model(path).transform(df).collect()] == want and seconds > 0


def test_forest_is_repeatable(data):
    settings = {"num_trees": 5, "max_depth": 3, "seed": 42}
    runs = [
        sorted(r["prediction"] for r in ml.estimator("random_forest", settings).fit(data.train).transform(data.test).collect())
        for _ in range(2)
    ]
    assert runs[0] == runs[1]


def test_forecast(spark):
    df = spark.range(600).select(
        F.timestamp_seconds(F.col("id") * 3600).alias("Timestamp"),
        (F.col("id") % 24).cast("double").alias("Global_active_power"),
    )
    got = ml.forecast_tail(order_rows(df, ["Timestamp"]), holdout_rows=100, day_rows=24, smoothing_rows=5)
    rows = got.orderBy("Timestamp").collect()
    assert len(rows) == 100
    assert max(abs(r["Actual"] - r["Predicted"]) for r in rows) < 2
    assert rows[1]["Actual_Smooth_5"] == (rows[0]["Actual"] + rows[1]["Actual"]) / 2


@pytest.mark.parametrize("series", [[], ["meter"]])
def test_recursive_forecast_goes_on_from_its_own_predictions(spark, series):
    values = {"a": [1.0, 2.0], "b": [3.0, -1.0]}
    for v in values.values():
        for _ in range(60):
            v.append(0.6 * v[-1] - 0.3 * v[-2] + 1.5)
    names = list(values) if series else ["a"]
    rows = [(m, i, float(x)) for m in names for i, x in enumerate(values[m])] + ([("short", 0, 1.0), ("short", 1, 2.0)] if series else [])
    df = spark.createDataFrame(rows, "meter string, i long, power double").withColumn("Timestamp", F.timestamp_seconds("i"))
    found = ml.forecast_by_series(order_rows(df, ["Timestamp"], series), "power", horizon=5, lags=2)
    got = {(r["meter"] if series else "a", r["step"]): r["prediction"] for r in found.collect()}
    assert len(got) == 5 * len(names)
    for m in names:
        held = list(values[m])
        for step in range(1, 6):
            held.append(0.6 * held[-1] - 0.3 * held[-2] + 1.5)
            assert got[m, step] == pytest.approx(held[-1], abs=1e-5)


def test_forecast_of_several_meters(spark):
    df = spark.range(1200).select(
        (F.col("id") % 2).alias("meter"),
        F.timestamp_seconds(F.floor(F.col("id") / 2) * 3600).alias("Timestamp"),
        (F.floor(F.col("id") / 2) % 24 + 50 * (F.col("id") % 2)).cast("double").alias("Global_active_power"),
    )
    got = ml.forecast_tail(order_rows(df, ["Timestamp"], ["meter"]), holdout_rows=100, day_rows=24, smoothing_rows=5)
    rows = got.collect()
    assert len(rows) == 200 and {r["meter"] for r in rows} == {0, 1}
    assert max(abs(r["Actual"] - r["Predicted"]) for r in rows) < 12  # the meters are 50 apart


def test_fits_read_a_bounded_number_of_rows_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(ml, "MOST_ROWS_A_TASK", 1000)
    rows = spark.range(6000).select(F.col("id").alias(RN)).coalesce(1)
    made = [[r[RN] for r in part] for part in ml.fitting(rows, 6000).rdd.glom().collect()]
    assert max(map(len, made)) < 1500 and sum(map(len, made)) == 6000
    assert all(part == sorted(part) for part in made)
