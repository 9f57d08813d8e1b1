import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loadlens.operators import gram
from loadlens.operators import models as ml
from loadlens.operators import prep
from loadlens.operators.ordered import order_rows

TASK = prep.Task("y_task", "y", ("a", "b", "c"))


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(240, 3, 400), r.normal(0, 1, 400)
    y = 2 * a - 5 * b + r.normal(0, 2, 400)
    rows = [(i, float(a[i]), float(b[i]), float(r.normal() if i % 2 else 0), float(y[i])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double")
    df = df.withColumn("Timestamp", F.timestamp_seconds(F.col("id") * 60))
    return ml.prepare_task(order_rows(df, ["Timestamp"]), TASK)


@pytest.mark.parametrize("reg", [0.0, 0.3, 2.0])
@pytest.mark.parametrize("net", [0.0, 0.5, 1.0])
@pytest.mark.parametrize("standardization", [True, False])
def test_fits_equal_those_of_spark(data, reg, net, standardization):
    (own,) = gram.grams(data.train, F.lit(1)).values()
    weights, intercept = own.fit(reg, net, standardization=standardization)
    parameters = {"reg_param": reg, "elastic_net_param": net, "standardization": standardization, "tol": 1e-12, "max_iter": 1000}
    model = ml.estimator("linear_regression", parameters).fit(data.train)
    assert weights == pytest.approx(model.coefficients.toArray(), rel=1e-4, abs=1e-5)
    assert intercept == pytest.approx(model.intercept, rel=1e-4)
    got = own.errors(model.coefficients.toArray(), model.intercept)
    assert got["rmse"] == pytest.approx(model.summary.rootMeanSquaredError, rel=1e-8)
    assert got["r2"] == pytest.approx(model.summary.r2, rel=1e-8)


def test_slices_add_up_and_tuning_equals_fits(data):
    folds = prep.expanding_folds(data.train_rows, 4)
    space = {"reg_param": [0.0, 0.5], "elastic_net_param": [0.0, 0.5]}
    settings = ml.SETTINGS["linear_regression"]
    fast = {str(r.parameters): r for r in ml.tune(data, "linear_regression", folds, space=space)}
    slow = {str(r.parameters): r for r in ml._tune_by_fits(data, "linear_regression", folds, ml.param_grid(space), settings, "rmse", 2)}
    assert fast.keys() == slow.keys()
    for key, r in fast.items():
        assert r.fold_scores == pytest.approx(slow[key].fold_scores, rel=1e-4)
    by_mae = ml.tune(data, "linear_regression", folds, space={"reg_param": [0.0]}, metric="mae")
    assert len(by_mae[0].fold_scores) == 3


def test_constant_and_dependent_columns(spark):
    rows = [(float(i), 2.0 * i, 7.0, 3.0 * i + 1) for i in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double")
    df = df.withColumn("features", array_to_vector(F.array("a", "b", "c")))
    (own,) = gram.grams(df, F.lit(1)).values()
    weights, intercept = own.fit()
    assert weights[2] == 0 and own.errors(weights, intercept)["rmse"] == pytest.approx(0, abs=1e-6)
    flat = gram.grams(df.withColumn("label", F.lit(4.0)), F.lit(1))[1].fit()
    assert flat[0].tolist() == [0, 0, 0] and flat[1] == pytest.approx(4)
    assert gram.grams(df.where("false"), F.lit(1)) == {}


def test_one_fit_for_every_series(spark):
    rows = [(["a", "b", None][k % 3], k % 2, float(k), (k % 3 + 1) * k + (k % 2) * 10.0) for k in range(90)] + [("one", 0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "meter string, part int, x double, label double").withColumn("features", array_to_vector(F.array("x")))
    fits = gram.fit_by_series(df, ["meter", "part"])
    found = {(r["meter"], r["part"]): (r["n"], r["coefficients"][0], r["intercept"]) for r in fits.collect()}
    assert len(found) == 7 and found["one", 0] == (1, 0.0, 5.0)
    for (meter, part), (n, slope, intercept) in found.items():
        if meter != "one":
            k = {"a": 0, "b": 1, None: 2}[meter]
            assert (n, slope, intercept) == (15, pytest.approx(k + 1), pytest.approx(part * 10.0, abs=1e-9))
    predicted = gram.predict_by_series(df.where("meter IS NOT NULL"), fits, ["meter", "part"])
    assert predicted.where("abs(prediction - label) > 1e-6").count() == 0
    assert gram.predict_by_series(df.where("meter = 'a'"), fits.where("part = 0"), ["meter", "part"]).where("prediction IS NULL").count() == 15
