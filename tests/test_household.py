import os

import pytest
from pyspark.sql import functions as F

from loadlens.operators import models
from loadlens.operators.quality import ValidationError
from loadlens.plans import household
from loadlens.plans.table_queries import raw_file
from loadlens.sources import experiments, shared, tables
from loadlens.sources.shared import stage

SF_DIR = "/root/testdata/sf0.001"
QUICK = {
    "linear_regression": models.SETTINGS["linear_regression"],
    "decision_tree": {**models.SETTINGS["decision_tree"], "max_depth": 3},
    "random_forest": {"num_trees": -1},  # cannot be fitted
}


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
def test_run(spark, tmp_path):
    options = household.Options(model_settings=QUICK, tune=False, feature_set="leak_free")
    out = str(tmp_path / "out")
    raw = raw_file(spark, SF_DIR)
    left = os.path.join(shared.shared_dir(spark).removeprefix("file://"), "loadlens", spark.sparkContext.applicationId)
    before = set(os.listdir(left))
    written = household.run(spark, raw, out, "exp1", options)
    assert set(os.listdir(left)) == before  # also nothing of what threads have staged
    assert {"energy", "features", "predictions", "candidates", "experiments", "performance", "statistics"} <= set(written)
    hourly = tables.load_aggregate(spark, written["energy"], "hourly")
    assert hourly.count() > 0 and "Carbon_Emission_kgCO2" in hourly.columns
    assert len(tables.load_features(spark, f"{out}/features").columns) == 1 + 7 + 13 + 28 + 1
    candidates = spark.read.parquet(written["candidates"])
    assert candidates.where("failed").count() == 4
    assert candidates.where("is_selected").count() == 4
    record = experiments.latest_per_task(experiments.load_records(spark, written["experiments"], "Sub_metering_1")).first()
    assert record["selected_model"] in QUICK and record["failed_candidates"][0]["model_name"] == "random_forest"
    predicted = tables.load_predictions(spark, f"{out}/predictions", version="exp1")
    assert predicted.groupBy("Task", "Model").count().count() == 8
    records = models.model_records(spark, written["models"], "exp1")
    assert records.count() == 8 and records.where("is_selected").count() == 4
    winner = models.load_selected(spark, written["models"], "exp1", "Sub_metering_1")
    features = tables.load_features(spark, f"{out}/features")
    again = winner.transform(features).select("Timestamp", "prediction").join(
        predicted.where(F.col("Task") == "Sub_metering_1").join(
            records.where("is_selected").select(F.col("task").alias("Task"), F.col("model").alias("Model")), ["Task", "Model"]
        ), "Timestamp",
    )
    assert again.count() and again.where("abs(prediction - Predicted) > 1e-9").count() == 0
    with pytest.raises(ValueError, match="no selected model"):
        models.load_selected(spark, written["models"], "exp1", "nothing")
    assert spark.read.option("header", True).csv(written["validation"] + "/csv").where("status = 'FAIL'").count() == 0
    assert spark.read.parquet(written["importances"]).count() > 0
    # an experiment that runs again replaces its record
    records = experiments.load_records(spark, written["experiments"])
    experiments.append_records(stage(records, "again"), written["experiments"])
    assert experiments.load_records(spark, written["experiments"]).count() == 4
    tests = spark.read.option("header", True).csv(written["statistics"] + "/csv")
    assert tests.count() == 4 and tests.where(F.col("p_value") == "N/A").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
def test_tuning_takes_its_options(spark, tmp_path, monkeypatch):
    seen = []
    given = models.tune
    monkeypatch.setattr(models, "tune", lambda *a, **b: seen.append((a, b)) or given(*a, **b))
    options = household.Options(
        model_settings={"decision_tree": {"max_depth": 2, "seed": 1}}, feature_set="leak_free", validation_ratio=0.25, tuning_metric="mae",
        search_spaces={"decision_tree": {"max_depth": [1, 2, 3]}}, search_strategy="random_search", search_combinations=2, search_seed=5,
    )
    written = household.run(spark, raw_file(spark, SF_DIR), str(tmp_path / "out"), "exp2", options)
    assert spark.read.parquet(written["candidates"]).where("NOT failed").count() == 4
    for (data, _, folds), kept in seen:
        assert kept["metric"] == "mae" and (kept["strategy"], kept["combinations"], kept["seed"]) == ("random_search", 2, 5)
        (fold,) = folds
        assert fold.validation == (fold.train[1], data.train_rows) and fold.train[1] == data.train_rows * 3 // 4


def test_bad_file_is_refused(spark, tmp_path):
    path = tmp_path / "bad.txt"
    path.write_text("Date;Time;Global_active_power;Global_reactive_power;Voltage;Global_intensity;"
                    "Sub_metering_1;Sub_metering_2;Sub_metering_3\n1/1/2024;0:00:00;?;?;?;?;?;?;?\n")
    with pytest.raises(ValidationError, match="null_percentage Voltage"):
        household.read_valid(spark, str(path), household.Options())
