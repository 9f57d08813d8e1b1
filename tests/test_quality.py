from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from loadlens.operators import quality
from loadlens.sources import readings as rd
from loadlens.sources import tables
from loadlens.sources.shared import shared_dir

HEADER = ";".join(rd.RAW_COLUMNS)
GOOD = "1/1/2024;0:00:00;1.0;0.1;240.0;4.0;0.0;1.0;17.0"


@pytest.fixture
def raw(spark, tmp_path):
    def write(*lines):
        path = tmp_path / "raw.txt"
        path.write_text("\n".join([HEADER, *lines]) + "\n")
        return str(path)

    return write


def test_malformed_row_is_padded_and_counted(spark, raw):
    path = raw(GOOD, "1/1/2024;0:01:00", GOOD + ";9", "1/1/2024;0:02:00;?;?;?;?;?;?;?")
    rows = rd.read_readings(spark, path).collect()
    assert len(rows) == 4 and rows[1]["Voltage"] is None and rows[3]["Voltage"] is None
    counted = rd.malformed_count(rd.read_readings(spark, path, keep_corrupt=True)).first()
    assert (counted["rows"], counted["malformed"]) == (4, 2)


def status(report, check, column=None):
    found = report.where(F.col("check") == check)
    if column:
        found = found.where(F.col("column_name") == column)
    return [r["status"] for r in found.collect()]


def test_report_of_good_text(spark, raw):
    report = quality.validation_report(rd.read_readings(spark, raw(GOOD)))
    assert status(report, "row_count") == ["PASS"] and status(report, "type", "Voltage") == ["WARN"]
    overall = quality.overall_status(report).first()
    assert (overall["status"], overall["error_count"], overall["warning_count"]) == ("PASSED_WITH_WARNINGS", 0, 7)
    quality.require_valid(report)


def test_report_of_bad_tables(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", None, 1.0)], "Date string, Voltage double, More double")
    report = quality.validation_report(df)
    assert status(report, "required_column", "Time") == ["FAIL"]
    assert status(report, "extra_column", "More") == ["INFO"]
    assert status(report, "delimiter") == ["FAIL"]
    assert status(report, "null_percentage", "Voltage") == ["FAIL"]
    assert status(report, "empty_column", "Voltage") == ["WARN"]
    assert quality.overall_status(report).first()["status"] == "FAILED"
    with pytest.raises(quality.ValidationError, match="required_column Time"):
        quality.require_valid(report)


def test_report_of_an_empty_table(spark):
    df = spark.createDataFrame([], ", ".join(f"{c} string" for c in rd.RAW_COLUMNS))
    report = quality.validation_report(df)
    assert status(report, "row_count") == ["FAIL"] and status(report, "null_percentage") == []
    assert quality.null_percentages(df).count() == 0


def test_repeated_column_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int").toDF("a", "a")
    assert status(quality.validation_report(df), "duplicate_column", "a") == ["WARN"]


def test_versions_are_guarded(spark, tmp_path):
    base = str(tmp_path / "features")
    tables.save_features(spark.range(3), base)
    with pytest.raises(Exception, match="already exists"):
        tables.save_features(spark.range(4), base)
    tables.save_features(spark.range(5), base, overwrite=True)
    assert tables.load_features(spark, base).count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load_features(spark, base, "v2")


def test_predictions_are_pruned_by_task_and_model(spark, tmp_path):
    base = str(tmp_path / "predictions")
    made = spark.createDataFrame(
        [("2024-01-01", 1.0, 2.0, t, m) for t in "ab" for m in "xy"],
        "Timestamp string, Actual double, Predicted double, Task string, Model string",
    ).withColumn("Timestamp", F.col("Timestamp").cast("timestamp"))
    tables.save_predictions(made, base)
    found = tables.load_predictions(spark, base, "a", "y")
    assert found.count() == 1 and set(found.columns) == {*made.columns, "version"}
    assert "PartitionFilters: [isnotnull(Task" in found._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="already exists"):
        tables.save_predictions(made, base)


def session_like(master, folder):
    conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_shared_dir_follows_the_session():
    assert shared_dir(session_like("yarn", "/shared/folder/")) == "/shared/folder"
    assert shared_dir(session_like("local[2]", "/shared/folder")) == "/shared/folder"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session_like("yarn", None))  # never a folder of one machine on a cluster
