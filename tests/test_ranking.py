import pytest
from pyspark.sql import functions as F

from loadlens.operators import chartdata as ch
from loadlens.operators import ranking as rk
from loadlens.sources import experiments as ex

SCHEMA = (
    "task_name string, model_name string, rmse double, mae double, r2 double, training_time double, "
    "prediction_time double, memory_usage_mb double, cpu_usage_pct double"
)
NAN = float("nan")


def table(spark, *rows):
    return spark.createDataFrame([("t", *r) for r in rows], SCHEMA)


def ranks(df):
    return {r["model_name"]: r["rank"] for r in df.collect()}


def test_equal_metrics_are_all_best(spark):
    got = rk.normalise(table(spark, ("a", 2.0, 1.0, 0.5, 1.0, 1.0, None, None), ("b", 2.0, 3.0, 0.7, 1.0, 1.0, 5.0, None)))
    rows = {r["model_name"]: r for r in got.collect()}
    assert [rows[m]["normalised_rmse"] for m in "ab"] == [0.0, 0.0]
    assert [rows[m]["normalised_r2_penalty"] for m in "ab"] == [1.0, 0.0]
    assert [rows[m]["normalised_memory_mb"] for m in "ab"] == [0.0, 1.0]
    assert [rows[m]["normalised_cpu_pct"] for m in "ab"] == [0.0, 0.0]


def test_nan_is_worst(spark):
    same = (1.0, 1.0, 1.0, 1.0, 1.0, 1.0)
    df = table(spark, ("a", NAN, *same), ("b", 2.0, *same), ("c", 1.0, *same))
    got = rk.rank_candidates(df)
    assert ranks(got) == {"c": 1, "b": 2, "a": 3}
    assert {r["model_name"]: r["normalised_rmse"] for r in got.collect()} == {"a": 1.0, "b": 1.0, "c": 0.0}
    only = rk.normalise(table(spark, ("a", NAN, *same)))
    assert only.first()["normalised_rmse"] == 1.0


def scored(spark, *rows):
    made = table(spark, *[(m, rmse, 1.0, 1.0, 1.0, time, None, None) for m, rmse, time, _ in rows])
    scores = F.create_map(*[F.lit(x) for m, _, _, s in rows for x in (m, s)])
    return made.withColumn("composite_score", scores[F.col("model_name")])


def test_ties_fall_to_rmse_then_time_then_name(spark):
    df = scored(spark, ("a", 3.0, 1.0, 0.5), ("b", 2.0, 1.0, 0.5 + 2e-7), ("c", 2.0, 0.5, 0.5), ("d", 9.0, 1.0, 0.4))
    assert ranks(rk.rank(df)) == {"d": 1, "c": 2, "b": 3, "a": 4}
    assert ranks(rk.rank(df, tolerance=0)) == {"d": 1, "c": 2, "a": 3, "b": 4}


def test_weights_are_checked():
    for weights in rk.PROFILES.values():
        rk.check_weights(weights)
    with pytest.raises(ValueError, match="missing"):
        rk.check_weights({"rmse": 1.0})
    with pytest.raises(ValueError, match="sum"):
        rk.check_weights({**rk.PROFILES["balanced"], "rmse": 0.4})


def test_failed_candidates_stay_unranked(spark):
    ranked = rk.rank_candidates(table(spark, ("a", 1.0, 1.0, 1.0, 1.0, 1.0, None, None)))
    failed = spark.createDataFrame([("t", "z", "no rows")], "task_name string, model_name string, error string")
    rows = {r["model_name"]: r for r in rk.with_failed(ranked, failed).collect()}
    assert rows["z"]["failed"] and rows["z"]["rank"] is None and not rows["a"]["failed"]


def test_pareto(spark):
    made = table(
        spark,
        ("a", 5.0, 1.0, 1.0, 1.0, 1.0, None, None),
        ("b", 6.0, 1.0, 1.0, 2.0, 1.0, None, None),
        ("c", 4.0, 1.0, 1.0, 3.0, 1.0, None, None),
        ("d", 4.0, 1.0, 1.0, 4.0, 1.0, None, None),
    )
    assert {r["model_name"] for r in ch.pareto_frontier(made).collect()} == {"a", "c"}


def test_experiment_log(spark, tmp_path):
    path = str(tmp_path / "log")
    made = table(spark, ("a", 1.0, 1.0, 0.5, 1.0, 1.0, None, None), ("b", 2.0, 2.0, 0.4, 1.0, 1.0, None, None))
    for number in (1, 2, 3):
        run = made.withColumns(
            {
                "experiment_id": F.lit(f"e{number}"),
                "timestamp": F.lit(f"2024-01-0{number}").cast("timestamp"),
                "rmse": F.col("rmse") + number,
            }
        )
        failed = run.limit(1).select("task_name", "experiment_id", F.lit("z").alias("model_name"), F.lit("lost").alias("error"))
        ex.append_records(ex.experiment_records(rk.rank_candidates(run, group=("task_name", "experiment_id")), failed), path)
    log = ex.load_records(spark, path)
    assert log.count() == 3 and ex.keep_newest(log, 2).count() == 2
    latest = ex.latest_per_task(log)
    assert [r["experiment_id"] for r in latest.collect()] == ["e3"]
    rows = ex.explode_candidates(latest).orderBy("rank").collect()
    assert [(r["model_name"], r["rmse"], r["rank"]) for r in rows] == [("a", 4.0, 1), ("b", 5.0, 2)]
    assert latest.first()["failed_candidates"][0]["error"] == "lost"
