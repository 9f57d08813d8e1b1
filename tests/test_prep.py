import pytest
from pyspark.sql import functions as F

from loadlens.operators import prep
from loadlens.operators.ordered import RN, order_rows


def ordered(spark, rows):
    return order_rows(spark.range(rows).withColumn("s", F.when(F.col("id") < 7, "a").otherwise("b")), ["id"])


@pytest.mark.parametrize("ratio", [0, 1, -0.1])
def test_bad_ratio(spark, ratio):
    with pytest.raises(ValueError):
        prep.temporal_split(ordered(spark, 10), ratio)


def test_split_sizes(spark):
    train, test = prep.temporal_split(ordered(spark, 10), 0.2)
    assert [r["id"] for r in train.orderBy("id").collect()] == list(range(8))
    assert test.count() == 2


def test_split_per_series(spark):
    df = spark.range(12).withColumn("s", F.when(F.col("id") < 2, None).when(F.col("id") < 7, "a").otherwise("b"))
    marked = prep.mark_split(order_rows(df, ["id"], ["s"]), 0.4)
    assert sorted(r["id"] for r in marked.where("split = 'train'").collect()) == [0, 2, 3, 4, 7, 8, 9]
    assert marked.count() == 12


def test_folds_of_nine_rows():
    assert prep.expanding_folds(9, 3) == [prep.Fold(1, (0, 3), (3, 6)), prep.Fold(2, (0, 6), (6, 9))]
    compat = prep.expanding_folds(9, 3, reference_compat=True)
    assert prep.cut_points(9, 3, reference_compat=True) == [0, 2, 5, 8]
    assert [(f.train[1], f.validation[1] - f.validation[0]) for f in compat] == [(2, 3), (5, 3)]


def test_rolling_folds():
    assert len(prep.rolling_folds(100, 5)) == 1
    assert len(prep.rolling_folds(100, 5, width=2)) == 3
    assert len(prep.rolling_folds(100, 5, width=2, reference_compat=True)) == 1
    with pytest.raises(ValueError):
        prep.rolling_folds(100, 5, width=5)


def test_chronological_fold():
    assert prep.chronological_folds(10, 5) == [prep.Fold(1, (0, 8), (8, 10))]
    assert prep.chronological_folds(100, 3, val_ratio=0.15) == [prep.Fold(1, (0, 85), (85, 100))]


def test_mark_folds_covers_every_row(spark):
    marked = prep.mark_folds(ordered(spark, 10), prep.expanding_folds(10, 3))
    got = {(r["fold"], r["role"]): r["n"] for r in marked.groupBy("fold", "role").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, "train"): 3, (1, "validation"): 3, (2, "train"): 6, (2, "validation"): 4}


def test_tail_and_head(spark):
    rows = ordered(spark, 10)
    train, test = prep.tail_holdout(rows, 3)
    assert (train.count(), test.count()) == (7, 3)
    assert prep.skip_head(rows, 4).agg(F.min(RN)).first()[0] == 4


def test_feature_sets():
    full, safe = prep.tasks(), prep.tasks("leak_free")
    assert [len(t.features) for t in full.values()] == [41, 25, 25, 25]
    assert "Total_Power_Wh" not in safe["Global_active_power"].features
    assert all(t.target not in t.features for t in full.values())


def test_missing_column(spark):
    with pytest.raises(ValueError, match="missing columns"):
        prep.task_projection(spark.range(1), prep.tasks()["Sub_metering_1"])
