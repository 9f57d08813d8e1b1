"""Chunked operators against one window over everything."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loadlens.operators import ordered as od

START = datetime(2024, 1, 1)


def readings(spark, rows=400, seed=1, series=("a", "b", "c", None), hot="a"):
    """Irregular times with ties, a series with most of the rows and long runs of nulls."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        name = hot if rng.random() < 0.6 else rng.choice(series)
        at = START + timedelta(minutes=rng.randrange(rows // 3))
        value = None if rng.random() < 0.4 or 100 < i < 180 else round(rng.uniform(-5, 50), 2)
        data.append((i, name, at, value))
    return spark.createDataFrame(data, "id long, series string, ts timestamp, x double").repartition(5)


def values(df, *columns):
    return sorted(map(tuple, df.select("id", *columns).collect()))


@pytest.mark.parametrize("series", [[], ["series"]])
def test_position_is_the_row_number(spark, small_chunks, series):
    df = readings(spark)
    got = od.order_rows(df, ["ts", "id"], series)
    assert got.total == 400
    window = Window.orderBy(*series, "ts", "id")
    want = df.withColumn(od.RN, F.row_number().over(window).cast("long") - 1)
    assert values(got.df, od.RN) == values(want, od.RN)
    placed = od.series_position(got, "at")
    by_series = Window.partitionBy(*series).orderBy("ts", "id")
    assert values(placed.df, "at") == values(df.withColumn("at", F.row_number().over(by_series).cast("long") - 1), "at")


@pytest.mark.parametrize("series", [[], ["series"]])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_carry_forward(spark, small_chunks, series, seed):
    df = readings(spark, seed=seed)
    got = od.carry_forward(od.order_rows(df, ["ts", "id"], series), ["x"])
    window = Window.partitionBy(*series).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("x", F.last("x", ignorenulls=True).over(window))
    assert values(got.df, "x") == values(want, "x")


@pytest.mark.parametrize("series", [[], ["series"]])
def test_running_total(spark, small_chunks, series):
    df = readings(spark).withColumn("w", F.col("id") % 5)
    got = od.running_total(od.order_rows(df, ["ts", "id"], series), {"through": F.col("w")})
    window = Window.partitionBy(*series).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert values(got.df, "through") == values(df.withColumn("through", F.sum("w").over(window)), "through")


@pytest.mark.parametrize("series", [[], ["series"]])
@pytest.mark.parametrize("reach", [1, 5, 30])
def test_row_frames(spark, small_chunks, series, reach):
    df = readings(spark)

    def build(window):
        frame = window.rowsBetween(-reach, -1)
        return {
            "before": F.lag("x", reach).over(window),
            "top": F.max("x").over(frame),
            "n": F.count("x").over(frame),
        }

    got = od.row_frames(od.order_rows(df, ["ts", "id"], series), build, reach)
    want = df.withColumns(build(Window.partitionBy(*series).orderBy("ts", "id")))
    assert values(got.df, "before", "top", "n") == values(want, "before", "top", "n")


def test_one_timestamp_for_all_rows(spark, small_chunks):
    df = readings(spark).withColumn("ts", F.lit(START)).withColumn("series", F.lit("a"))
    got = od.carry_forward(od.order_rows(df, ["ts", "id"], ["series"]), ["x"])
    window = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    assert values(got.df, "x") == values(df.withColumn("x", F.last("x", ignorenulls=True).over(window)), "x")
    # one series and one time still fill several sorted partitions with evenly many rows
    parts = got.df.groupBy(F.expr(f"{od.RN} div 50")).count().collect()
    assert len(parts) == 8


def test_empty_and_single_row(spark):
    empty = od.order_rows(readings(spark).where("id < 0"), ["ts", "id"])
    assert empty.total == 0 and od.carry_forward(empty, ["x"]).df.count() == 0
    single = od.order_rows(readings(spark).where("id = 3"), ["ts", "id"], ["series"])
    assert single.total == 1 and od.series_position(single, "at").df.first()["at"] == 0


def test_chunk_sizes_are_bounded(spark):
    df = readings(spark)
    assert od.OrderedRows(df, 10**12).chunk_rows() * od.MAX_CHUNKS >= 10**12
    assert od.OrderedRows(df, 10**8).chunk_rows() == od.CHUNK_ROWS
    assert od.OrderedRows(df, 50).chunk_rows(1440) >= 1440


def test_only_summaries_meet_in_one_task(spark):
    """Without series keys a window over everything would need a single partition."""
    got = od.carry_forward(od.order_rows(readings(spark), ["ts", "id"]), ["x"])
    plan = got.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1  # chunk ends only
    assert "CartesianProduct" not in plan
    framed = od.row_frames(
        od.order_rows(readings(spark), ["ts", "id"]), lambda w: {"l": F.lag("x", 1).over(w)}, 1
    )
    assert "SinglePartition" not in framed.df._jdf.queryExecution().executedPlan().toString()


def test_starts_of_the_sorted_parts_need_no_python_workers(spark):
    rows = od.order_rows(spark.range(1000, numPartitions=4).select((-F.col("id")).alias("t")), ["t"])
    plan = rows.df._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
    assert [r[od.RN] for r in rows.df.orderBy("t").collect()] == list(range(1000))
