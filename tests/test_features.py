import statistics

from pyspark.sql import functions as F

from loadlens.functions.calendar import calendar_columns, season_name, season_order, text_timestamp
from loadlens.functions.tariff import time_of_use_price
from loadlens.operators import energy, features
from loadlens.operators.ordered import order_rows

P = "Global_active_power"


def ordered(spark, values):
    return order_rows(spark.createDataFrame(list(enumerate(values)), f"id long, {P} double"), ["id"])


def rows(result, *columns):
    return [tuple(r) for r in result.df.orderBy("id").select(*columns).collect()]


def test_rolling_head(spark):
    got = rows(features.add_rolling(ordered(spark, [1.0, 3.0, 8.0]), 15), f"{P}_Rolling_15_Mean", f"{P}_Rolling_15_Std")
    assert got == [(None, None), (1.0, None), (2.0, statistics.stdev([1.0, 3.0]))]


def test_midrange_is_not_the_median(spark):
    series = ordered(spark, [1.0, 2.0, 9.0, 4.0])
    assert rows(features.add_rolling(series, 15), f"{P}_Rolling_15_Median")[-1] == (5.0,)
    assert rows(features.add_rolling_median(series, 15), f"{P}_Rolling_15_True_Median")[-1] == (2.0,)


def test_smoother_takes_the_current_row(spark):
    got = rows(features.add_smoothed(ordered(spark, [2.0, 4.0, 9.0]), [P], 2), f"{P}_Smooth_2")
    assert got == [(2.0,), (3.0,), (6.5,)]


def test_zero_power_gives_zero_ratios(spark):
    row = {P: 0.0, "Global_reactive_power": 1.0, "Global_intensity": 2.0}
    row |= {f"Sub_metering_{i}": 1.0 for i in (1, 2, 3)}
    got = features.add_electrical(spark.createDataFrame([row])).first().asDict()
    ratios = [v for k, v in got.items() if k.endswith("_Ratio")]
    assert ratios == [0.0] * 6 and got["Sub_metering_Remainder"] == -3.0


def test_calendar_edges(spark):
    times = [("2007-12-15 18:00:00",), ("2008-01-06 22:59:00",), ("2008-03-01 23:00:00",)]
    df = spark.createDataFrame(times, "t string").select(F.col("t").cast("timestamp").alias("t"))
    got = df.select(*[c.alias(n) for n, c in calendar_columns(F.col("t")).items()]).collect()
    assert [r["Season"] for r in got] == [1, 1, 2]
    assert [r["Is_Peak_Hour"] for r in got] == [1, 1, 0]
    assert [r["IsWeekend"] for r in got] == [1, 1, 1]  # Saturday, Sunday, Saturday
    assert [r["DayOfWeek"] for r in got] == [7, 1, 7]


def test_text_timestamp(spark):
    df = spark.createDataFrame([("1/2/2007", "3:04:05"), ("16/12/2006", "17:24:00"), ("no", "date")], "d string, t string")
    got = df.select(text_timestamp(F.col("d"), F.col("t")).cast("string").alias("x")).collect()
    assert [r["x"] for r in got] == ["2007-02-01 03:04:05", "2006-12-16 17:24:00", None]


def test_tariff_bounds(spark):
    hours = [5, 6, 13, 14, 19, 20, 21, 22]
    df = spark.createDataFrame([(h,) for h in hours], "h int")
    got = [r[0] for r in df.select(time_of_use_price(F.col("h"))).collect()]
    assert got == [0.10, 0.15, 0.15, 0.25, 0.25, 0.15, 0.15, 0.10]


def _readings(spark, *times):
    rows = [(t, 60.0, 30.0) for t in times]
    df = spark.createDataFrame(rows, f"t string, {P} double, Global_reactive_power double")
    return df.withColumn("Timestamp", F.col("t").cast("timestamp"))


def test_weeks_start_on_thursday_or_monday(spark):
    df = _readings(spark, "2024-01-01 00:00:00")
    start = energy.windowed_energy(df, "1 week").select(F.col("Window_Start").cast("string")).first()[0]
    assert start == "2023-12-28 00:00:00"
    monday = energy.windowed_energy(df, "1 week", start_time="4 days")
    assert monday.select(F.col("Window_Start").cast("string")).first()[0] == "2024-01-01 00:00:00"


def test_energy_and_carbon(spark):
    row = energy.windowed_energy(_readings(spark, "2024-01-01 00:10:00", "2024-01-01 00:20:00"), "1 hour").first()
    assert row[f"Energy_{P}"] == 2.0
    assert row["Energy_Global_reactive_power"] == 1.0
    assert row["Carbon_Emission_kgCO2"] == 1.0


def test_december_season(spark):
    df = _readings(spark, "2007-12-15 00:00:00")
    assert energy.seasonal_energy(df).select("Year", "Season").first() == (2007, "Winter")
    assert energy.seasonal_energy(df, meteorological_year=True).select("Year", "Season").first() == (2008, "Winter")


def test_season_order(spark):
    df = spark.createDataFrame([(m,) for m in (1, 4, 7, 10)], "m int")
    got = [tuple(r) for r in df.select(season_name(F.col("m")), season_order(season_name(F.col("m")))).collect()]
    assert got == [("Winter", 3), ("Spring", 0), ("Summer", 1), ("Fall", 2)]


def test_windowed_energy_works_on_a_stream(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df = _readings(spark, "2024-01-01 00:10:00", "2024-01-01 01:20:00", "2024-01-03 00:00:00").drop("t")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source).withWatermark("Timestamp", "10 minutes")
    query = (
        energy.windowed_energy(stream, "1 hour")
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    assert spark.read.parquet(sink).count() == 2  # the last window is still open


def test_day_lag_holds_no_day_in_a_task(spark):
    given = [("a", i, float(i)) for i in range(40)] + [("b", i, None if i == 3 else -float(i)) for i in range(30)] + [(None, 0, 7.0)]
    df = spark.createDataFrame(given, f"meter string, id long, {P} double")
    got = features.add_day_lag(order_rows(df, ["id"], ["meter"]), P, 25).df
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(r["meter"], r["id"]): r[f"{P}_Lag_25"] for r in got.collect()}
    values = {(m, i): v for m, i, v in given}
    assert found == {(m, i): values.get((m, i - 25)) for m, i, _ in given}
