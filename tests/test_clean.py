import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.operators import clean
from loadlens.operators.ordered import order_rows
from loadlens.operators.quantiles import exact_quantiles

SCHEMA = "id long, Global_active_power double"


def frame(spark, values, column="Global_active_power"):
    return spark.createDataFrame(list(enumerate(values)), f"id long, {column} double")


def column(df, name="Global_active_power"):
    return [r[name] for r in df.orderBy("id").collect()]


def test_leading_nulls_become_zero(spark):
    ordered = order_rows(frame(spark, [None, None, 2.0, None]), ["id"])
    filled = clean.fill_zero(clean.forward_fill(ordered).df)
    assert column(filled) == [0.0, 0.0, 2.0, 2.0]


def test_clamp_keeps_voltage_and_nulls(spark):
    df = frame(spark, [-1.0, None, 3.0]).withColumn("Voltage", F.lit(-2.0))
    clamped = clean.clamp_negative(df)
    assert column(clamped) == [0.0, None, 3.0]
    assert column(clamped, "Voltage") == [-2.0] * 3


def test_text_that_is_no_number_becomes_null(spark):
    df = spark.createDataFrame([(0, "1.5"), (1, "?"), (2, None), (3, "x1")], "id long, Voltage string")
    assert column(clean.cast_numeric(df), "Voltage") == [1.5, None, None, None]


def test_zero_iqr(spark):
    df = frame(spark, [0.0] * 9 + [5.0])
    bounds = clean.iqr_bounds(df)
    assert bounds == {"Global_active_power": (0.0, 0.0)}
    assert column(clean.cap_outliers(df, bounds)) == [0.0] * 10
    assert column(clean.cap_outliers(df, bounds, skip_zero_iqr=True)) == [0.0] * 9 + [5.0]


def test_lower_fence_is_floored_by_name(spark):
    assert clean.iqr_bounds(frame(spark, [1.0, 2.0, 3.0, 4.0]))["Global_active_power"][0] == 0.0
    assert clean.iqr_bounds(frame(spark, [1.0, 2.0, 3.0, 4.0], "Voltage"))["Voltage"][0] == pytest.approx(-0.5)


def test_approximate_bounds(spark):
    df = frame(spark, [float(i) for i in range(1000)])
    low, high = clean.iqr_bounds(df, relative_error=0.01)["Global_active_power"]
    assert low == 0.0 and high == pytest.approx(1498.5, abs=60)


def test_column_without_values_has_no_fence(spark):
    assert clean.iqr_bounds(frame(spark, [None, None])) == {}


@pytest.mark.parametrize("limit", [10, 100_000])
@pytest.mark.parametrize("kind", ["spread", "hot", "two", "constant", "tiny"])
def test_exact_quantiles(spark, kind, limit):
    rng = random.Random(5)
    values = {
        "spread": [rng.gauss(0, 10) for _ in range(3000)],
        # a third of the rows hold one value
        "hot": [7.25] * 1000 + [rng.uniform(0, 20) for _ in range(2000)],
        "two": [1.0] * 1500 + [2.0] * 1500,
        "constant": [4.0] * 500,
        "tiny": [3.0, 1.0],
    }[kind]
    rng.shuffle(values)
    df = frame(spark, [*values, None, None])
    probabilities = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["Global_active_power"], probabilities, limit)["Global_active_power"]
    assert got == pytest.approx(np.quantile(values, probabilities).tolist(), abs=1e-12)
