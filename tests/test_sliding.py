import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.operators import features, sliding
from loadlens.operators.ordered import order_rows


@pytest.mark.parametrize("rows", [1, 2, 7, 40, 500])
def test_windows_equal_taking_each_up_anew(rows):
    r = np.random.default_rng(rows)
    v = r.normal(1e6, 3, 200).round(1)
    v[r.random(200) < 0.2] = np.nan
    v[50:60] = np.nan
    v[100:140] = 1e6 + 7
    low, high = sliding.moving_extremes(v, rows)
    n, mean, deviation = sliding.moving_moments(v, rows)
    median = sliding.moving_median(v, rows)
    for i in range(len(v)):
        own = v[max(0, i - rows) : i]
        own = own[~np.isnan(own)]
        assert n[i] == len(own)
        if not len(own):
            assert np.isinf(low[i]) and np.isnan(mean[i]) and np.isnan(median[i]) and np.isnan(deviation[i])
            continue
        assert (low[i], high[i], median[i]) == (own.min(), own.max(), np.median(own))
        assert mean[i] == pytest.approx(own.mean(), rel=1e-12)
        assert np.isnan(deviation[i]) if len(own) == 1 else deviation[i] == pytest.approx(own.std(ddof=1), rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("series", [[], ["meter"]])
def test_slides_equal_frames(spark, small_chunks, monkeypatch, series):
    df = spark.range(150).select(
        (F.col("id") % 2).alias("meter"), F.timestamp_seconds("id").alias("Timestamp"),
        F.when(F.col("id") % 11 == 3, None).otherwise((F.col("id") * 37 % 101).cast("double")).alias("Global_active_power"),
    )
    ordered = order_rows(df, ["Timestamp"], series)

    def made(rows):
        found = features.add_rolling_median(features.add_rolling(ordered, rows), rows).df
        return {r["__rn"] if "__rn" in found.columns else (r["meter"], r["Timestamp"]): [None if x is None else round(x, 6) if isinstance(x, float) else x for x in r] for r in found.collect()}

    for rows in (1, 5, 30):
        monkeypatch.setattr(features, "FRAME_ROWS", 240)
        want = made(rows)
        monkeypatch.setattr(features, "FRAME_ROWS", 0)
        assert made(rows) == want
    empty = features.add_rolling(ordered.with_df(ordered.df.where("false")), 5).df
    assert empty.count() == 0
