"""Compare the chunked series operators with one window over all rows at growing sizes.

usage: python tools/scale_check.py [sf_dir] [copies ...]

The readings are repeated with their time moved on by 30 days per copy, so the series
stays one series. Both plans write to the noop sink; sums of the results must agree.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from loadlens.operators import features  # noqa: E402
from loadlens.operators.ordered import carry_forward, order_rows, row_frames  # noqa: E402
from loadlens.plans.fixtures import meter  # noqa: E402
from tools.check import session  # noqa: E402

P = "Global_active_power"
ORDER = ["obs_ts", "event_id"]


def repeated(spark, sf_dir, copies):
    base = meter(spark, sf_dir).select("event_id", "obs_ts", P)
    moved = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    at = F.col("obs_ts") + F.make_dt_interval(days=F.col("copy") * 30)
    return moved.select("event_id", at.alias("obs_ts"), P)


def timed(frame):
    started = time.perf_counter()
    made = frame()
    made.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started, made


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.1"
    spark = session()
    everything = Window.orderBy(*ORDER)
    for copies in [int(a) for a in args] or [1, 10]:
        df = repeated(spark, sf_dir, copies)
        cases = {
            "forward fill": (
                lambda: df.withColumn(P, F.last(P, ignorenulls=True).over(everything.rowsBetween(Window.unboundedPreceding, 0))),
                lambda: carry_forward(order_rows(df, ORDER), [P]).df,
            ),
            "lags 1..60": (
                lambda: df.withColumns(features.lag_columns(everything, P, features.LAGS)),
                lambda: features.add_lags(order_rows(df, ORDER)).df,
            ),
            "rolling 60": (
                lambda: df.withColumns(features.rolling_columns(everything, P, 60)),
                lambda: row_frames(order_rows(df, ORDER), lambda w: features.rolling_columns(w, P, 60), 60).df,
            ),
        }
        for name, (naive, chunked) in cases.items():
            one, a = timed(naive)
            many, b = timed(chunked)
            last = a.columns[-1]
            sums = [x.agg(F.round(F.sum(last), 3), F.count(last)).first() for x in (a, b)]
            agree = "same" if sums[0] == sums[1] else f"DIFFER {sums}"
            print(f"rows={df.count():>9} {name:14s} one window {one:7.1f}s  chunked {many:7.1f}s  {agree}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
