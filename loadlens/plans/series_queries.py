"""Cleaning, feature, split and fold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.functions.calendar import text_timestamp
from loadlens.operators import clean, features, prep
from loadlens.operators.ordered import RN, order_rows
from loadlens.plans.energy_queries import clean_meter
from loadlens.plans.fixtures import METER_COLUMNS, meter, raw_text
from loadlens.plans.registry import query, rounded

ORDER = ["obs_ts", "event_id"]
KEYS = ["event_id", "obs_ts"]


def ordered_meter(spark, sf_dir, *columns, series=()):
    """The cleaned readings in order, with the named columns only."""
    picked = clean_meter(spark, sf_dir).select(*series, *KEYS, *columns)
    return order_rows(picked, ORDER, series)


def _each(template: str, columns=METER_COLUMNS) -> str:
    return ",\n ".join(template.format(c=c) for c in columns)


# ---------------------------------------------------------------- cleaning


@query(
    "cln_cast",
    f"SELECT Date, Time, {_each('TRY_CAST({c} AS DOUBLE) AS {c}')} FROM raw",
    ("meter", "raw"),
)
def cln_cast(spark, sf_dir):
    return clean.cast_numeric(raw_text(spark, sf_dir))


@query("cln_dedupe", "SELECT DISTINCT * FROM (SELECT * FROM meter UNION ALL SELECT * FROM meter) t", ("meter",))
def cln_dedupe(spark, sf_dir):
    readings = meter(spark, sf_dir)
    return clean.drop_duplicate_rows(readings.unionByName(readings))


FILL = "LAST_VALUE({c} IGNORE NULLS) OVER (ORDER BY obs_ts, event_id ROWS UNBOUNDED PRECEDING) AS {c}"


@query("cln_ffill", f"SELECT event_id, obs_ts, {_each(FILL)} FROM meter", ("meter",))
def cln_ffill(spark, sf_dir):
    ordered = order_rows(meter(spark, sf_dir).drop("series_id"), ORDER)
    return clean.forward_fill(ordered).df.drop(RN)


FILL_SERIES = FILL.replace("(ORDER", "(PARTITION BY series_id ORDER")


@query("cln_ffill_by_series", f"SELECT series_id, event_id, obs_ts, {_each(FILL_SERIES)} FROM meter", ("meter",))
def cln_ffill_by_series(spark, sf_dir):
    ordered = order_rows(meter(spark, sf_dir), ORDER, ["series_id"])
    return clean.forward_fill(ordered).df.drop(RN)


@query(
    "cln_ffill_zero",
    f"""WITH f AS (SELECT event_id, obs_ts, {_each(FILL)} FROM meter)
SELECT event_id, obs_ts, {_each('COALESCE({c}, 0e0) AS {c}')} FROM f""",
    ("meter",),
)
def cln_ffill_zero(spark, sf_dir):
    ordered = order_rows(meter(spark, sf_dir).drop("series_id"), ORDER)
    return clean.fill_zero(clean.forward_fill(ordered).df).drop(RN)


UNSIGNED = [c for c in METER_COLUMNS if c != "Voltage"]


@query(
    "cln_clamp_negative",
    f"SELECT event_id, Voltage, {_each('CASE WHEN {c} < 0 THEN 0e0 ELSE {c} END AS {c}', UNSIGNED)} FROM meter",
    ("meter",),
)
def cln_clamp_negative(spark, sf_dir):
    return clean.clamp_negative(meter(spark, sf_dir).select("event_id", *METER_COLUMNS))


def _fences(source: str) -> str:
    """Exact fences of all columns of ``source``, one row each."""
    parts = []
    for c in METER_COLUMNS:
        low = f"quantile_cont({c}, 0.25) - 1.5e0*(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"
        high = f"quantile_cont({c}, 0.75) + 1.5e0*(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"
        if "power" in c or "metering" in c:
            low = f"GREATEST(0e0, {low})"
        parts.append(f"SELECT '{c}' AS name, {low} AS lower_bound, {high} AS upper_bound FROM {source}")
    return "\nUNION ALL ".join(parts)


ZEROED = f"zeroed AS (SELECT event_id, {_each('GREATEST(COALESCE({c}, 0e0), 0e0) AS {c}')} FROM meter)"


@query(
    "cln_iqr_bounds",
    f"""WITH {ZEROED}, fences AS ({_fences('zeroed')})
SELECT name AS column_name, ROUND(lower_bound, 9) AS lower_bound, ROUND(upper_bound, 9) AS upper_bound FROM fences""",
    ("meter",),
)
def cln_iqr_bounds(spark, sf_dir):
    bounds = clean.iqr_bounds(clean_meter(spark, sf_dir))
    rows = [(name, low, high) for name, (low, high) in bounds.items()]
    table = spark.createDataFrame(rows, "column_name string, lower_bound double, upper_bound double")
    return rounded(table, "lower_bound", "upper_bound")


CAP = """ROUND(LEAST(GREATEST({c}, (SELECT lower_bound FROM fences WHERE name = '{c}')),
  (SELECT upper_bound FROM fences WHERE name = '{c}')), 9) AS {c}"""


@query(
    "cln_iqr_cap",
    f"WITH {ZEROED}, fences AS ({_fences('zeroed')}) SELECT event_id, {_each(CAP)} FROM zeroed",
    ("meter",),
)
def cln_iqr_cap(spark, sf_dir):
    readings = clean_meter(spark, sf_dir).select("event_id", *METER_COLUMNS)
    return rounded(clean.cap_outliers(readings, clean.iqr_bounds(readings)), *METER_COLUMNS)


TEXT_FILL = FILL.replace(
    "ORDER BY obs_ts, event_id",
    "ORDER BY obs_ts, " + ", ".join(f"{c} NULLS FIRST" for c in METER_COLUMNS),
)


CLEANED_TEXT = f"""typed AS (SELECT DISTINCT Date, Time, {_each('TRY_CAST({c} AS DOUBLE) AS {c}')} FROM raw),
stamped AS (SELECT strptime(Date || ' ' || Time, '%d/%m/%Y %H:%M:%S') AS obs_ts, {_each('{c}')} FROM typed),
filled AS (SELECT obs_ts, {_each(TEXT_FILL)} FROM stamped),
zeroed AS (SELECT obs_ts, Voltage0 AS Voltage, {_each('GREATEST(COALESCE({c}, 0e0), 0e0) AS {c}', UNSIGNED)}
 FROM (SELECT *, COALESCE(Voltage, 0e0) AS Voltage0 FROM filled) z),
fences AS ({_fences('zeroed')})"""


@query(
    "cln_full",
    f"WITH {CLEANED_TEXT} SELECT obs_ts AS Timestamp, {_each(CAP)} FROM zeroed",
    ("meter", "raw"),
)
def cln_full(spark, sf_dir):
    typed = clean.drop_duplicate_rows(clean.cast_numeric(raw_text(spark, sf_dir)))
    stamped = typed.select(text_timestamp(F.col("Date"), F.col("Time")).alias("Timestamp"), *METER_COLUMNS)
    # rows are distinct, so time and readings together are a unique order
    cleaned = clean.clean_rows(order_rows(stamped, ["Timestamp", *METER_COLUMNS]))
    return rounded(cleaned.df.drop(RN), *METER_COLUMNS)


# ---------------------------------------------------------------- features

POWER = "Global_active_power"
CLEAN_METER = f"readings AS (SELECT series_id, event_id, obs_ts, {_each('GREATEST(COALESCE({c}, 0e0), 0e0) AS {c}')} FROM meter)"

CYCLICAL_SQL = """ROUND(SIN(2*pi()*hour(obs_ts)/24), 9) AS Hour_sin, ROUND(COS(2*pi()*hour(obs_ts)/24), 9) AS Hour_cos,
 ROUND(SIN(2*pi()*month(obs_ts)/12), 9) AS Month_sin, ROUND(COS(2*pi()*month(obs_ts)/12), 9) AS Month_cos"""

TOTAL_WH = "(Global_active_power*1000/60e0)"
REST_WH = f"({TOTAL_WH} - (Sub_metering_1 + Sub_metering_2 + Sub_metering_3))"


def _share(part: str, whole: str) -> str:
    return f"ROUND(CASE WHEN {whole} > 0 THEN {part}/{whole} ELSE 0e0 END, 9)"


ELECTRICAL_SQL = f"""{_share('Global_reactive_power', POWER)} AS Reactive_Active_Ratio,
 {_share('Global_intensity', POWER)} AS Intensity_Active_Ratio,
 ROUND({TOTAL_WH}, 9) AS Total_Power_Wh,
 {_share('Sub_metering_1', TOTAL_WH)} AS Sub_metering_1_Ratio,
 {_share('Sub_metering_2', TOTAL_WH)} AS Sub_metering_2_Ratio,
 {_share('Sub_metering_3', TOTAL_WH)} AS Sub_metering_3_Ratio,
 ROUND({REST_WH}, 9) AS Sub_metering_Remainder,
 {_share(REST_WH, TOTAL_WH)} AS Sub_metering_Remainder_Ratio"""

CYCLICAL = ["Hour_sin", "Hour_cos", "Month_sin", "Month_cos"]


def _lag_sql(lags, over="ORDER BY obs_ts, event_id") -> str:
    return ",\n ".join(f"LAG({POWER}, {n}) OVER ({over}) AS {POWER}_Lag_{n}" for n in lags)


def _rolling_sql(n: int, over="ORDER BY obs_ts, event_id") -> str:
    frame = f"OVER ({over} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"""ROUND(AVG({POWER}) {frame}, 9) AS {POWER}_Rolling_{n}_Mean,
 ROUND(STDDEV_SAMP({POWER}) {frame}, 9) AS {POWER}_Rolling_{n}_Std,
 MAX({POWER}) {frame} AS {POWER}_Rolling_{n}_Max,
 MIN({POWER}) {frame} AS {POWER}_Rolling_{n}_Min,
 ROUND((MAX({POWER}) {frame} + MIN({POWER}) {frame})/2e0, 9) AS {POWER}_Rolling_{n}_Median"""


DIFF_SQL = f"ROUND({POWER} - LAG({POWER}, 1) OVER (ORDER BY obs_ts, event_id), 9) AS {POWER}_Diff_1"


def _moments(n: int) -> list[str]:
    return [f"{POWER}_Rolling_{n}_{s}" for s in ("Mean", "Std", "Median")]


@query("ft_cyclical", f"SELECT event_id, {CYCLICAL_SQL} FROM meter", ("meter",))
def ft_cyclical(spark, sf_dir):
    dated = features.add_calendar(meter(spark, sf_dir), "obs_ts")
    return rounded(features.add_cyclical(dated).select("event_id", *CYCLICAL), *CYCLICAL)


@query("ft_electrical", f"SELECT event_id, {ELECTRICAL_SQL} FROM meter", ("meter",))
def ft_electrical(spark, sf_dir):
    made = features.add_electrical(meter(spark, sf_dir)).select("event_id", *prep.RATIO_FEATURES)
    return rounded(made, *prep.RATIO_FEATURES)


def _meter_query(columns: str) -> str:
    return f"WITH {CLEAN_METER} SELECT event_id, obs_ts, {POWER}, {columns} FROM readings"


@query("ft_lags", _meter_query(_lag_sql(features.LAGS)), ("meter",))
def ft_lags(spark, sf_dir):
    return features.add_lags(ordered_meter(spark, sf_dir, POWER)).df.drop(RN)


@query(
    "ft_lags_by_series",
    f"""WITH {CLEAN_METER} SELECT series_id, event_id, obs_ts, {POWER},
 {_lag_sql(features.LAGS, 'PARTITION BY series_id ORDER BY obs_ts, event_id')} FROM readings""",
    ("meter",),
)
def ft_lags_by_series(spark, sf_dir):
    return features.add_lags(ordered_meter(spark, sf_dir, POWER, series=["series_id"])).df.drop(RN)


@query("ft_diff", _meter_query(DIFF_SQL), ("meter",))
def ft_diff(spark, sf_dir):
    made = features.add_difference(ordered_meter(spark, sf_dir, POWER)).df.drop(RN)
    return rounded(made, f"{POWER}_Diff_1")


@query("ft_rolling_15", _meter_query(_rolling_sql(15)), ("meter",))
def ft_rolling_15(spark, sf_dir):
    return rounded(features.add_rolling(ordered_meter(spark, sf_dir, POWER), 15).df.drop(RN), *_moments(15))


@query("ft_rolling_60", _meter_query(_rolling_sql(60)), ("meter",))
def ft_rolling_60(spark, sf_dir):
    return rounded(features.add_rolling(ordered_meter(spark, sf_dir, POWER), 60).df.drop(RN), *_moments(60))


@query(
    "ft_rolling_60_by_series",
    f"""WITH {CLEAN_METER} SELECT series_id, event_id, obs_ts, {POWER},
 {_rolling_sql(60, 'PARTITION BY series_id ORDER BY obs_ts, event_id')} FROM readings""",
    ("meter",),
)
def ft_rolling_60_by_series(spark, sf_dir):
    ordered = ordered_meter(spark, sf_dir, POWER, series=["series_id"])
    return rounded(features.add_rolling(ordered, 60).df.drop(RN), *_moments(60))


def _midrange_sql(n: int) -> str:
    frame = f"OVER (ORDER BY obs_ts, event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"ROUND((MAX({POWER}) {frame} + MIN({POWER}) {frame})/2e0, 9) AS {POWER}_Rolling_{n}_Median"


@query("ft_rolling_midrange", _meter_query(_midrange_sql(15)), ("meter",))
def ft_rolling_midrange(spark, sf_dir):
    name = f"{POWER}_Rolling_15_Median"
    made = features.add_rolling(ordered_meter(spark, sf_dir, POWER), 15).df
    return rounded(made.select(*KEYS, POWER, name), name)


@query(
    "ft_rolling_median",
    _meter_query(
        f"""ROUND(quantile_cont({POWER}, 0.5) OVER (ORDER BY obs_ts, event_id
 ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), 9) AS {POWER}_Rolling_15_True_Median"""
    ),
    ("meter",),
)
def ft_rolling_median(spark, sf_dir):
    made = features.add_rolling_median(ordered_meter(spark, sf_dir, POWER), 15).df.drop(RN)
    return rounded(made, f"{POWER}_Rolling_15_True_Median")


@query("ft_rolling_day", _meter_query(_rolling_sql(1440)), ("meter",))
def ft_rolling_day(spark, sf_dir):
    return rounded(features.add_rolling(ordered_meter(spark, sf_dir, POWER), 1440).df.drop(RN), *_moments(1440))


@query(
    "ft_rolling_day_by_series",
    f"""WITH {CLEAN_METER} SELECT series_id, event_id, obs_ts, {POWER},
 {_rolling_sql(300, 'PARTITION BY series_id ORDER BY obs_ts, event_id')} FROM readings""",
    ("meter",),
)
def ft_rolling_day_by_series(spark, sf_dir):
    ordered = ordered_meter(spark, sf_dir, POWER, series=["series_id"])
    return rounded(features.add_rolling(ordered, 300).df.drop(RN), *_moments(300))


@query(
    "ft_rolling_median_day",
    _meter_query(
        f"""ROUND(quantile_cont({POWER}, 0.5) OVER (ORDER BY obs_ts, event_id
 ROWS BETWEEN 1440 PRECEDING AND 1 PRECEDING), 9) AS {POWER}_Rolling_1440_True_Median"""
    ),
    ("meter",),
)
def ft_rolling_median_day(spark, sf_dir):
    made = features.add_rolling_median(ordered_meter(spark, sf_dir, POWER), 1440).df.drop(RN)
    return rounded(made, f"{POWER}_Rolling_1440_True_Median")


@query("ft_lag_day", _meter_query(_lag_sql([1440])), ("meter",))
def ft_lag_day(spark, sf_dir):
    return features.add_day_lag(ordered_meter(spark, sf_dir, POWER)).df.drop(RN)


@query(
    "ft_smooth_60",
    _meter_query(
        f"""ROUND(AVG({POWER}) OVER (ORDER BY obs_ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), 9)
 AS {POWER}_Smooth_60"""
    ),
    ("meter",),
)
def ft_smooth_60(spark, sf_dir):
    made = features.add_smoothed(ordered_meter(spark, sf_dir, POWER), [POWER]).df.drop(RN)
    return rounded(made, f"{POWER}_Smooth_60")


CALENDAR_SQL = """CAST(year(obs_ts) AS INTEGER) AS Year, CAST(hour(obs_ts) AS INTEGER) AS Hour,
 CAST(minute(obs_ts) AS INTEGER) AS Minute, CAST(day(obs_ts) AS INTEGER) AS Day,
 CAST(dayofweek(obs_ts) + 1 AS INTEGER) AS Weekday, CAST(dayofweek(obs_ts) + 1 AS INTEGER) AS DayOfWeek,
 CAST(month(obs_ts) AS INTEGER) AS Month, CAST(quarter(obs_ts) AS INTEGER) AS Quarter,
 CAST(month(obs_ts) % 12 // 3 + 1 AS INTEGER) AS Season,
 CAST(hour(obs_ts)*60 + minute(obs_ts) AS INTEGER) AS Minutes_Since_Midnight,
 CAST(CASE WHEN dayofweek(obs_ts) IN (0, 6) THEN 1 ELSE 0 END AS INTEGER) AS Is_Weekend,
 CAST(CASE WHEN dayofweek(obs_ts) IN (0, 6) THEN 1 ELSE 0 END AS INTEGER) AS IsWeekend,
 CAST(CASE WHEN hour(obs_ts) BETWEEN 18 AND 22 THEN 1 ELSE 0 END AS INTEGER) AS Is_Peak_Hour"""

ALL_FEATURES_SQL = f"""{CALENDAR_SQL}, {CYCLICAL_SQL}, {ELECTRICAL_SQL}, {_lag_sql(features.LAGS)}, {DIFF_SQL},
 {_rolling_sql(15)}, {_rolling_sql(60)}"""
FLOAT_FEATURES = CYCLICAL + prep.RATIO_FEATURES + [f"{POWER}_Diff_1"] + _moments(15) + _moments(60)


def all_features(spark, sf_dir):
    """Every feature of the cleaned readings, in order."""
    return features.add_features(ordered_meter(spark, sf_dir, *METER_COLUMNS), ts="obs_ts")


@query(
    "ft_all",
    f"WITH {CLEAN_METER} SELECT event_id, obs_ts, {_each('{c}')}, {ALL_FEATURES_SQL} FROM readings",
    ("meter",),
)
def ft_all(spark, sf_dir):
    return rounded(all_features(spark, sf_dir).df.drop(RN), *FLOAT_FEATURES)


# ---------------------------------------------------------------- data sets, splits, folds

TASK = prep.tasks()["Sub_metering_1"]
TASK_SELECT = ", ".join(TASK.features)


@query(
    "ds_task_projection",
    f"""WITH all_cols AS (SELECT *, {CALENDAR_SQL}, {CYCLICAL_SQL}, {ELECTRICAL_SQL} FROM meter)
SELECT event_id, obs_ts, {TASK_SELECT}, Sub_metering_1 FROM all_cols WHERE Sub_metering_1 IS NOT NULL""",
    ("meter",),
)
def ds_task_projection(spark, sf_dir):
    made = features.add_electrical(features.add_cyclical(features.add_calendar(meter(spark, sf_dir), "obs_ts")))
    picked = prep.task_projection(made, TASK, ts="obs_ts", keep=["event_id"])
    return rounded(picked, *CYCLICAL, *prep.RATIO_FEATURES)


ACTIVE = prep.tasks()["Global_active_power"]


@query(
    "ds_complete_cases",
    f"""WITH {CLEAN_METER}, all_cols AS (SELECT event_id, obs_ts, {_each('{c}')}, {ALL_FEATURES_SQL} FROM readings)
SELECT event_id, obs_ts, {", ".join(ACTIVE.features)}, {POWER}, {POWER} AS label FROM all_cols
WHERE {" AND ".join(f"{c} IS NOT NULL" for c in ACTIVE.features)} AND {POWER} IS NOT NULL""",
    ("meter",),
)
def ds_complete_cases(spark, sf_dir):
    picked = prep.task_projection(all_features(spark, sf_dir).df, ACTIVE, ts="obs_ts", keep=["event_id"])
    return rounded(prep.complete_cases(picked, ACTIVE), *FLOAT_FEATURES)


NUMBERED = """numbered AS (SELECT event_id, obs_ts, ROW_NUMBER() OVER (ORDER BY obs_ts, event_id) - 1 AS rn,
 COUNT(*) OVER () AS n FROM meter)"""


def ordered_keys(spark, sf_dir):
    return order_rows(meter(spark, sf_dir).select(*KEYS), ORDER)


@query(
    "ds_row_index",
    f"WITH {NUMBERED} SELECT event_id, obs_ts, rn FROM numbered",
    ("meter",),
)
def ds_row_index(spark, sf_dir):
    return ordered_keys(spark, sf_dir).df.withColumnRenamed(RN, "rn")


@query(
    "ds_split_temporal",
    f"""WITH {NUMBERED} SELECT event_id, obs_ts, CASE WHEN rn < FLOOR(n*0.8) THEN 'train' ELSE 'test' END AS split
FROM numbered""",
    ("meter",),
)
def ds_split_temporal(spark, sf_dir):
    return prep.mark_split(ordered_keys(spark, sf_dir)).drop(RN)


@query(
    "ds_split_by_series",
    """WITH numbered AS (SELECT series_id, event_id, obs_ts,
 ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY obs_ts, event_id) - 1 AS rn,
 COUNT(*) OVER (PARTITION BY series_id) AS n FROM meter)
SELECT series_id, event_id, obs_ts, CASE WHEN rn < FLOOR(n*0.8) THEN 'train' ELSE 'test' END AS split FROM numbered""",
    ("meter",),
)
def ds_split_by_series(spark, sf_dir):
    ordered = order_rows(meter(spark, sf_dir).select("series_id", *KEYS), ORDER, ["series_id"])
    return prep.mark_split(ordered).drop(RN)


@query(
    "ds_tail_holdout",
    f"""WITH {NUMBERED} SELECT event_id, obs_ts, CASE WHEN rn >= n - 1440 THEN 'test' ELSE 'train' END AS split
FROM numbered""",
    ("meter",),
)
def ds_tail_holdout(spark, sf_dir):
    train, test = prep.tail_holdout(ordered_keys(spark, sf_dir), 1440)
    marked = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return marked.drop(RN)


BY_SERIES = """numbered AS (SELECT series_id, event_id, obs_ts,
 ROW_NUMBER() OVER (PARTITION BY series_id ORDER BY obs_ts, event_id) - 1 AS rn,
 COUNT(*) OVER (PARTITION BY series_id) AS n FROM meter)"""


def ordered_by_series(spark, sf_dir):
    return order_rows(meter(spark, sf_dir).select("series_id", *KEYS), ORDER, ["series_id"])


@query(
    "ds_tail_holdout_by_series",
    f"""WITH {BY_SERIES} SELECT series_id, event_id, obs_ts, CASE WHEN rn >= n - 5 THEN 'test' ELSE 'train' END AS split
FROM numbered""",
    ("meter",),
)
def ds_tail_holdout_by_series(spark, sf_dir):
    train, test = prep.tail_holdout(ordered_by_series(spark, sf_dir), 5)
    marked = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return marked.drop(RN)


def _series_folds_sql(ranges: list[tuple[int, str, int, int]], slices: int) -> str:
    picked = [
        f"SELECT series_id, event_id, obs_ts, CAST({fold} AS INTEGER) AS fold, '{role}' AS role FROM numbered"
        f" WHERE n*{low}//{slices} <= rn AND rn < n*{high}//{slices}"
        for fold, role, low, high in ranges
    ]
    return f"WITH {BY_SERIES} " + " UNION ALL ".join(picked)


@query(
    "cv_expanding_by_series",
    _series_folds_sql([(1, "train", 0, 1), (1, "validation", 1, 2), (2, "train", 0, 2), (2, "validation", 2, 3)], 3),
    ("meter",),
)
def cv_expanding_by_series(spark, sf_dir):
    return prep.mark_folds(ordered_by_series(spark, sf_dir), prep.series_folds("expanding", 3)).drop(RN)


@query(
    "cv_rolling_by_series",
    _series_folds_sql([(k + 1, role, k + a, k + b) for k in range(3) for role, a, b in (("train", 0, 2), ("validation", 2, 3))], 5),
    ("meter",),
)
def cv_rolling_by_series(spark, sf_dir):
    return prep.mark_folds(ordered_by_series(spark, sf_dir), prep.series_folds("rolling", 5, width=2)).drop(RN)


@query("src_skip_rows", f"WITH {NUMBERED} SELECT event_id, obs_ts, rn FROM numbered WHERE rn >= 1900", ("meter",))
def src_skip_rows(spark, sf_dir):
    return prep.skip_head(ordered_keys(spark, sf_dir), 1900).withColumnRenamed(RN, "rn")


def _folds_sql(ranges: list[tuple[int, str, str, str]]) -> str:
    picked = [
        f"SELECT event_id, obs_ts, CAST({fold} AS INTEGER) AS fold, '{role}' AS role FROM numbered WHERE {low} <= rn AND rn < {high}"
        for fold, role, low, high in ranges
    ]
    return f"WITH {NUMBERED} " + "\nUNION ALL ".join(picked)


@query(
    "cv_chronological",
    _folds_sql([(1, "train", "0", "2*n//3"), (1, "validation", "2*n//3", "n")]),
    ("meter",),
)
def cv_chronological(spark, sf_dir):
    ordered = ordered_keys(spark, sf_dir)
    return prep.mark_folds(ordered, prep.chronological_folds(ordered.total)).drop(RN)


@query(
    "cv_expanding",
    _folds_sql(
        [
            (1, "train", "0", "n//3"),
            (1, "validation", "n//3", "2*n//3"),
            (2, "train", "0", "2*n//3"),
            (2, "validation", "2*n//3", "n"),
        ]
    ),
    ("meter",),
)
def cv_expanding(spark, sf_dir):
    ordered = ordered_keys(spark, sf_dir)
    return prep.mark_folds(ordered, prep.expanding_folds(ordered.total)).drop(RN)


@query(
    "cv_rolling",
    _folds_sql(
        [
            (1, "train", "0", "2*n//5"),
            (1, "validation", "2*n//5", "3*n//5"),
            (2, "train", "n//5", "3*n//5"),
            (2, "validation", "3*n//5", "4*n//5"),
            (3, "train", "2*n//5", "4*n//5"),
            (3, "validation", "4*n//5", "n"),
        ]
    ),
    ("meter",),
)
def cv_rolling(spark, sf_dir):
    ordered = ordered_keys(spark, sf_dir)
    return prep.mark_folds(ordered, prep.rolling_folds(ordered.total, 5, width=2)).drop(RN)


@query(
    "cv_cut_points",
    """WITH c AS (SELECT COUNT(*) AS n FROM meter)
SELECT CAST(s AS INTEGER) AS slice, s * n // 3 AS position FROM c, range(4) t(s)""",
    ("meter",),
)
def cv_cut_points(spark, sf_dir):
    return prep.cut_point_table(meter(spark, sf_dir))
