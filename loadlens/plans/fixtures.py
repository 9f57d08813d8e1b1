"""Views that shape the given tables like meter readings, predictions and candidates.

Each view is one portable SELECT: Spark runs it over the loaded table, the oracle
queries embed the same text as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METER_COLUMNS = [
    "Global_active_power",
    "Global_reactive_power",
    "Voltage",
    "Global_intensity",
    "Sub_metering_1",
    "Sub_metering_2",
    "Sub_metering_3",
]

METER = """
SELECT event_id, event_type AS series_id, CAST(ts AS TIMESTAMP) AS obs_ts,
 CASE WHEN event_id % 80 = 3 THEN NULL WHEN event_id % 97 = 5 THEN -value/50e0 ELSE value/50e0 END AS Global_active_power,
 CASE WHEN event_id % 80 = 3 THEN NULL ELSE (event_id % 13)/20e0 END AS Global_reactive_power,
 CASE WHEN event_id % 80 = 3 THEN NULL ELSE 240e0 + (event_id % 21 - 10)/2e0 END AS Voltage,
 CASE WHEN event_id % 80 = 3 THEN NULL ELSE value/12e0 END AS Global_intensity,
 CASE WHEN event_id % 80 = 3 THEN NULL ELSE CAST(event_id % 3 AS DOUBLE) END AS Sub_metering_1,
 CASE WHEN event_id % 80 = 3 THEN NULL ELSE CAST(event_id % 5 AS DOUBLE) END AS Sub_metering_2,
 CASE WHEN event_id % 80 = 3 THEN NULL ELSE CAST(event_id % 17 AS DOUBLE) END AS Sub_metering_3
FROM events
"""

PRED = """
SELECT p.Task, p.Model, p.obs_ts, p.event_id, p.Actual, p.Predicted FROM (
 SELECT event_type AS Task, 'm_bias' AS Model, CAST(ts AS TIMESTAMP) AS obs_ts, event_id, value AS Actual, value*1.05e0 + 0.5e0 AS Predicted FROM events
 UNION ALL SELECT event_type, 'm_noise', CAST(ts AS TIMESTAMP), event_id, value, value + (event_id % 11 - 5) FROM events
 UNION ALL SELECT event_type, 'm_mean', CAST(ts AS TIMESTAMP), event_id, value, 50e0 FROM events) p
"""

CAND = """
SELECT event_type AS task_name, CONCAT('model_', CAST(user_id % 4 AS VARCHAR(4))) AS model_name,
 ROUND(STDDEV_SAMP(value),6) AS rmse, ROUND(AVG(value),6) AS mae, ROUND(1e0/AVG(value+1e0),6) AS r2,
 COUNT(*)/100e0 AS training_time, COUNT(DISTINCT user_id)/100e0 AS prediction_time,
 CASE WHEN user_id % 4 = 3 THEN NULL ELSE CAST(MAX(user_id) AS DOUBLE) END AS memory_usage_mb,
 1e0*MIN(user_id % 4) AS cpu_usage_pct
FROM events GROUP BY event_type, user_id % 4
"""

RUNS = """
SELECT event_type AS task_name, CONCAT('exp_', CAST(CAST(ts AS DATE) AS VARCHAR(10))) AS experiment_id,
 MAX(CAST(ts AS TIMESTAMP)) AS timestamp_max, CONCAT('model_', CAST(user_id % 4 AS VARCHAR(4))) AS model_name,
 ROUND(MAX(value),6) AS rmse, ROUND(MIN(value),6) AS mae, ROUND(1e0/(MAX(value)+1e0),6) AS r2,
 COUNT(*)/100e0 AS training_time, COUNT(DISTINCT user_id)/100e0 AS prediction_time,
 CAST(MAX(user_id) AS DOUBLE) AS memory_usage_mb, 1e0*MIN(user_id % 4) AS cpu_usage_pct
FROM events GROUP BY event_type, CAST(ts AS DATE), user_id % 4
"""

FAILED = """
SELECT event_type AS task_name, CONCAT('model_failed_', CAST(user_id % 2 AS VARCHAR(4))) AS model_name,
 CONCAT('no result in ', CAST(COUNT(*) AS VARCHAR(20)), ' rows') AS error
FROM events GROUP BY event_type, user_id % 2
"""

SHIPMENTS = """
SELECT CAST(l_shipdate AS TIMESTAMP) AS obs_ts, l_quantity AS Global_active_power,
 l_discount AS Global_reactive_power
FROM lineitem
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables; the session works in UTC like the stored times."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    frame = table(spark, sf_dir, source)
    return spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=frame)


def meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with missing rows and some negative power; ``series_id`` is optional."""
    return _view(spark, sf_dir, METER, "events")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three predictors per task; ``(Task, Model, obs_ts, event_id)`` is unique."""
    return _view(spark, sf_dir, PRED, "events")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of four candidate models per task, memory missing for one of them."""
    return _view(spark, sf_dir, CAND, "events")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one experiment per task and day."""
    return _view(spark, sf_dir, RUNS, "events").withColumnRenamed("timestamp_max", "timestamp")


def failed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that failed, with their error."""
    return _view(spark, sf_dir, FAILED, "events")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-year dates with a quantity standing for power."""
    return _view(spark, sf_dir, SHIPMENTS, "lineitem")


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as text: date, time and seven values, ``?`` where a value is missing."""
    frame = meter(spark, sf_dir)

    # six decimals: the readings end earlier or never, so no value lies halfway
    def text(name: str):
        exact = F.col(name).cast(T.DecimalType(18, 6)).cast("string")
        return F.coalesce(exact, F.lit("?")).alias(name)

    return frame.select(
        F.date_format("obs_ts", "d/M/yyyy").alias("Date"),
        F.date_format("obs_ts", "H:m:s").alias("Time"),
        *[text(c) for c in METER_COLUMNS],
    )


RAW = """
SELECT strftime(obs_ts, '%-d/%-m/%Y') AS Date, strftime(obs_ts, '%-H:%-M:%-S') AS Time,
{cells}
FROM meter
""".format(
    cells=",\n".join(
        f" COALESCE(CAST(CAST({c} AS DECIMAL(18,6)) AS VARCHAR), '?') AS {c}" for c in METER_COLUMNS
    )
)

CTE = {"meter": METER, "pred": PRED, "cand": CAND, "ship": SHIPMENTS, "runs": RUNS, "failed": FAILED}


def with_views(sql: str, *views: str) -> str:
    """Prefix an oracle query with the views it reads."""
    parts = []
    for view in views:
        if view == "raw":
            parts.append(f"raw AS ({RAW})")
        else:
            parts.append(f"{view} AS ({CTE[view]})")
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
