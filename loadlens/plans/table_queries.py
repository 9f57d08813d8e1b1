"""Source, sink and data-quality queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from loadlens.functions.calendar import text_timestamp
from loadlens.operators import energy as en
from loadlens.operators import quality
from loadlens.operators.ordered import RN
from loadlens.operators.ranking import rank_candidates, with_failed
from loadlens.plans import household
from loadlens.plans.energy_queries import KWH, SEASON_NAME, clean_meter
from loadlens.plans.fixtures import METER_COLUMNS, candidates, failed_candidates, meter, predictions, raw_text, table
from loadlens.plans.ranking_queries import RANKED_SQL
from loadlens.plans.registry import query, rounded
from loadlens.plans.series_queries import (
    ALL_FEATURES_SQL,
    CAP,
    CLEAN_METER,
    CLEANED_TEXT,
    FLOAT_FEATURES,
    _each,
    all_features,
)
from loadlens.sources import readings as rd
from loadlens.sources import tables
from loadlens.sources.experiments import save_candidates
from loadlens.sources.shared import shared_path

TEXT_CELLS = ", ".join(["Date", "Time", *[f"NULLIF({c}, '?') AS {c}" for c in METER_COLUMNS]])


def raw_file(spark, sf_dir):
    """The text readings written as a delimited file."""
    path = shared_path(spark, "raw")
    raw_text(spark, sf_dir).write.option("sep", rd.DELIMITER).option("header", True).csv(path)
    return path


def raw_readings(spark, sf_dir):
    return rd.read_readings(spark, raw_file(spark, sf_dir))


@query("src_raw_readings", f"SELECT {TEXT_CELLS} FROM raw", ("meter", "raw"))
def src_raw_readings(spark, sf_dir):
    return raw_readings(spark, sf_dir)


@query(
    "src_corrupt_rows",
    """SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE event_type IN ('error', 'view')) AS malformed,
 COUNT(*) AS with_Date FROM events""",
)
def src_corrupt_rows(spark, sf_dir):
    return rd.malformed_count(malformed_readings(spark, sf_dir))


def malformed_readings(spark, sf_dir):
    """Readings written with too few or too many fields for two kinds of events."""
    path = shared_path(spark, "malformed")
    cells = [F.date_format("ts", "d/M/yyyy"), F.date_format("ts", "H:m:s"), *[F.col("value").cast("string")] * 7]
    line = (
        F.when(F.col("event_type") == "error", F.concat_ws(";", *cells[:2]))
        .when(F.col("event_type") == "view", F.concat_ws(";", *cells, cells[-1]))
        .otherwise(F.concat_ws(";", *cells))
    )
    lines = table(spark, sf_dir, "events").select(line.alias(";".join(rd.RAW_COLUMNS)))
    # plain text with the column names as first line of each file
    lines.write.option("header", True).option("quote", "").option("sep", "\t").csv(path)
    return rd.read_readings(spark, path, keep_corrupt=True)


@query(
    "dq_malformed_check",
    """SELECT 'malformed_rows' AS "check", CAST(COUNT(*) FILTER (WHERE event_type IN ('error', 'view')) AS VARCHAR) AS observed,
 '0' AS threshold, 'WARN' AS status FROM events""",
)
def dq_malformed_check(spark, sf_dir):
    report = quality.validation_report(malformed_readings(spark, sf_dir))
    return report.where("check = 'malformed_rows'").select("check", "observed", "threshold", "status")


@query(
    "snk_features_roundtrip",
    f"WITH {CLEAN_METER} SELECT event_id, obs_ts, {_each('{c}')}, {ALL_FEATURES_SQL} FROM readings",
    ("meter",),
)
def snk_features_roundtrip(spark, sf_dir):
    base = shared_path(spark, "features")
    tables.save_features(all_features(spark, sf_dir).df.drop(RN), base)
    return rounded(tables.load_features(spark, base), *FLOAT_FEATURES)


@query(
    "snk_predictions_roundtrip",
    """SELECT Task, Model, 'v1' AS version, obs_ts AS Timestamp, ROUND(Actual, 9) AS Actual,
 ROUND(Predicted, 9) AS Predicted FROM pred""",
    ("pred",),
)
def snk_predictions_roundtrip(spark, sf_dir):
    base = shared_path(spark, "predictions")
    made = predictions(spark, sf_dir).select(F.col("obs_ts").alias("Timestamp"), "Actual", "Predicted", "Task", "Model")
    tables.save_predictions(made, base)
    return rounded(tables.load_predictions(spark, base), "Actual", "Predicted")


PERIODS = ("hourly", "daily", "weekly", "monthly", "seasonal")
_SUMS = """ROUND(SUM(Global_active_power)/60e0, 9) AS Energy_Global_active_power,
 ROUND(SUM(Global_reactive_power)/60e0, 9) AS Energy_Global_reactive_power,
 ROUND(SUM(Global_active_power)/60e0*0.5e0, 9) AS Carbon_Emission_kgCO2"""
# weeks count from the epoch, a Thursday
_WEEK = "date_trunc('day', {ts}) - INTERVAL 1 DAY*(date_diff('day', TIMESTAMP '1970-01-01', {ts}) % 7)"


def _every_period(source: str, ts: str = "obs_ts") -> str:
    """All energy tables of ``source`` under one another."""
    windows = {
        "hourly": (f"date_trunc('hour', {ts})", "1 hour"), "daily": (f"date_trunc('day', {ts})", "1 day"), "weekly": (_WEEK.format(ts=ts), "7 days"),
    }
    parts = [
        f"SELECT '{name}' AS period, {start} AS Window_Start, {start} + INTERVAL '{width}' AS Window_End, {_SUMS} FROM {source} GROUP BY ALL"
        for name, (start, width) in windows.items()
    ]
    year, season = f"CAST(year({ts}) AS INTEGER) AS Year", SEASON_NAME.replace("obs_ts", ts)
    parts.append(f"SELECT 'monthly' AS period, {year}, CAST(month({ts}) AS INTEGER) AS Month, {_SUMS} FROM {source} GROUP BY ALL")
    parts.append(f"SELECT 'seasonal' AS period, {year}, {season} AS Season, {_SUMS} FROM {source} GROUP BY ALL")
    return " UNION ALL BY NAME ".join(f"({p})" for p in parts)


def every_period(frames):
    """The tables under one another; windows, months and seasons are null where a period has none."""
    named = [frames[name].withColumn("period", F.lit(name)) for name in PERIODS]
    return rounded(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named), *KWH)


@query("snk_energy_roundtrip", f"WITH {CLEAN_METER} SELECT * FROM ({_every_period('readings')})", ("meter",))
def snk_energy_roundtrip(spark, sf_dir):
    base = shared_path(spark, "energy")
    tables.save_aggregates(en.energy_tables(clean_meter(spark, sf_dir), ts="obs_ts"), base)
    return every_period({name: tables.load_aggregate(spark, base, name) for name in PERIODS})


@query(
    "snk_candidate_metrics",
    f"""WITH {RANKED_SQL}
SELECT task_name, model_name, rmse, mae, r2, ROUND(composite_score, 9) AS composite_score, rank, is_selected,
 FALSE AS failed, CAST(NULL AS VARCHAR) AS error FROM ranked
UNION ALL SELECT task_name, model_name, NULL, NULL, NULL, NULL, NULL, NULL, TRUE, error FROM failed""",
    ("cand", "failed"),
)
def snk_candidate_metrics(spark, sf_dir):
    path = shared_path(spark, "candidates")
    ranked = rank_candidates(candidates(spark, sf_dir))
    save_candidates(with_failed(ranked, failed_candidates(spark, sf_dir)), path)
    back = spark.read.parquet(path).select(
        "task_name", "model_name", "rmse", "mae", "r2", "composite_score", "rank", "is_selected", "failed", "error"
    )
    return rounded(back, "composite_score")


@query(
    "snk_flat_report",
    f"""WITH {RANKED_SQL}, formats AS (SELECT unnest(['json', 'csv', 'parquet']) AS format)
SELECT format, task_name, model_name, rank, ROUND(rmse, 9) AS rmse, ROUND(composite_score, 9) AS composite_score
FROM ranked CROSS JOIN formats""",
    ("cand",),
)
def snk_flat_report(spark, sf_dir):
    ranked = rank_candidates(candidates(spark, sf_dir))
    report = rounded(ranked.select("task_name", "model_name", "rank", "rmse", "composite_score"), "composite_score")
    base = shared_path(spark, "report")
    paths = tables.save_flat_report(report, base, ("json", "csv", "parquet"))
    read = [
        tables.load_flat_report(spark, path, kind, report.schema).withColumn("format", F.lit(kind))
        for kind, path in paths.items()
    ]
    return read[0].unionByName(read[1]).unionByName(read[2])


# ---------------------------------------------------------------- data quality


@query(
    "dq_row_count",
    """SELECT COUNT(*) AS row_count, 10 AS column_count, CASE WHEN COUNT(*) > 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM meter""",
    ("meter",),
)
def dq_row_count(spark, sf_dir):
    return quality.row_count(meter(spark, sf_dir))


@query(
    "dq_castable",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL)
 AS not_castable, CASE WHEN COUNT(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) > 0
 THEN 'WARN' ELSE 'PASS' END AS status FROM raw"""
        for c in METER_COLUMNS
    ),
    ("meter", "raw"),
)
def dq_castable(spark, sf_dir):
    return quality.castable(raw_text(spark, sf_dir), METER_COLUMNS)


NULL_COLUMNS = ["event_id", "series_id", "obs_ts", *METER_COLUMNS]


def _null_sql(column: str) -> str:
    share = f"((COUNT(*) - COUNT({column}))*100e0/COUNT(*))"
    return f"""SELECT '{column}' AS column_name, COUNT(*) - COUNT({column}) AS null_count,
 ROUND({share}, 4) AS null_percentage, 5e0 AS threshold,
 CASE WHEN {share} > 5 THEN 'FAIL' WHEN {share} > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM meter"""


@query("dq_null_pct", "\nUNION ALL ".join(_null_sql(c) for c in NULL_COLUMNS), ("meter",))
def dq_null_pct(spark, sf_dir):
    return quality.null_percentages(meter(spark, sf_dir))


@query(
    "dq_empty_columns",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT({c}) = 0 AS is_empty,
 CASE WHEN COUNT({c}) = 0 THEN 'WARN' ELSE 'PASS' END AS status FROM m"""
        for c in ["event_id", "Voltage", "Nothing"]
    ).replace("SELECT", "WITH m AS (SELECT event_id, Voltage, NULL AS Nothing FROM meter) SELECT", 1),
    ("meter",),
)
def dq_empty_columns(spark, sf_dir):
    readings = meter(spark, sf_dir).select("event_id", "Voltage", F.lit(None).cast("double").alias("Nothing"))
    return quality.empty_columns(readings)


RAW_NAMES = ["Date", "Time", *METER_COLUMNS]


def _report_sql() -> str:
    parts = [
        """SELECT 'row_count' AS "check", CAST(NULL AS VARCHAR) AS column_name, CAST(COUNT(*) AS VARCHAR) AS observed,
 '1' AS threshold, CASE WHEN COUNT(*) > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM text""",
        "SELECT 'delimiter', NULL, '9', '9', 'PASS'",
    ]
    for c in RAW_NAMES:
        kind = "string" if c in ("Date", "Time") else "numeric"
        parts.append(f"SELECT 'required_column', '{c}', 'present', NULL, 'PASS'")
        parts.append(f"SELECT 'type', '{c}', 'string', '{kind}', '{'PASS' if kind == 'string' else 'WARN'}'")
        share = f"((COUNT(*) - COUNT({c}))*100e0/COUNT(*))"
        parts.append(
            f"""SELECT 'null_percentage', '{c}', CAST(ROUND({share}, 4) AS VARCHAR), '5.0',
 CASE WHEN {share} > 5 THEN 'FAIL' WHEN {share} > 0 THEN 'WARN' ELSE 'PASS' END FROM text"""
        )
        parts.append(
            f"""SELECT 'empty_column', '{c}', CAST(COUNT(*) - COUNT({c}) AS VARCHAR), NULL,
 CASE WHEN COUNT({c}) = 0 THEN 'WARN' ELSE 'PASS' END FROM text"""
        )
    return "\nUNION ALL ".join(parts)


TEXT = f"text AS (SELECT {TEXT_CELLS} FROM raw)"


@query("dq_report", f"WITH {TEXT} {_report_sql()}", ("meter", "raw"))
def dq_report(spark, sf_dir):
    return quality.validation_report(raw_readings(spark, sf_dir))


@query(
    "dq_schema_report",
    f"""WITH {TEXT}, report AS ({_report_sql()})
SELECT * FROM report WHERE "check" IN ('row_count', 'required_column', 'delimiter', 'type')""",
    ("meter", "raw"),
)
def dq_schema_report(spark, sf_dir):
    report = quality.validation_report(raw_readings(spark, sf_dir))
    schema = ["row_count", "required_column", "extra_column", "duplicate_column", "delimiter", "type"]
    return report.where(F.col("check").isin(schema))


@query(
    "dq_overall",
    f"""WITH {TEXT}, report AS ({_report_sql()})
SELECT CASE WHEN COUNT(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAILED'
 WHEN COUNT(*) FILTER (WHERE status = 'WARN') > 0 THEN 'PASSED_WITH_WARNINGS' ELSE 'PASSED' END AS status,
 COUNT(*) FILTER (WHERE status = 'FAIL') AS error_count, COUNT(*) FILTER (WHERE status = 'WARN') AS warning_count
FROM report""",
    ("meter", "raw"),
)
def dq_overall(spark, sf_dir):
    return quality.overall_status(quality.validation_report(raw_readings(spark, sf_dir)))


@query(
    "dq_dataset_summary",
    f"""SELECT COUNT(*) AS records, MIN(obs_ts) AS first_timestamp, MAX(obs_ts) AS last_timestamp,
 7 AS feature_count,
 ROUND((7*COUNT(*) - ({" + ".join(f"COUNT({c})" for c in METER_COLUMNS)}))*100e0/(7*COUNT(*)), 4) AS missing_percentage
FROM meter""",
    ("meter",),
)
def dq_dataset_summary(spark, sf_dir):
    return quality.dataset_summary(meter(spark, sf_dir), METER_COLUMNS, "obs_ts")


@query(
    "flow_file_to_energy",
    f"""WITH {CLEANED_TEXT}, capped AS (SELECT obs_ts, {_each(CAP.replace("ROUND(", "(").replace(", 9)", ")"))} FROM zeroed)
SELECT * FROM ({_every_period("capped")})""",
    ("meter", "raw"),
)
def flow_file_to_energy(spark, sf_dir):
    options = household.Options(quantile_error=0.0)
    readings = household.cleaned(household.read_valid(spark, raw_file(spark, sf_dir), options), options)
    return every_period(en.energy_tables(readings.df))


@query(
    "src_read_and_parse",
    f"""WITH {TEXT} SELECT strptime(Date || ' ' || Time, '%d/%m/%Y %H:%M:%S') AS Timestamp,
 {_each('TRY_CAST({c} AS DOUBLE) AS {c}')} FROM text""",
    ("meter", "raw"),
)
def src_read_and_parse(spark, sf_dir):
    from loadlens.operators.clean import cast_numeric

    typed = cast_numeric(raw_readings(spark, sf_dir))
    return typed.select(text_timestamp(F.col("Date"), F.col("Time")).alias("Timestamp"), *METER_COLUMNS)
