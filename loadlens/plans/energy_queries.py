"""Calendar, energy, carbon and tariff queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadlens.functions.calendar import calendar_columns, text_timestamp
from loadlens.operators import energy as en
from loadlens.operators.clean import clamp_negative, fill_zero
from loadlens.plans.fixtures import METER_COLUMNS, meter, raw_text, shipments
from loadlens.plans.registry import query, rounded

KWH = ["Energy_Global_active_power", "Energy_Global_reactive_power", "Carbon_Emission_kgCO2"]


def clean_meter(spark, sf_dir):
    """Readings with missing values as 0 and negative power clamped."""
    filled = fill_zero(meter(spark, sf_dir), METER_COLUMNS)
    return clamp_negative(filled, METER_COLUMNS)


def hourly(spark, sf_dir):
    return en.windowed_energy(clean_meter(spark, sf_dir), "1 hour", ts="obs_ts")


CLEAN = """power AS (SELECT obs_ts,
 GREATEST(COALESCE(Global_active_power, 0e0), 0e0) AS gap,
 GREATEST(COALESCE(Global_reactive_power, 0e0), 0e0) AS grp FROM meter)"""

HOURLY = CLEAN + """,
hourly AS (SELECT date_trunc('hour', obs_ts) AS ws, SUM(gap)/60e0 AS e, SUM(grp)/60e0 AS r,
 SUM(gap)/60e0*0.5e0 AS c FROM power GROUP BY 1)"""


def _windowed(bucket: str, width: str) -> str:
    return f"""
WITH {CLEAN}, w AS (SELECT {bucket} AS ws, gap, grp FROM power)
SELECT ws AS Window_Start, ws + INTERVAL '{width}' AS Window_End,
 ROUND(SUM(gap)/60e0, 9) AS Energy_Global_active_power,
 ROUND(SUM(grp)/60e0, 9) AS Energy_Global_reactive_power,
 ROUND(SUM(gap)/60e0*0.5e0, 9) AS Carbon_Emission_kgCO2
FROM w GROUP BY ws"""


@query("en_hourly", _windowed("date_trunc('hour', obs_ts)", "1 hour"), ("meter",))
def en_hourly(spark, sf_dir):
    return rounded(hourly(spark, sf_dir), *KWH)


@query("en_daily", _windowed("date_trunc('day', obs_ts)", "1 day"), ("meter",))
def en_daily(spark, sf_dir):
    return rounded(en.windowed_energy(clean_meter(spark, sf_dir), "1 day", ts="obs_ts"), *KWH)


@query(
    "en_weekly",
    _windowed("time_bucket(INTERVAL '7 days', obs_ts, TIMESTAMP '1970-01-01')", "7 days"),
    ("meter",),
)
def en_weekly(spark, sf_dir):
    return rounded(en.windowed_energy(clean_meter(spark, sf_dir), "1 week", ts="obs_ts"), *KWH)


@query("en_weekly_monday", _windowed("date_trunc('week', obs_ts)", "7 days"), ("meter",))
def en_weekly_monday(spark, sf_dir):
    weekly = en.windowed_energy(clean_meter(spark, sf_dir), "1 week", ts="obs_ts", start_time="4 days")
    return rounded(weekly, *KWH)


@query(
    "en_hourly_by_series",
    """
SELECT series_id, date_trunc('hour', obs_ts) AS Window_Start,
 date_trunc('hour', obs_ts) + INTERVAL '1 hour' AS Window_End,
 ROUND(SUM(GREATEST(COALESCE(Global_active_power, 0e0), 0e0))/60e0, 9) AS Energy_Global_active_power,
 ROUND(SUM(GREATEST(COALESCE(Global_reactive_power, 0e0), 0e0))/60e0, 9) AS Energy_Global_reactive_power,
 ROUND(SUM(GREATEST(COALESCE(Global_active_power, 0e0), 0e0))/60e0*0.5e0, 9) AS Carbon_Emission_kgCO2
FROM meter GROUP BY 1, 2""",
    ("meter",),
)
def en_hourly_by_series(spark, sf_dir):
    by_series = en.windowed_energy(clean_meter(spark, sf_dir), "1 hour", ts="obs_ts", series=["series_id"])
    return rounded(by_series, *KWH)


SHIP_SUMS = """ROUND(SUM(Global_active_power)/60e0, 9) AS Energy_Global_active_power,
 ROUND(SUM(Global_reactive_power)/60e0, 9) AS Energy_Global_reactive_power,
 ROUND(SUM(Global_active_power)/60e0*0.5e0, 9) AS Carbon_Emission_kgCO2"""

SEASON_NAME = """CASE WHEN month(obs_ts) IN (12, 1, 2) THEN 'Winter' WHEN month(obs_ts) IN (3, 4, 5) THEN 'Spring'
 WHEN month(obs_ts) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END"""


@query(
    "en_monthly",
    f"""SELECT CAST(year(obs_ts) AS INTEGER) AS Year, CAST(month(obs_ts) AS INTEGER) AS Month, {SHIP_SUMS}
FROM ship GROUP BY 1, 2""",
    ("ship",),
)
def en_monthly(spark, sf_dir):
    return rounded(en.monthly_energy(shipments(spark, sf_dir), ts="obs_ts"), *KWH)


@query(
    "en_seasonal",
    f"""SELECT CAST(year(obs_ts) AS INTEGER) AS Year, {SEASON_NAME} AS Season, {SHIP_SUMS}
FROM ship GROUP BY 1, 2""",
    ("ship",),
)
def en_seasonal(spark, sf_dir):
    return rounded(en.seasonal_energy(shipments(spark, sf_dir), ts="obs_ts"), *KWH)


@query(
    "en_seasonal_meteorological",
    f"""SELECT CAST(CASE WHEN month(obs_ts) = 12 THEN year(obs_ts) + 1 ELSE year(obs_ts) END AS INTEGER) AS Year,
 {SEASON_NAME} AS Season, {SHIP_SUMS} FROM ship GROUP BY 1, 2""",
    ("ship",),
)
def en_seasonal_meteorological(spark, sf_dir):
    seasonal = en.seasonal_energy(shipments(spark, sf_dir), ts="obs_ts", meteorological_year=True)
    return rounded(seasonal, *KWH)


@query(
    "en_monthly_from_hourly",
    f"""SELECT CAST(year(obs_ts) AS INTEGER) AS Year, CAST(month(obs_ts) AS INTEGER) AS Month, {SHIP_SUMS}
FROM ship GROUP BY 1, 2""",
    ("ship",),
)
def en_monthly_from_hourly(spark, sf_dir):
    return rounded(en.energy_tables(shipments(spark, sf_dir), ts="obs_ts")["monthly"], *KWH)


@query("en_weekly_from_hourly", _windowed("time_bucket(INTERVAL '7 days', obs_ts, TIMESTAMP '1970-01-01')", "7 days"), ("meter",))
def en_weekly_from_hourly(spark, sf_dir):
    return rounded(en.energy_tables(clean_meter(spark, sf_dir), ts="obs_ts")["weekly"], *KWH)


@query(
    "en_carbon_monthly",
    """SELECT CAST(date_trunc('month', obs_ts) AS DATE) AS Date,
 ROUND(SUM(Global_active_power)/60e0*0.5e0, 9) AS Carbon_Emission_kgCO2 FROM ship GROUP BY 1""",
    ("ship",),
)
def en_carbon_monthly(spark, sf_dir):
    monthly = en.monthly_energy(shipments(spark, sf_dir), ts="obs_ts")
    return rounded(en.carbon_by_month(monthly), "Carbon_Emission_kgCO2")


@query(
    "en_carbon_seasonal",
    f"""
WITH s AS (SELECT CAST(year(obs_ts) AS INTEGER) AS y, {SEASON_NAME} AS n, SUM(Global_active_power)/60e0*0.5e0 AS c
 FROM ship GROUP BY 1, 2)
SELECT y AS Year, n AS Season,
 CAST(CASE n WHEN 'Spring' THEN 0 WHEN 'Summer' THEN 1 WHEN 'Fall' THEN 2 ELSE 3 END AS INTEGER) AS Season_Order,
 CAST(y AS VARCHAR) || ' ' || n AS Label, ROUND(c, 9) AS Carbon_Emission_kgCO2 FROM s""",
    ("ship",),
)
def en_carbon_seasonal(spark, sf_dir):
    seasonal = en.seasonal_energy(shipments(spark, sf_dir), ts="obs_ts")
    return rounded(en.carbon_by_season(seasonal), "Carbon_Emission_kgCO2")


@query(
    "en_hour_profile",
    f"WITH {HOURLY} SELECT CAST(hour(ws) AS INTEGER) AS Hour, ROUND(AVG(e), 9) AS Mean_Energy FROM hourly GROUP BY 1",
    ("meter",),
)
def en_hour_profile(spark, sf_dir):
    return rounded(en.hour_profile(hourly(spark, sf_dir)), "Mean_Energy")


PRICE = """CASE WHEN hour(ws) BETWEEN 14 AND 19 THEN 0.25e0
 WHEN hour(ws) BETWEEN 6 AND 13 OR hour(ws) BETWEEN 20 AND 21 THEN 0.15e0 ELSE 0.10e0 END"""


@query(
    "en_tou_price",
    f"""WITH {HOURLY} SELECT ws AS Window_Start, CAST(hour(ws) AS INTEGER) AS Hour, {PRICE} AS Price,
 ROUND(e, 9) AS Energy_Global_active_power FROM hourly""",
    ("meter",),
)
def en_tou_price(spark, sf_dir):
    priced = en.with_price(hourly(spark, sf_dir))
    return rounded(
        priced.select("Window_Start", "Hour", "Price", "Energy_Global_active_power"),
        "Energy_Global_active_power",
    )


@query(
    "en_demand_response",
    f"""WITH {HOURLY} SELECT CAST(hour(ws) AS INTEGER) AS Hour, ROUND(AVG(e), 9) AS Mean_Energy,
 MIN({PRICE}) AS Price FROM hourly GROUP BY 1""",
    ("meter",),
)
def en_demand_response(spark, sf_dir):
    return rounded(en.demand_response(hourly(spark, sf_dir)), "Mean_Energy")


@query(
    "en_cost_carbon",
    f"""WITH {HOURLY} SELECT CAST(ws AS DATE) AS Date, ROUND(SUM(e*{PRICE}), 9) AS Cost,
 ROUND(SUM(c), 9) AS Carbon_Emission_kgCO2 FROM hourly GROUP BY 1""",
    ("meter",),
)
def en_cost_carbon(spark, sf_dir):
    return rounded(en.daily_cost_and_carbon(hourly(spark, sf_dir)), "Cost", "Carbon_Emission_kgCO2")


@query(
    "cal_parse_ts",
    """SELECT strptime(Date || ' ' || Time, '%d/%m/%Y %H:%M:%S') AS Timestamp, Voltage FROM raw""",
    ("meter", "raw"),
)
def cal_parse_ts(spark, sf_dir):
    text = raw_text(spark, sf_dir)
    return text.select(text_timestamp(F.col("Date"), F.col("Time")).alias("Timestamp"), "Voltage")


@query(
    "cal_parts",
    """
WITH t AS (SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_linenumber,
 CAST(l_shipdate AS TIMESTAMP) + to_minutes(CAST(l_partkey % 1440 AS INTEGER)) AS ts FROM lineitem)
SELECT l_orderkey, l_linenumber, ts AS Timestamp, CAST(year(ts) AS INTEGER) AS Year, CAST(hour(ts) AS INTEGER) AS Hour,
 CAST(minute(ts) AS INTEGER) AS Minute, CAST(day(ts) AS INTEGER) AS Day,
 CAST(dayofweek(ts) + 1 AS INTEGER) AS Weekday, CAST(dayofweek(ts) + 1 AS INTEGER) AS DayOfWeek,
 CAST(month(ts) AS INTEGER) AS Month, CAST(quarter(ts) AS INTEGER) AS Quarter,
 CAST(CASE WHEN month(ts) IN (12, 1, 2) THEN 1 WHEN month(ts) IN (3, 4, 5) THEN 2
  WHEN month(ts) IN (6, 7, 8) THEN 3 ELSE 4 END AS INTEGER) AS Season,
 CAST(hour(ts)*60 + minute(ts) AS INTEGER) AS Minutes_Since_Midnight,
 CAST(CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS INTEGER) AS Is_Weekend,
 CAST(CASE WHEN dayofweek(ts) IN (0, 6) THEN 1 ELSE 0 END AS INTEGER) AS IsWeekend,
 CAST(CASE WHEN hour(ts) BETWEEN 18 AND 22 THEN 1 ELSE 0 END AS INTEGER) AS Is_Peak_Hour
FROM t""",
)
def cal_parts(spark, sf_dir):
    from loadlens.plans.fixtures import table

    minute = F.make_dt_interval(mins=(F.col("l_partkey") % 1440).cast("int"))
    stamped = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_shipdate").cast("timestamp") + minute).alias("Timestamp")
    )
    return stamped.withColumns(calendar_columns(F.col("Timestamp")))
