"""Energy, carbon and cost from power readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.functions.calendar import season_name, season_order
from loadlens.functions.tariff import time_of_use_price
from loadlens.sources.shared import stage

# Fixed values
POWER_COLUMNS = ["Global_active_power", "Global_reactive_power"]
CARBON_POWER = "Global_active_power"
CARBON_KG_PER_KWH = 0.5
READINGS_PER_HOUR = 60.0
DURATIONS = {"hourly": "1 hour", "daily": "1 day", "weekly": "1 week"}


def _energy(columns: list[str], carbon_factor: float, per_hour: float) -> list[Column]:
    sums = {c: F.sum(c) / per_hour for c in columns}
    aggs = [e.alias(f"Energy_{c}") for c, e in sums.items()]
    if CARBON_POWER in sums:
        aggs.append((sums[CARBON_POWER] * carbon_factor).alias("Carbon_Emission_kgCO2"))
    return aggs


def windowed_energy(
    df: DataFrame,
    duration: str,
    *,
    ts: str = "Timestamp",
    columns: list[str] | None = None,
    series: list[str] | None = None,
    start_time: str | None = None,
    carbon_factor: float = CARBON_KG_PER_KWH,
    per_hour: float = READINGS_PER_HOUR,
) -> DataFrame:
    """Energy per tumbling window. Weeks count from the epoch, a Thursday;
    ``start_time='4 days'`` makes them start on Monday."""
    tumbling = F.window(ts, duration, startTime=start_time) if start_time else F.window(ts, duration)
    grouped = df.groupBy(*(series or []), tumbling.alias("__window"))
    energy = grouped.agg(*_energy(columns or POWER_COLUMNS, carbon_factor, per_hour))
    return energy.select(
        *(series or []),
        F.col("__window.start").alias("Window_Start"),
        F.col("__window.end").alias("Window_End"),
        *[c for c in energy.columns if c not in {*(series or []), "__window"}],
    )


def monthly_energy(
    df: DataFrame,
    *,
    ts: str = "Timestamp",
    columns: list[str] | None = None,
    series: list[str] | None = None,
    carbon_factor: float = CARBON_KG_PER_KWH,
    per_hour: float = READINGS_PER_HOUR,
) -> DataFrame:
    """Energy per calendar year and month."""
    return df.groupBy(*(series or []), F.year(ts).alias("Year"), F.month(ts).alias("Month")).agg(
        *_energy(columns or POWER_COLUMNS, carbon_factor, per_hour)
    )


def seasonal_energy(
    df: DataFrame,
    *,
    ts: str = "Timestamp",
    columns: list[str] | None = None,
    series: list[str] | None = None,
    meteorological_year: bool = False,
    carbon_factor: float = CARBON_KG_PER_KWH,
    per_hour: float = READINGS_PER_HOUR,
) -> DataFrame:
    """Energy per year and season. December counts to the winter of its own calendar
    year, or with ``meteorological_year`` to the winter of the next."""
    year = F.year(ts)
    if meteorological_year:
        year = F.when(F.month(ts) == 12, year + 1).otherwise(year)
    return df.groupBy(*(series or []), year.alias("Year"), season_name(F.month(ts)).alias("Season")).agg(
        *_energy(columns or POWER_COLUMNS, carbon_factor, per_hour)
    )


def energy_tables(df: DataFrame, *, ts: str = "Timestamp", series: list[str] | None = None) -> dict[str, DataFrame]:
    """Hourly, daily, weekly, monthly and seasonal energy from one pass over the readings.

    Quarters of an hour nest in all longer periods and in the months of every time zone, so
    those are sums over one staged table of quarters.
    """
    quarters = stage(windowed_energy(df, "15 minutes", ts=ts, series=series), "quarters")
    # energy adds up like power read once an hour
    parts = quarters.withColumnsRenamed({f"Energy_{c}": c for c in POWER_COLUMNS} | {"Window_Start": ts})
    return {
        **{name: windowed_energy(parts, span, ts=ts, series=series, per_hour=1.0) for name, span in DURATIONS.items()},
        "monthly": monthly_energy(parts, ts=ts, series=series, per_hour=1.0),
        "seasonal": seasonal_energy(parts, ts=ts, series=series, per_hour=1.0),
    }


def carbon_by_month(monthly: DataFrame) -> DataFrame:
    """Monthly carbon with the first day of the month as date, in date order."""
    return monthly.select(
        F.make_date("Year", "Month", F.lit(1)).alias("Date"), "Carbon_Emission_kgCO2"
    ).orderBy("Date")


def carbon_by_season(seasonal: DataFrame) -> DataFrame:
    """Seasonal carbon with a label such as ``2008 Spring``, in year and season order."""
    return seasonal.select(
        "Year",
        "Season",
        season_order(F.col("Season")).alias("Season_Order"),
        F.concat_ws(" ", F.col("Year").cast("string"), "Season").alias("Label"),
        "Carbon_Emission_kgCO2",
    ).orderBy("Year", "Season_Order")


def hour_profile(hourly: DataFrame, *, energy: str = "Energy_Global_active_power") -> DataFrame:
    """Mean hourly energy by hour of the day."""
    return hourly.groupBy(F.hour("Window_Start").alias("Hour")).agg(F.avg(energy).alias("Mean_Energy"))


def with_price(hourly: DataFrame) -> DataFrame:
    """Hour of the day and its time-of-use price beside each hourly window."""
    hour = F.hour("Window_Start")
    return hourly.withColumns({"Hour": hour, "Price": time_of_use_price(hour)})


def demand_response(hourly: DataFrame, *, energy: str = "Energy_Global_active_power") -> DataFrame:
    """Mean energy and price by hour of the day."""
    return with_price(hourly).groupBy("Hour").agg(
        F.avg(energy).alias("Mean_Energy"), F.min("Price").alias("Price")
    )


def daily_cost_and_carbon(hourly: DataFrame, *, energy: str = "Energy_Global_active_power") -> DataFrame:
    """Cost at the time-of-use price and carbon by date."""
    return (
        with_price(hourly)
        .groupBy(F.to_date("Window_Start").alias("Date"))
        .agg(
            F.sum(F.col(energy) * F.col("Price")).alias("Cost"),
            F.sum("Carbon_Emission_kgCO2").alias("Carbon_Emission_kgCO2"),
        )
    )
