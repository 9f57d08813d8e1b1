"""Calendar columns of a timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
TEXT_TIMESTAMP_FORMAT = "d/M/yyyy H:m:s"
SEASONS = {"Winter": [12, 1, 2], "Spring": [3, 4, 5], "Summer": [6, 7, 8], "Fall": [9, 10, 11]}
SEASON_CODES = {"Winter": 1, "Spring": 2, "Summer": 3, "Fall": 4}
SEASON_ORDER_IN_YEAR = ["Spring", "Summer", "Fall", "Winter"]
WEEKEND_DAYS = [1, 7]
PEAK_HOURS = (18, 22)


def text_timestamp(date: Column, time: Column, fmt: str = TEXT_TIMESTAMP_FORMAT) -> Column:
    """Timestamp from a date and a time text; null where the text does not parse."""
    return F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit(fmt))


def season_code(month: Column) -> Column:
    """1 winter, 2 spring, 3 summer, 4 fall."""
    return (F.floor(month % 12 / 3) + 1).cast("int")


def season_name(month: Column) -> Column:
    names = F.array(*[F.lit(s) for s in SEASON_CODES])
    return F.element_at(names, season_code(month))


def season_order(season: Column) -> Column:
    """Position of a season name inside its calendar year; 99 for other names."""
    ordered = F.array(*[F.lit(s) for s in SEASON_ORDER_IN_YEAR])
    place = F.array_position(ordered, season)
    return F.when(place > 0, place - 1).otherwise(F.lit(99)).cast("int")


def calendar_columns(ts: Column) -> dict[str, Column]:
    """The thirteen calendar columns; days of the week count from Sunday = 1."""
    weekend = F.dayofweek(ts).isin(WEEKEND_DAYS).cast("int")
    return {
        "Year": F.year(ts),
        "Hour": F.hour(ts),
        "Minute": F.minute(ts),
        "Day": F.dayofmonth(ts),
        "Weekday": F.dayofweek(ts),
        "DayOfWeek": F.dayofweek(ts),
        "Month": F.month(ts),
        "Quarter": F.quarter(ts),
        "Season": season_code(F.month(ts)),
        "Minutes_Since_Midnight": F.hour(ts) * 60 + F.minute(ts),
        "Is_Weekend": weekend,
        "IsWeekend": weekend,
        "Is_Peak_Hour": F.hour(ts).between(*PEAK_HOURS).cast("int"),
    }
