"""Time-of-use price of an hour of the day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (first hour, last hour, price per kWh); other hours cost OFF_PEAK_PRICE
TARIFF = [(14, 19, 0.25), (6, 13, 0.15), (20, 21, 0.15)]
OFF_PEAK_PRICE = 0.10


def time_of_use_price(hour: Column, tariff=None, off_peak: float = OFF_PEAK_PRICE) -> Column:
    """Price of the first tariff band that holds ``hour``."""
    price = F.lit(None).cast("double")
    for first, last, rate in reversed(tariff or TARIFF):
        price = F.when(hour.between(first, last), F.lit(rate)).otherwise(price)
    return F.coalesce(price, F.lit(off_peak))
