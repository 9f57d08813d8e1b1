"""Text cells of report tables."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# send these functions with the query, so that workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOT_AVAILABLE = "N/A"
SELECTED_MARK = "✓"


def number_text(value: Column, digits: int = 4) -> Column:
    """Fixed number of decimals; null and NaN as N/A."""
    text = F.format_string(f"%.{digits}f", value)
    return F.when(value.isNull() | F.isnan(value), NOT_AVAILABLE).otherwise(text)


@F.pandas_udf(T.StringType())
def _scientific(value: pd.Series) -> pd.Series:
    return value.map(lambda v: f"{v:.4e}", na_action="ignore").astype(object)


def scientific_text(value: Column) -> Column:
    """Four decimals and an exponent, of the exact value; null and NaN as N/A.

    ``format_string`` rounds the shortest digits that tell a number apart, which are fewer
    than five for the smallest ones. For result tables, not for rows.
    """
    return F.coalesce(_scientific(F.nanvl(value, F.lit(None).cast("double"))), F.lit(NOT_AVAILABLE))


def selected_mark(flag: Column) -> Column:
    return F.when(flag, SELECTED_MARK).otherwise("")


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")
