"""Cleaning of raw readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.operators.ordered import OrderedRows, carry_forward
from loadlens.operators.quantiles import exact_quantiles
from loadlens.sources.shared import stage

# Fixed values
READING_COLUMNS = [
    "Global_active_power",
    "Global_reactive_power",
    "Voltage",
    "Global_intensity",
    "Sub_metering_1",
    "Sub_metering_2",
    "Sub_metering_3",
]
SIGNED_COLUMNS = ["Voltage"]
FLOORED_NAMES = ["power", "metering"]
QUARTILES = [0.25, 0.75]
IQR_FACTOR = 1.5
QUANTILE_ERROR = 0.01


def _present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def cast_numeric(df: DataFrame, columns: Sequence[str] = READING_COLUMNS) -> DataFrame:
    """Text readings as doubles; what does not parse becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in _present(df, columns)})


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Keep one of the rows that are equal in every column."""
    return df.dropDuplicates()


def forward_fill(ordered: OrderedRows, columns: Sequence[str] = READING_COLUMNS) -> OrderedRows:
    """Fill missing readings with the last reading before them."""
    return carry_forward(ordered, _present(ordered.df, columns))


def fill_zero(df: DataFrame, columns: Sequence[str] = READING_COLUMNS) -> DataFrame:
    """Fill missing readings with 0."""
    return df.fillna(0.0, subset=_present(df, columns))


def clamp_negative(
    df: DataFrame, columns: Sequence[str] = READING_COLUMNS, signed: Sequence[str] = SIGNED_COLUMNS
) -> DataFrame:
    """Raise negative readings to 0 except in the ``signed`` columns; nulls stay."""
    unsigned = [c for c in _present(df, columns) if c not in signed]
    return df.withColumns({c: F.when(F.col(c) < 0, 0.0).otherwise(F.col(c)) for c in unsigned})


def iqr_bounds(
    df: DataFrame,
    columns: Sequence[str] = READING_COLUMNS,
    *,
    relative_error: float = 0.0,
    factor: float = IQR_FACTOR,
) -> dict[str, tuple[float, float]]:
    """Lower and upper fence per column, quartiles -+ ``factor`` times their distance.

    ``relative_error=0`` takes exact interpolated quartiles, any other value the
    approximate ones of ``approxQuantile``, which cost a single pass. Columns named
    after power or metering have a lower fence of 0 at least; columns without a
    value have no fence.
    """
    names = _present(df, columns)
    if relative_error:
        quartiles = dict(zip(names, df.approxQuantile(names, QUARTILES, relative_error), strict=True))
    else:
        quartiles = exact_quantiles(df, names, QUARTILES)
    bounds = {}
    for name, found in quartiles.items():
        if not found or found[0] is None:
            continue
        q1, q3 = found
        low, high = q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)
        if any(part in name.lower() for part in FLOORED_NAMES):
            low = max(0.0, low)
        bounds[name] = (low, high)
    return bounds


def cap_outliers(
    df: DataFrame, bounds: dict[str, tuple[float, float]], *, skip_zero_iqr: bool = False
) -> DataFrame:
    """Move values outside their fences onto the fence.

    Where more than half of the values are equal both fences may meet and the column
    becomes constant; ``skip_zero_iqr`` leaves such columns alone.
    """
    capped = {}
    for name, (low, high) in bounds.items():
        if skip_zero_iqr and low >= high:
            continue
        col = F.col(name)
        capped[name] = F.when(col > high, high).when(col < low, low).otherwise(col)
    return df.withColumns(capped)


def clean_rows(
    ordered: OrderedRows,
    columns: Sequence[str] = READING_COLUMNS,
    *,
    relative_error: float = 0.0,
    skip_zero_iqr: bool = False,
) -> OrderedRows:
    """Fill, clamp and cap cast, de-duplicated rows in order."""
    filled = forward_fill(ordered, columns)
    # the quantile passes and the capping read the filled rows again: stage them once
    clamped = stage(clamp_negative(fill_zero(filled.df, columns), columns), "filled")
    bounds = iqr_bounds(clamped, columns, relative_error=relative_error)
    return ordered.with_df(cap_outliers(clamped, bounds, skip_zero_iqr=skip_zero_iqr))
