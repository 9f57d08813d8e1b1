"""Model features of an ordered series of readings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from loadlens.functions.calendar import calendar_columns
from loadlens.functions.electrical import cyclical_columns, electrical_columns
from loadlens.operators.ordered import RN, OrderedRows, row_frames
from loadlens.operators.sliding import add_frames, add_sliding

# Fixed values
LAGGED_COLUMN = "Global_active_power"
LAGS = [1, 5, 15, 30, 60]
ROLLING_ROWS = [15, 60]
DAY_ROWS = 1440
SMOOTHING_ROWS = 60


def add_calendar(df: DataFrame, ts: str = "Timestamp") -> DataFrame:
    """Add the calendar columns of ``ts``."""
    return df.withColumns(calendar_columns(F.col(ts)))


def add_cyclical(df: DataFrame) -> DataFrame:
    """Add sine and cosine of the hour and month columns."""
    return df.withColumns(cyclical_columns())


def add_electrical(df: DataFrame) -> DataFrame:
    """Add the electrical ratios and the energy per reading."""
    return df.withColumns(electrical_columns())


def lag_columns(window: WindowSpec, column: str, lags: Sequence[int]) -> dict[str, Column]:
    """Values a number of rows earlier."""
    return {f"{column}_Lag_{n}": F.lag(column, n).over(window) for n in lags}


def difference_column(window: WindowSpec, column: str) -> dict[str, Column]:
    """Change against the row before."""
    return {f"{column}_Diff_1": F.col(column) - F.lag(column, 1).over(window)}


def rolling_columns(window: WindowSpec, column: str, rows: int) -> dict[str, Column]:
    """Statistics of the ``rows`` rows before the current one.

    The column named Median holds the middle of the range, as its users expect;
    ``rolling_median_column`` gives the median proper.
    """
    frame = window.rowsBetween(-rows, -1)
    high, low = F.max(column).over(frame), F.min(column).over(frame)
    return {
        f"{column}_Rolling_{rows}_Mean": F.avg(column).over(frame),
        f"{column}_Rolling_{rows}_Std": F.stddev_samp(column).over(frame),
        f"{column}_Rolling_{rows}_Max": high,
        f"{column}_Rolling_{rows}_Min": low,
        f"{column}_Rolling_{rows}_Median": (high + low) / 2.0,
    }


def rolling_median_column(window: WindowSpec, column: str, rows: int) -> dict[str, Column]:
    """True median of the ``rows`` rows before the current one."""
    frame = window.rowsBetween(-rows, -1)
    return {f"{column}_Rolling_{rows}_True_Median": F.percentile(column, F.lit(0.5)).over(frame)}


def smoothed_column(window: WindowSpec, column: str, rows: int = SMOOTHING_ROWS) -> dict[str, Column]:
    """Mean of the current row and the rows before it, ``rows`` in all."""
    return {f"{column}_Smooth_{rows}": F.avg(column).over(window.rowsBetween(1 - rows, 0))}


def add_lags(ordered: OrderedRows, column: str = LAGGED_COLUMN, lags: Sequence[int] = tuple(LAGS)) -> OrderedRows:
    return row_frames(ordered, lambda w: lag_columns(w, column, lags), max(lags))


def add_difference(ordered: OrderedRows, column: str = LAGGED_COLUMN) -> OrderedRows:
    return row_frames(ordered, lambda w: difference_column(w, column), 1)


#: windows of more rows slide over chunks; frames take the others up anew for every row
FRAME_ROWS = 240


def add_rolling(ordered: OrderedRows, rows: int, column: str = LAGGED_COLUMN) -> OrderedRows:
    if rows > FRAME_ROWS:
        return add_sliding(ordered, column, rows)
    return row_frames(ordered, lambda w: rolling_columns(w, column, rows), rows)


def add_rolling_median(ordered: OrderedRows, rows: int, column: str = LAGGED_COLUMN) -> OrderedRows:
    if rows > FRAME_ROWS:
        return add_sliding(ordered, column, rows, moments=False, median=True)
    return row_frames(ordered, lambda w: rolling_median_column(w, column, rows), rows)


def add_day_lag(ordered: OrderedRows, column: str = LAGGED_COLUMN, rows: int = DAY_ROWS) -> OrderedRows:
    """The value ``rows`` rows before, by a join of positions.

    A frame would hold that many rows in a task, and a day may be any share of the table.
    """
    same = [F.col(s).eqNullSafe(F.col(f"__of_{s}")) for s in ordered.series]
    before = ordered.df.select(
        (F.col(RN) + rows).alias("__to"), *[F.col(s).alias(f"__of_{s}") for s in ordered.series],
        F.col(column).alias(f"{column}_Lag_{rows}"),
    )
    joined = ordered.df.join(before, [F.col(RN) == F.col("__to"), *same], "left")
    return ordered.with_df(joined.drop("__to", *[f"__of_{s}" for s in ordered.series]))


def add_smoothed(ordered: OrderedRows, columns: Sequence[str], rows: int = SMOOTHING_ROWS) -> OrderedRows:
    def build(window: WindowSpec) -> dict[str, Column]:
        return {name: col for c in columns for name, col in smoothed_column(window, c, rows).items()}

    return row_frames(ordered, build, rows)


def add_features(
    ordered: OrderedRows,
    *,
    ts: str = "Timestamp",
    column: str = LAGGED_COLUMN,
    lags: Sequence[int] = tuple(LAGS),
    rolling: Sequence[int] = tuple(ROLLING_ROWS),
    by_chunks: bool = False,
) -> OrderedRows:
    """All calendar, cyclical, electrical, lag and rolling columns.

    Lags and rolling statistics share one window, the rest is projection after it. Spark's frames
    take up every window anew for every row: with ``by_chunks`` a column of doubles goes by chunks of
    rows in tasks (``sliding.add_frames``), with the same values.
    """

    def build(window: WindowSpec) -> dict[str, Column]:
        made = lag_columns(window, column, lags) | difference_column(window, column)
        for rows in rolling:
            made |= rolling_columns(window, column, rows)
        return made

    if by_chunks and dict(ordered.df.dtypes)[column] == "double":
        framed = add_frames(ordered, column, lags, rolling)
    else:
        framed = row_frames(ordered, build, max(*lags, *rolling, 1))
    return replace(framed, df=add_electrical(add_cyclical(add_calendar(framed.df, ts))))
