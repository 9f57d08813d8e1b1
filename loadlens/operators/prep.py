"""Task data sets, temporal splits and validation folds.

Splits and folds are ranges of the row position, of the whole table or within each
series, so a fold is a filter and needs no sort of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.operators.ordered import RN, OrderedRows, series_position
from loadlens.sources.shared import stage

ROW, ROWS = "__row", "__rows"

# Feature columns per task, in order
TIME_FEATURES = [
    "Year", "Month", "Day", "Hour", "Minute", "DayOfWeek", "IsWeekend",
    "Hour_sin", "Hour_cos", "Month_sin", "Month_cos",
]
SENSORS = ["Global_reactive_power", "Voltage", "Global_intensity"]
CHANNELS = ["Sub_metering_1", "Sub_metering_2", "Sub_metering_3"]
RATIO_FEATURES = [
    "Reactive_Active_Ratio", "Intensity_Active_Ratio", "Total_Power_Wh",
    "Sub_metering_1_Ratio", "Sub_metering_2_Ratio", "Sub_metering_3_Ratio",
    "Sub_metering_Remainder", "Sub_metering_Remainder_Ratio",
]
HISTORY_FEATURES = [
    "Global_active_power_Lag_1", "Global_active_power_Lag_5", "Global_active_power_Lag_15",
    "Global_active_power_Lag_30", "Global_active_power_Lag_60", "Global_active_power_Diff_1",
    "Global_active_power_Rolling_15_Mean", "Global_active_power_Rolling_15_Std",
    "Global_active_power_Rolling_15_Max", "Global_active_power_Rolling_15_Min",
    "Global_active_power_Rolling_15_Median",
    "Global_active_power_Rolling_60_Mean", "Global_active_power_Rolling_60_Std",
    "Global_active_power_Rolling_60_Max", "Global_active_power_Rolling_60_Min",
    "Global_active_power_Rolling_60_Median",
]
TEST_RATIO = 0.20
FOLDS = 3
HOLDOUT_ROWS = 14_400

# Columns from which a task's target follows by arithmetic, alone or together
LEAKING_FEATURES = {
    "Global_active_power": [
        "Total_Power_Wh", "Global_active_power_Diff_1", "Reactive_Active_Ratio", "Intensity_Active_Ratio",
        "Sub_metering_1_Ratio", "Sub_metering_2_Ratio", "Sub_metering_3_Ratio",
        "Sub_metering_Remainder", "Sub_metering_Remainder_Ratio",
    ],
    "Sub_metering_1": ["Sub_metering_1_Ratio", "Sub_metering_Remainder", "Sub_metering_Remainder_Ratio"],
    "Sub_metering_2": ["Sub_metering_2_Ratio", "Sub_metering_Remainder", "Sub_metering_Remainder_Ratio"],
    "Sub_metering_3": ["Sub_metering_3_Ratio", "Sub_metering_Remainder", "Sub_metering_Remainder_Ratio"],
}


@dataclass(frozen=True)
class Task:
    """A prediction target with its feature columns."""

    name: str
    target: str
    features: tuple[str, ...]


def tasks(feature_set: str = "reference") -> dict[str, Task]:
    """The four tasks; ``leak_free`` leaves out features that give the target away."""
    if feature_set not in ("reference", "leak_free"):
        raise ValueError(f"unknown feature set {feature_set}")
    columns = {"Global_active_power": TIME_FEATURES + SENSORS + CHANNELS + RATIO_FEATURES + HISTORY_FEATURES}
    for channel in CHANNELS:
        others = [c for c in CHANNELS if c != channel]
        columns[channel] = TIME_FEATURES + ["Global_active_power"] + SENSORS + others + RATIO_FEATURES
    made = {}
    for target, features in columns.items():
        leaks = LEAKING_FEATURES[target] if feature_set == "leak_free" else []
        made[target] = Task(target, target, tuple(f for f in features if f not in leaks))
    return made


def require(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def task_projection(
    df: DataFrame, task: Task, *, ts: str = "Timestamp", keep: Sequence[str] = ()
) -> DataFrame:
    """Time, features and target of the rows that have a target."""
    wanted = list(dict.fromkeys([*keep, ts, *task.features, task.target]))
    require(df, wanted)
    return df.select(*wanted).dropna(subset=[task.target])


def complete_cases(df: DataFrame, task: Task) -> DataFrame:
    """Add the target as ``label`` and keep the rows without a missing feature."""
    labelled = df.withColumn("label", F.col(task.target).cast("double"))
    return labelled.dropna(subset=[*task.features, "label"])


def train_rows(total: int, test_ratio: float) -> int:
    """Rows before the split point."""
    if not 0 < test_ratio < 1:
        raise ValueError(f"test ratio must lie between 0 and 1, got {test_ratio}")
    # the product is rounded first, so that 10 * (1 - 0.2) gives 8 and not 7
    return floor(round(total * (1 - test_ratio), 9))


def series_rows(ordered: OrderedRows) -> OrderedRows:
    """Add ``__row``, the position in its series, and ``__rows``, how many the series has."""
    if not ordered.series:
        both = {ROW: F.col(RN), ROWS: F.lit(ordered.total).cast("long")}
        return ordered.with_df(ordered.df.withColumns(both))
    placed = series_position(ordered, ROW)
    # one row per series, staged: the join is planned from its size, by broadcast if it is small
    sizes = stage(
        ordered.df.groupBy(*[F.col(s).alias(f"__of_{s}") for s in ordered.series]).agg(F.count("*").alias(ROWS)),
        "sizes",
    )
    same = [F.col(s).eqNullSafe(F.col(f"__of_{s}")) for s in ordered.series]
    return placed.with_df(placed.df.join(sizes, same).drop(*[f"__of_{s}" for s in ordered.series]))


def in_training(test_ratio: float) -> Column:
    """Whether a row of ``series_rows`` comes before its series' split point."""
    train_rows(1, test_ratio)
    return F.col(ROW) < F.floor(F.round(F.col(ROWS) * (1 - test_ratio), 9))


def mark_split(ordered: OrderedRows, test_ratio: float = TEST_RATIO) -> DataFrame:
    """Add ``split``: the first rows in order are ``train``, the rest ``test``.

    With series keys each series is split at its own point.
    """
    split = F.when(in_training(test_ratio), "train").otherwise("test")
    return series_rows(ordered).df.withColumn("split", split).drop(ROW, ROWS)


def temporal_split(ordered: OrderedRows, test_ratio: float = TEST_RATIO) -> tuple[DataFrame, DataFrame]:
    """Training rows and test rows; each series is split at its own point."""
    rows, train = series_rows(ordered).df, in_training(test_ratio)
    return rows.where(train).drop(ROW, ROWS), rows.where(~train).drop(ROW, ROWS)


def tail_holdout(ordered: OrderedRows, rows: int = HOLDOUT_ROWS) -> tuple[DataFrame, DataFrame]:
    """All rows before the last ``rows`` of each series, and these."""
    placed, held = series_rows(ordered).df, F.col(ROW) >= F.col(ROWS) - rows
    return placed.where(~held).drop(ROW, ROWS), placed.where(held).drop(ROW, ROWS)


def skip_head(ordered: OrderedRows, rows: int) -> DataFrame:
    """The rows after the first ``rows``."""
    return ordered.df.where(F.col(RN) >= rows)


@dataclass(frozen=True)
class Fold:
    """Half-open ranges of one validation fold.

    They count rows or, with ``slices``, that many equal slices of each series.
    """

    number: int
    train: tuple[int, int]
    validation: tuple[int, int]
    slices: int | None = None


def cut_points(total: int, folds: int = FOLDS, *, reference_compat: bool = False) -> list[int]:
    """Positions that cut the rows into ``folds`` slices.

    ``reference_compat`` puts each inner cut one row early and the last cut on the
    last row, which then belongs to no slice.
    """
    if folds < 2:
        raise ValueError(f"at least 2 folds are needed, got {folds}")
    if reference_compat:
        return [max(ceil(i * total / folds) - 1, 0) for i in range(folds + 1)]
    return [i * total // folds for i in range(folds + 1)]


def chronological_folds(
    total: int, folds: int = FOLDS, *, val_ratio: float | None = None, reference_compat: bool = False
) -> list[Fold]:
    """One fold: the last slice, or the last ``val_ratio`` of the rows, validates."""
    if val_ratio is not None and not reference_compat:
        cut = train_rows(total, val_ratio)
    else:
        cut = cut_points(total, folds, reference_compat=reference_compat)[-2]
    return [Fold(1, (0, cut), (cut, total))]


def expanding_folds(total: int, folds: int = FOLDS, *, reference_compat: bool = False) -> list[Fold]:
    """Fold k trains on the first k slices and validates on the next."""
    cuts = cut_points(total, folds, reference_compat=reference_compat)
    return [Fold(k, (0, cuts[k]), (cuts[k], cuts[k + 1])) for k in range(1, folds)]


def rolling_folds(
    total: int, folds: int = FOLDS, *, width: int | None = None, reference_compat: bool = False
) -> list[Fold]:
    """Fold k trains on ``width`` slices and validates on the next.

    Without ``width`` the window takes all slices but one, which leaves one fold.
    """
    cuts = cut_points(total, folds, reference_compat=reference_compat)
    span = folds - 1 if width is None or reference_compat else width
    if not 1 <= span < folds:
        raise ValueError(f"width must lie between 1 and {folds - 1}, got {span}")
    return [
        Fold(k + 1, (cuts[k], cuts[k + span]), (cuts[k + span], cuts[k + span + 1]))
        for k in range(folds - span)
    ]


def series_folds(strategy: str = "chronological", folds: int = FOLDS, *, width: int | None = None) -> list[Fold]:
    """Folds that cut every series at its own points: ``chronological``, ``expanding`` or ``rolling``."""
    if strategy == "rolling":
        made = rolling_folds(folds, folds, width=width)
    elif strategy in ("chronological", "expanding"):
        made = (chronological_folds if strategy == "chronological" else expanding_folds)(folds, folds)
    else:
        raise ValueError(f"unknown fold strategy {strategy}")
    return [replace(f, slices=folds) for f in made]


def _between(span: tuple[int, int], slices: int | None) -> Column:
    if slices is None:
        return (F.col(RN) >= span[0]) & (F.col(RN) < span[1])
    low, high = (F.expr(f"{ROWS} * {at} div {slices}") for at in span)
    return (F.col(ROW) >= low) & (F.col(ROW) < high)


def slice_of(cuts: Sequence[int], slices: int | None = None) -> Column:
    """How many of the ``cuts`` lie at or before a row: the slice between two of them that it is in."""
    if slices is None:
        passed = [F.col(RN) >= at for at in cuts]
    else:
        passed = [F.col(ROW) >= F.expr(f"{ROWS} * {at} div {slices}") for at in cuts]
    return reduce(lambda a, b: a + b, [p.cast("int") for p in passed])


def _foldable(ordered: OrderedRows, folds: Sequence[Fold]) -> DataFrame:
    placed = all(c in ordered.df.columns for c in (ROW, ROWS)) or all(f.slices is None for f in folds)
    return ordered.df if placed else series_rows(ordered).df


def fold_frames(ordered: OrderedRows, fold: Fold) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of a fold."""
    df = _foldable(ordered, [fold])
    return df.where(_between(fold.train, fold.slices)), df.where(_between(fold.validation, fold.slices))


def mark_folds(ordered: OrderedRows, folds: Sequence[Fold]) -> DataFrame:
    """Long form: one row per row, fold and role (``train`` or ``validation``)."""
    roles = []
    for f in folds:
        number = F.lit(f.number).alias("fold")
        for role, span in (("train", f.train), ("validation", f.validation)):
            roles.append(F.when(_between(span, f.slices), F.struct(number, F.lit(role).alias("role"))))
    held = F.array_compact(F.array(*roles))
    marked = _foldable(ordered, folds).withColumn("__fold", F.explode(held)).select("*", "__fold.*")
    return marked.drop("__fold", ROW, ROWS)


def cut_point_table(df: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Cut positions of a table, from its row count alone."""
    slices = F.explode(F.sequence(F.lit(0), F.lit(folds))).alias("slice")
    counted = df.agg(F.count("*").alias("rows")).select("rows", slices)
    return counted.select("slice", F.expr(f"slice * rows div {folds}").alias("position"))
