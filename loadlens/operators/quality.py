"""Validation of raw readings.

All row-scale checks of a report come from one aggregate; the schema checks are
metadata and join the report as literal rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadlens.sources.readings import CORRUPT

# Fixed values
EXPECTED_COLUMNS = {
    "Date": "string",
    "Time": "string",
    "Global_active_power": "numeric",
    "Global_reactive_power": "numeric",
    "Voltage": "numeric",
    "Global_intensity": "numeric",
    "Sub_metering_1": "numeric",
    "Sub_metering_2": "numeric",
    "Sub_metering_3": "numeric",
}
NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType)
MAX_NULL_PERCENTAGE = 5.0


def _one_row_each(df: DataFrame, rows: list[Column]) -> DataFrame:
    return df.select(F.explode(F.array(*rows)).alias("__row")).select("__row.*")


def row_count(df: DataFrame) -> DataFrame:
    """Row and column count; an empty table fails."""
    return df.agg(F.count("*").alias("row_count")).select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.when(F.col("row_count") > 0, "PASS").otherwise("FAIL").alias("status"),
    )


def _null_status(percentage: Column, limit: float) -> Column:
    return F.when(percentage > limit, "FAIL").when(percentage > 0, "WARN").otherwise("PASS")


def _null_counts(df: DataFrame) -> DataFrame:
    """One row: all rows and the nulls of each column."""
    nulls = [(F.count("*") - F.count(F.col(f"`{c}`"))).alias(f"__nulls_{i}") for i, c in enumerate(df.columns)]
    return df.agg(F.count("*").alias("__rows"), *nulls)


def null_percentages(df: DataFrame, max_percentage: float = MAX_NULL_PERCENTAGE) -> DataFrame:
    """Nulls per column against the allowed share; nothing for an empty table."""
    counted = _null_counts(df).where(F.col("__rows") > 0)
    rows = []
    for i, c in enumerate(df.columns):
        nulls = F.col(f"__nulls_{i}")
        percentage = nulls / F.col("__rows") * 100.0
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"),
                nulls.alias("null_count"),
                F.round(percentage, 4).alias("null_percentage"),
                F.lit(max_percentage).alias("threshold"),
                _null_status(percentage, max_percentage).alias("status"),
            )
        )
    return _one_row_each(counted, rows)


def empty_columns(df: DataFrame) -> DataFrame:
    """Per column whether it holds no value at all."""
    counted = _null_counts(df).where(F.col("__rows") > 0)
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            (F.col(f"__nulls_{i}") == F.col("__rows")).alias("is_empty"),
            F.when(F.col(f"__nulls_{i}") == F.col("__rows"), "WARN").otherwise("PASS").alias("status"),
        )
        for i, c in enumerate(df.columns)
    ]
    return _one_row_each(counted, rows)


def castable(df: DataFrame, columns: Sequence[str], to: str = "double") -> DataFrame:
    """Per column the values that are present but do not parse as ``to``."""
    made = [
        F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(to).isNull()).alias(f"__bad_{i}")
        for i, c in enumerate(columns)
    ]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"__bad_{i}").alias("not_castable"),
            F.when(F.col(f"__bad_{i}") > 0, "WARN").otherwise("PASS").alias("status"),
        )
        for i, c in enumerate(columns)
    ]
    return _one_row_each(df.agg(*made), rows)


def _check(check: str, column: str | None, observed: Column, threshold: str | None, status: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(column).cast("string").alias("column_name"),
        observed.cast("string").alias("observed"),
        F.lit(threshold).cast("string").alias("threshold"),
        status.alias("status"),
    )


def _schema_checks(df: DataFrame, expected: dict[str, str]) -> list[Column]:
    present = df.columns
    checks = []
    for name in expected:
        state = "PASS" if name in present else "FAIL"
        checks.append(_check("required_column", name, F.lit("present" if state == "PASS" else "missing"), None, F.lit(state)))
    for name in present:
        if name not in expected:
            checks.append(_check("extra_column", name, F.lit("present"), None, F.lit("INFO")))
    for name in dict.fromkeys(c for c in present if present.count(c) > 1):
        checks.append(_check("duplicate_column", name, F.lit(present.count(name)), "1", F.lit("WARN")))
    enough = "PASS" if len(present) >= len(expected) else "FAIL"
    checks.append(_check("delimiter", None, F.lit(len(present)), str(len(expected)), F.lit(enough)))
    for field in df.schema.fields:
        wanted = expected.get(field.name)
        if wanted:
            kinds = NUMERIC_TYPES if wanted == "numeric" else (T.StringType,)
            fits = "PASS" if isinstance(field.dataType, kinds) else "WARN"
            checks.append(_check("type", field.name, F.lit(field.dataType.simpleString()), wanted, F.lit(fits)))
    return checks


def validation_report(
    df: DataFrame,
    expected: dict[str, str] | None = None,
    max_null_percentage: float = MAX_NULL_PERCENTAGE,
) -> DataFrame:
    """One row per check: row count, columns, delimiter, types, nulls and empty columns.

    Where ``df`` was read with the text of malformed rows (``CORRUPT``), their number is a check
    too; any is a warning.
    """
    corrupt = CORRUPT in df.columns
    whole, df = df, df.drop(CORRUPT)
    positional = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # names may repeat
    if corrupt:
        # all columns are read, so that every row is parsed
        positional = whole.toDF(*["__malformed" if c == CORRUPT else c for c in whole.columns])
        positional = positional.select(*[c for c in positional.columns if c != "__malformed"], "__malformed").toDF(
            *[f"c{i}" for i in range(len(df.columns))], "__malformed"
        )
    counted = _null_counts(positional)
    rows = F.col("__rows")
    checks = [
        _check("row_count", None, rows, "1", F.when(rows > 0, "PASS").otherwise("FAIL")),
        *_schema_checks(df, expected or EXPECTED_COLUMNS),
    ]
    if corrupt:
        malformed = rows - F.col(f"__nulls_{len(df.columns)}")
        checks.append(_check("malformed_rows", None, malformed, "0", F.when(malformed > 0, "WARN").otherwise("PASS")))
    for i, c in enumerate(df.columns):
        nulls = F.col(f"__nulls_{i}")
        percentage = F.try_divide(nulls, rows) * 100.0
        checks.append(
            F.when(
                rows > 0,
                _check(
                    "null_percentage",
                    c,
                    F.round(percentage, 4),
                    str(max_null_percentage),
                    _null_status(percentage, max_null_percentage),
                ),
            )
        )
        empty = F.when(nulls == rows, "WARN").otherwise("PASS")
        checks.append(F.when(rows > 0, _check("empty_column", c, nulls, None, empty)))
    return counted.select(F.explode(F.array_compact(F.array(*checks))).alias("__row")).select("__row.*")


def overall_status(report: DataFrame) -> DataFrame:
    """FAILED with any error, PASSED_WITH_WARNINGS with any warning, else PASSED."""
    errors, warnings = F.count_if(F.col("status") == "FAIL"), F.count_if(F.col("status") == "WARN")
    return report.agg(
        F.when(errors > 0, "FAILED").when(warnings > 0, "PASSED_WITH_WARNINGS").otherwise("PASSED").alias("status"),
        errors.alias("error_count"),
        warnings.alias("warning_count"),
    )


class ValidationError(ValueError):
    """Raised by ``require_valid`` with the failed checks."""


def require_valid(report: DataFrame) -> None:
    """Raise with all failed checks of a report (its size is set by the column count)."""
    failed = report.where(F.col("status") == "FAIL").select("check", "column_name", "observed").collect()
    if failed:
        raise ValidationError("; ".join(f"{r['check']} {r['column_name'] or ''}: {r['observed']}" for r in failed))


def dataset_summary(df: DataFrame, columns: Sequence[str], ts: str = "Timestamp") -> DataFrame:
    """Records, time range, number of columns and share of missing cells in percent."""
    present = sum((F.count(c) for c in columns[1:]), F.count(columns[0]))
    cells = F.count("*") * len(columns)
    return df.agg(
        F.count("*").alias("records"),
        F.min(ts).alias("first_timestamp"),
        F.max(ts).alias("last_timestamp"),
        F.lit(len(columns)).alias("feature_count"),
        F.round(F.try_divide(cells - present, cells) * 100.0, 4).alias("missing_percentage"),
    )
