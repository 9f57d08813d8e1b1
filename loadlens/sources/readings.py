"""Reading delimited meter files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values
RAW_COLUMNS = [
    "Date",
    "Time",
    "Global_active_power",
    "Global_reactive_power",
    "Voltage",
    "Global_intensity",
    "Sub_metering_1",
    "Sub_metering_2",
    "Sub_metering_3",
]
DELIMITER = ";"
MISSING = "?"
CORRUPT = "_corrupt_record"


def read_readings(
    spark: SparkSession,
    path: str | list[str],
    *,
    columns: Sequence[str] = tuple(RAW_COLUMNS),
    delimiter: str = DELIMITER,
    missing: str = MISSING,
    keep_corrupt: bool = False,
) -> DataFrame:
    """Text columns of delimited files with a header; rows with too few or too many
    fields are padded or cut. ``keep_corrupt`` adds the text of such rows."""
    fields = [T.StructField(c, T.StringType()) for c in columns]
    reader = spark.read.option("sep", delimiter).option("header", True).option("nullValue", missing)
    reader = reader.option("mode", "PERMISSIVE").option("encoding", "utf-8")
    if not keep_corrupt:
        return reader.schema(T.StructType(fields)).csv(path)
    schema = T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])
    # a row is malformed by its field count, so all fields are parsed whatever is selected
    return reader.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False).csv(path)


def malformed_count(readings: DataFrame) -> DataFrame:
    """Rows read and rows whose field count was wrong, of ``read_readings(keep_corrupt=True)``."""
    first = next(c for c in readings.columns if c != CORRUPT)
    return readings.agg(
        F.count("*").alias("rows"),
        F.count(CORRUPT).alias("malformed"),
        F.count(first).alias(f"with_{first}"),
    )
