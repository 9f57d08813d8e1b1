"""Row-order operators over long series without a single-task window.

``order_rows`` sorts once by range partitioning on the series key, the order key
and its tie-break together, so a series, day or timestamp that holds most of the
rows is still spread over many tasks. The sorted rows are staged with a global
position. Everything order-sensitive then works on *chunks*, runs of positions of
bounded size:

* row frames (lags, rolling statistics) get the last ``reach`` rows of the chunk
  before as a halo,
* forward fill and running totals get a carried value from the chunks before.

What is broadcast has one row per sorted partition or per chunk at the most, and
the number of chunks is capped by ``MAX_CHUNKS``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loadlens.sources.shared import stage

RN = "__rn"
_POS = "__pos"
_SLICE = "__slice"
_CHUNK = "__chunk"

MAX_CHUNKS = 65_536
CHUNK_ROWS = 1_000_000
MIN_CHUNK_ROWS = 2_048


@dataclass(frozen=True)
class OrderedRows:
    """Rows with their zero-based global position ``__rn`` and the row total."""

    df: DataFrame
    total: int
    series: tuple[str, ...] = ()
    #: where given, a partition of ``df`` has whole chunks of that many positions, each in order
    chunk: int | None = None

    def with_df(self, df: DataFrame) -> OrderedRows:
        """The same order over a row-preserving projection of ``df``."""
        return OrderedRows(df, self.total, self.series)

    def chunk_rows(self, reach: int = 0) -> int:
        """Rows per chunk: enough chunks for the cores, at most MAX_CHUNKS, never below ``reach``."""
        cores = self.df.sparkSession.sparkContext.defaultParallelism
        wanted = min(CHUNK_ROWS, ceil(self.total / (2 * cores)))
        return max(wanted, MIN_CHUNK_ROWS, 8 * reach, ceil(self.total / MAX_CHUNKS))


def order_rows(df: DataFrame, order_by: Sequence[str], series: Sequence[str] = ()) -> OrderedRows:
    """Sort by ``series`` then ``order_by`` and number the rows from 0.

    ``order_by`` must be unique within a series (give a tie-break column), else
    equal rows may change places between runs.
    """
    keys = [*series, *order_by]
    staged = stage(
        df.repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        # partition number in the upper bits, position in the partition in the lower 33
        .withColumn(_POS, F.monotonically_increasing_id()),
        "ordered",
    ).withColumn(_SLICE, F.shiftright(_POS, 33))
    # one row per sorted partition, so the driver list is bounded by the partition count
    sizes = sorted(map(tuple, staged.groupBy(_SLICE).count().collect()))
    offsets, total = [], 0
    for _, rows in sizes:
        offsets.append(total)
        total += rows
    # an Arrow table becomes a local relation, a list of rows would start Python workers of its own
    columns = {_SLICE: pa.array([part for part, _ in sizes], pa.int64()), "__start": pa.array(offsets, pa.int64())}
    starts = df.sparkSession.createDataFrame(pa.table(columns))
    numbered = (
        staged.join(F.broadcast(starts), _SLICE)
        .withColumn(RN, F.col("__start") + F.col(_POS).bitwiseAND(F.lit((1 << 33) - 1)))
        .drop(_SLICE, _POS, "__start")
    )
    return OrderedRows(numbered, total, tuple(series))


def _chunk_of(rows: int, rn: str = RN) -> Column:
    return F.expr(f"{rn} div {rows}")


def halo_rows(ordered: OrderedRows, reach: int, most: int = CHUNK_ROWS) -> int:
    """Rows of a chunk that has the ``reach`` rows before it, about ``most`` at the most."""
    return min(ordered.chunk_rows(reach), max(most, 8 * reach, ceil(ordered.total / MAX_CHUNKS)))


def with_halo(ordered: OrderedRows, reach: int, most: int = CHUNK_ROWS) -> tuple[DataFrame, list[str], Column]:
    """Rows in chunks of positions, each with the ``reach`` rows before it.

    Returned with the keys of a chunk and whether a row is the chunk's own. Chunks have about ``most`` rows at the most.
    """
    rows = halo_rows(ordered, reach, most)
    chunk = _chunk_of(rows)
    in_halo = F.col(RN) % rows >= rows - reach
    spread = ordered.df.withColumn(
        _CHUNK, F.explode(F.when(in_halo, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    )
    return spread, [*ordered.series, _CHUNK], F.col(_CHUNK) == chunk


def row_frames(
    ordered: OrderedRows, build: Callable[[WindowSpec], dict[str, Column]], reach: int
) -> OrderedRows:
    """Add the columns ``build`` makes from a window ordered by position.

    Frames may look back ``reach`` rows at the most.
    """
    rows = ordered.chunk_rows(reach)
    chunk = _chunk_of(rows)
    in_halo = F.col(RN) % rows >= rows - reach
    spread = ordered.df.withColumn(
        _CHUNK, F.explode(F.when(in_halo, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    )
    # frames cost far more time than their rows have bytes: keep every shuffle
    # partition as a task of its own instead of letting small ones be merged
    parts = int(ordered.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = spread.repartition(parts, *ordered.series, _CHUNK)
    window = Window.partitionBy(*ordered.series, _CHUNK).orderBy(RN)
    built = spread.withColumns(build(window))
    return ordered.with_df(built.where(F.col(_CHUNK) == chunk).drop(_CHUNK))


def _carried(ends: DataFrame, series: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """Move the value that holds at the end of each chunk to the chunk after it.

    ``ends`` has only the series that runs over the end of each chunk: one row per chunk.
    """
    run = Window.partitionBy(*series).orderBy(_CHUNK)
    made = {name: col.over(run) for name, col in columns.items()}
    return ends.withColumns(made).select(
        (F.col(_CHUNK) + 1).alias("__to"), *[F.col(s).alias(f"__of_{s}") for s in series], *made
    )


def _join_carried(rows: DataFrame, carried: DataFrame, series: Sequence[str]) -> DataFrame:
    match = F.col(_CHUNK) == F.col("__to")
    for s in series:
        match = match & F.col(s).eqNullSafe(F.col(f"__of_{s}"))
    # at most one row per chunk, so at most MAX_CHUNKS rows
    joined = rows.join(F.broadcast(carried), match, "left")
    return joined.drop("__to", *[f"__of_{s}" for s in series])


def _chunk_ends(ordered: OrderedRows, rows: int, aggs: list[Column]) -> DataFrame:
    """Per chunk the aggregates of the series that reaches the chunk's last position."""
    return (
        ordered.df.withColumn(_CHUNK, _chunk_of(rows))
        .groupBy(*ordered.series, _CHUNK)
        .agg(F.max(RN).alias("__last"), *aggs)
        .where(F.col("__last") % rows == rows - 1)
    )


def carry_forward(ordered: OrderedRows, columns: Sequence[str]) -> OrderedRows:
    """Replace nulls by the last value before them in the series; leading nulls stay."""
    rows = ordered.chunk_rows()
    last = {c: f"__last_{i}" for i, c in enumerate(columns)}
    ends = _chunk_ends(
        ordered,
        rows,
        [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(RN))).alias(n) for c, n in last.items()],
    )
    carried = _carried(ends, ordered.series, {n: F.last(n, ignorenulls=True) for n in last.values()})
    window = Window.partitionBy(*ordered.series, _CHUNK).orderBy(RN).rowsBetween(Window.unboundedPreceding, 0)
    joined = _join_carried(ordered.df.withColumn(_CHUNK, _chunk_of(rows)), carried, ordered.series)
    filled = joined.withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(window), F.col(n)) for c, n in last.items()}
    )
    return ordered.with_df(filled.drop(_CHUNK, *last.values()))


def running_total(ordered: OrderedRows, totals: dict[str, Column]) -> OrderedRows:
    """Add inclusive running sums within each series, in position order."""
    rows = ordered.chunk_rows()
    names = {t: f"__sum_{i}" for i, t in enumerate(totals)}
    ends = _chunk_ends(ordered, rows, [F.sum(totals[t]).alias(n) for t, n in names.items()])
    carried = _carried(ends, ordered.series, {n: F.sum(n) for n in names.values()})
    window = Window.partitionBy(*ordered.series, _CHUNK).orderBy(RN).rowsBetween(Window.unboundedPreceding, 0)
    joined = _join_carried(ordered.df.withColumn(_CHUNK, _chunk_of(rows)), carried, ordered.series)
    summed = joined.withColumns(
        {t: F.sum(totals[t]).over(window) + F.coalesce(F.col(n), F.lit(0)) for t, n in names.items()}
    )
    return ordered.with_df(summed.drop(_CHUNK, *names.values()))


def series_position(ordered: OrderedRows, name: str = "row_in_series") -> OrderedRows:
    """Add the zero-based position of each row within its series."""
    if not ordered.series:
        return ordered.with_df(ordered.df.withColumn(name, F.col(RN)))
    counted = running_total(ordered, {name: F.lit(1).cast("long")})
    return counted.with_df(counted.df.withColumn(name, F.col(name) - 1))
