"""Statistics of row windows, by chunks of rows in tasks.

``add_frames`` has lags and narrow windows. All rows of a chunk take their next value at once, the
oldest first, as Spark's window frames do one row after the other: the sums have the same digits.
The rest is for wide windows, with a cost that does not grow with the width.

Rows are cut into chunks with the rows before them, as for window frames, and a task
slides over one chunk at a time:

* extremes: the chunk is cut into blocks as wide as the window, with running extremes from
  the start and from the end of each block; a window covers the end of one block and the
  start of the next, so two values answer it;
* moments: differences of running sums, relative to the chunk's mean;
* median: a sorted window that takes one value in and one out for every row.

Nulls and NaN are missing; a window without values has null statistics, one with a single
value no deviation.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loadlens.operators.ordered import RN, OrderedRows, halo_rows, with_halo

#: rows of a chunk of ``add_frames``, and of the pieces that it adds up at a time
FRAME_CHUNK_ROWS = 131_072
PIECE_ROWS = 8_192


def moving_extremes(values: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest of the ``rows`` values before each one; infinite where there is none."""
    n = len(values)
    out = []
    for sign in (1.0, -1.0):
        v = np.where(np.isnan(values), np.inf, sign * values)
        # the window of row i begins rows places before it: padding in front stands for what is not there
        blocks = -(-(n + rows) // rows)
        padded = np.full(blocks * rows, np.inf)
        padded[rows : rows + n] = v
        grid = padded.reshape(blocks, rows)
        from_start = np.minimum.accumulate(grid, axis=1).ravel()
        from_end = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        out.append(sign * np.minimum(from_end[:n], from_start[rows - 1 : rows - 1 + n]))
    return out[0], out[1]


def moving_moments(values: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, mean and sample deviation of the ``rows`` values before each one; NaN where undefined."""
    there = ~np.isnan(values)
    shift = values[there].mean() if there.any() else 0.0
    v = np.where(there, values - shift, 0.0)

    def over(x: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(x)))
        end = np.arange(len(x))
        return total[end] - total[np.maximum(end - rows, 0)]

    n, first, second = over(there.astype(np.int64)), over(v), over(v * v)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(n > 0, first / n + shift, np.nan)
        spread = np.maximum(second - first * first / n, 0.0)
        deviation = np.where(n > 1, np.sqrt(spread / (n - 1)), np.nan)
    # equal values leave rounding behind, not a deviation
    low, high = moving_extremes(values, rows)
    return n, mean, np.where((n > 1) & (low == high), 0.0, deviation)


def frame_moments(values: np.ndarray, there: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, mean and sample deviation of the ``rows`` values before each one, in the order of Spark's frames."""
    size = len(values)
    v = np.concatenate((np.zeros(rows), np.where(there, values, 0.0)))
    held = np.concatenate((np.zeros(rows, bool), there))
    out = np.empty((3, size))
    with np.errstate(divide="ignore", invalid="ignore"):
        for start in range(0, size, PIECE_ROWS):
            m = min(PIECE_ROWS, size - start)
            full = held[start : start + rows + m].all()
            n, total, mean, squares = (np.zeros(m) for _ in range(4))
            for k in range(start, start + rows):
                x = v[k : k + m]
                total += x
                delta = x - mean
                if full:
                    n += 1
                    step = delta / n
                    mean += step
                    squares += delta * (delta - step)
                    continue
                new = held[k : k + m]
                n += new
                step = delta / n
                mean = np.where(new, mean + step, mean)
                squares = np.where(new, squares + delta * (delta - step), squares)
            out[:, start : start + m] = n, total / n, np.sqrt(squares / (n - 1))
    return out[0], out[1], out[2]


def frame_extremes(values: np.ndarray, there: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest of the ``rows`` values before each one; NaN is larger than all others."""
    odd = there & np.isnan(values)
    low, high = moving_extremes(np.where(there, values, np.nan), rows)
    if odd.any():
        seen, end = np.concatenate(([0], np.cumsum(odd))), np.arange(len(values))
        has = seen[end] > seen[np.maximum(end - rows, 0)]
        low, high = np.where(has & np.isinf(low) & np.isinf(high) & (low > high), np.nan, low), np.where(has, np.nan, high)
    return low, high


def add_frames(ordered: OrderedRows, column: str, lags: Sequence[int], rolling: Sequence[int]) -> OrderedRows:
    """Lags, the change against the row before and the rolling columns of a column of doubles."""
    names = [f"{column}_Lag_{k}" for k in lags] + [f"{column}_Diff_1"]
    names += [f"{column}_Rolling_{rows}_{s}" for rows in rolling for s in ("Mean", "Std", "Max", "Min", "Median")]
    reach = max(*lags, *rolling, 1)
    spread, keys, own = with_halo(ordered, reach, FRAME_CHUNK_ROWS)
    kept = list(ordered.df.columns)

    def slide(table: pa.Table) -> pa.Table:
        table = table.sort_by(RN)
        cells = table[column].combine_chunks()
        there = cells.is_valid().to_numpy(zero_copy_only=False)
        v = cells.fill_null(0.0).to_numpy(zero_copy_only=False)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def before(k: int) -> tuple[np.ndarray, np.ndarray]:
            ahead = min(k, len(v))
            return (np.concatenate((np.zeros(ahead, x.dtype), x[: len(x) - ahead])) for x in (v, there))

        for k in lags:
            found.append(tuple(before(k)))
        x, known = before(1)
        with np.errstate(invalid="ignore"):
            found.append((v - x, there & known))
            for rows in rolling:
                n, mean, deviation = frame_moments(v, there, rows)
                low, high = frame_extremes(v, there, rows)
                found += [(mean, n > 0), (deviation, n > 1), (high, n > 0), (low, n > 0), ((high + low) / 2.0, n > 0)]
        for name, (x, known) in zip(names, found, strict=True):
            table = table.append_column(name, pa.array(x, pa.float64(), mask=~known, from_pandas=False))
        return table.filter(table["__own"]).select([*kept, *names])

    kinds = ", ".join([*(f"`{n}` {k}" for n, k in ordered.df.dtypes), *(f"`{n}` double" for n in names)])
    made = spread.withColumn("__own", own).groupBy(*keys).applyInArrow(slide, kinds)
    # with series a chunk may be in several groups
    chunk = None if ordered.series else halo_rows(ordered, reach, FRAME_CHUNK_ROWS)
    return replace(ordered, df=made.select(*kept, *[F.col(n) for n in names]), chunk=chunk)


def moving_median(values: np.ndarray, rows: int) -> np.ndarray:
    """Median of the ``rows`` values before each one."""
    out = np.full(len(values), np.nan)
    window: list[float] = []
    there = (~np.isnan(values)).tolist()
    listed = values.tolist()
    for i in range(len(listed)):
        size = len(window)
        if size:
            half = size // 2
            out[i] = window[half] if size % 2 else (window[half - 1] + window[half]) / 2
        if there[i]:
            insort(window, listed[i])
        if i >= rows and there[i - rows]:
            del window[bisect_left(window, listed[i - rows])]
    return out


def add_sliding(ordered: OrderedRows, column: str, rows: int, *, moments: bool = True, median: bool = False) -> OrderedRows:
    """Add the statistics of the ``rows`` rows before each one under the names of the rolling columns.

    ``moments`` adds mean, deviation, extremes and the middle of the range, ``median`` the median proper.
    """
    names = [f"{column}_Rolling_{rows}_{s}" for s in ("Mean", "Std", "Max", "Min", "Median")] if moments else []
    names += [f"{column}_Rolling_{rows}_True_Median"] if median else []
    spread, keys, own = with_halo(ordered, rows)
    kept = list(ordered.df.columns)

    def slide(table: pa.Table) -> pa.Table:
        table = table.sort_by(RN)
        v = table[column].cast(pa.float64()).to_numpy().astype(float)
        found: list[np.ndarray] = []
        if moments:
            _, mean, deviation = moving_moments(v, rows)
            low, high = moving_extremes(v, rows)
            low, high = (np.where(np.isinf(x) & np.isnan(mean), np.nan, x) for x in (low, high))
            found += [mean, deviation, high, low, (high + low) / 2]
        if median:
            found.append(moving_median(v, rows))
        for name, x in zip(names, found, strict=True):
            table = table.append_column(name, pa.array(x, pa.float64(), mask=np.isnan(x)))
        return table.filter(table["__own"]).select([*kept, *names])

    kinds = ", ".join([*(f"`{n}` {k}" for n, k in ordered.df.dtypes), *(f"`{n}` double" for n in names)])
    made = spread.withColumn("__own", own).groupBy(*keys).applyInArrow(slide, kinds)
    return ordered.with_df(made.select(*kept, *[F.col(n) for n in names]))
