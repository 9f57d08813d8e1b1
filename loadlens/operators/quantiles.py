"""Exact quantiles of many columns without collecting or sorting the values.

Every pass is one aggregate over the table for all columns together. A sketch
brackets each wanted order statistic, the next pass counts what lies inside the
bracket, and so on until the values strictly inside are few enough to sort.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SORTED_LIMIT = 100_000
_ACCURACY = 10_000


@dataclass
class _Target:
    column: str
    rank: int  # zero-based rank among the non-null values
    low: float | None = None  # the wanted value is > low ...
    high: float | None = None  # ... and < high
    below: int = 0  # values <= low
    inside: int = 0  # values strictly between
    value: float | None = None

    def within(self) -> Column:
        col = F.col(self.column)
        keep = col.isNotNull()
        if self.low is not None:
            keep = keep & (col > self.low)
        if self.high is not None:
            keep = keep & (col < self.high)
        return keep


def _narrow(df: DataFrame, targets: list[_Target]) -> None:
    """One sketch pass and one counting pass for all open targets."""
    # targets that still share their interval share one sketch
    sketches: dict[tuple, list[float]] = {}
    for t in targets:
        at = (t.rank - t.below) / max(t.inside - 1, 1)
        probs = sketches.setdefault((t.column, t.low, t.high), [])
        probs += [max(0.0, at - 3 / _ACCURACY), min(1.0, at + 3 / _ACCURACY)]
    found = {}
    for t in targets:
        key = (t.column, t.low, t.high)
        if key not in found:
            value = F.when(t.within(), F.col(t.column))
            found[key] = F.percentile_approx(value, sketches[key], _ACCURACY).alias(f"s{len(found)}")
    row = df.agg(*found.values()).first()
    edges = {key: iter(values) for key, values in zip(found, row, strict=True)}
    brackets = [(next(edges[k]), next(edges[k])) for k in ((t.column, t.low, t.high) for t in targets)]
    counts = []
    for i, t in enumerate(targets):
        low, high = brackets[i]
        col, here = F.col(t.column), t.within()
        counts += [
            F.count_if(here & (col < low)).alias(f"less{i}"),
            F.count_if(here & (col == low)).alias(f"low{i}"),
            F.count_if(here & (col > low) & (col < high)).alias(f"open{i}"),
            F.count_if(here & (col == high)).alias(f"high{i}"),
        ]
    seen = df.agg(*counts).first()
    for i, t in enumerate(targets):
        low, high = brackets[i]
        k = t.rank - t.below
        less, at_low, between = seen[f"less{i}"], seen[f"low{i}"], seen[f"open{i}"]
        at_high = seen[f"high{i}"] if high > low else 0
        if k < less:
            t.high, t.inside = low, less
        elif k < less + at_low:
            t.value = low
        elif k < less + at_low + between:
            t.low, t.high = low, high
            t.below, t.inside = t.below + less + at_low, between
        elif k < less + at_low + between + at_high:
            t.value = high
        else:
            t.low = high
            t.below += less + at_low + between + at_high
            t.inside -= less + at_low + between + at_high


def order_statistics(
    df: DataFrame, ranks: dict[str, list[int]], counts: dict[str, int], limit: int = SORTED_LIMIT
) -> dict[tuple[str, int], float]:
    """The values at the given zero-based ranks of each column."""
    targets = [_Target(c, k, inside=counts[c]) for c, ks in ranks.items() for k in sorted(set(ks))]
    while wide := [t for t in targets if t.value is None and t.inside > limit]:
        _narrow(df, wide)
    if few := [t for t in targets if t.value is None]:
        # targets of one column that share a bracket share the sorted values
        shared: dict[tuple, list[_Target]] = {}
        for t in few:
            shared.setdefault((t.column, t.low, t.high), []).append(t)
        picked = []
        for i, group in enumerate(shared.values()):
            values = F.array_sort(F.collect_list(F.when(group[0].within(), F.col(group[0].column))))
            picked.append(F.array(*[F.get(values, F.lit(t.rank - t.below)) for t in group]).alias(f"v{i}"))
        row = df.agg(*picked).first()
        for i, group in enumerate(shared.values()):
            for t, value in zip(group, row[f"v{i}"], strict=True):
                t.value = value
    return {(t.column, t.rank): t.value for t in targets}


def exact_quantiles(
    df: DataFrame, columns: list[str], probabilities: list[float], limit: int = SORTED_LIMIT
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of the non-null values of each column."""
    counted = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    filled = [c for c in columns if counted[c]]
    place = {c: [p * (counted[c] - 1) for p in probabilities] for c in filled}
    ranks = {
        c: [k for at in place[c] for k in (floor(at), min(floor(at) + 1, counted[c] - 1))] for c in filled
    }
    found = order_statistics(df, ranks, counted, limit)
    result: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    for c in filled:
        for i, at in enumerate(place[c]):
            k = floor(at)
            below, above = found[c, k], found[c, min(k + 1, counted[c] - 1)]
            result[c][i] = below + (at - k) * (above - below)
    return result
