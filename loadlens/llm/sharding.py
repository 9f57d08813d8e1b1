"""Sharding by histogram sort: shards of nearly equal bytes in one exchange.

Rows are ordered by a hash of their text, then a hash of their id, so equal texts lie
side by side. The splitters between shards are found by counting: every pass counts
the exact bytes and rows below a grid of probe keys inside each splitter's interval, in
one aggregate over the staged keys, and narrows the interval to one cell of the grid
until the bytes below a probe are within ``tolerance`` of what is wanted. A group of
equal texts is cut only if no border between groups meets the tolerance. Then rows
move once, to the part that the splitters give, and are numbered there.

Every shard is made of ``parts`` equal parts, each a task of the exchange, so neither a
shard nor a group of equal texts has to fit in one. What the driver holds is the grid:
one pass's cells, ``2 ** GRID_BITS`` a splitter at most.

Edge cases: a null text has no bytes and is ordered as the empty text's neighbour by its
own hash; null ids are ordered like one id; rows equal in text and id share one key and
are not parted; with fewer distinct keys than shards some shards are empty, as all are
for an empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.sources.shared import stage

FIRST_GRID_BITS, GRID_BITS = 16, 8  # 64 bits less the first grid's are a multiple of the others'
TOLERANCE = 0.002
PARTS = 8
_LOW = -(1 << 63)


@dataclass
class Splitter:
    """The search for a key below which ``wanted`` bytes lie, give or take ``slack``.

    The key is among the ``2 ** bits`` keys from ``low`` on, of the level that is being
    probed: the text's hash, or within the one text ``text`` the id's hash.
    """

    wanted: float
    slack: float
    low: int = _LOW
    bits: int = 64
    below: int = 0
    rows_below: int = 0
    text: int | None = None
    key: tuple[int, int] | None = None  # rows below (text, id) are left of the splitter

    @property
    def interval(self) -> tuple[int, int, int, bool]:
        """First (text, id) of the interval, its bits, and whether it lies within one text."""
        return (self.low, _LOW, self.bits, False) if self.text is None else (self.text, self.low, self.bits, True)

    def settle(self, first: int, below: int, rows: int) -> None:
        self.key = (first, _LOW) if self.text is None else (self.text, first)
        self.below, self.rows_below = below, rows

    def narrow(self, cells: list[tuple[int, int, int]], grid_bits: int) -> None:
        """Settle on a border of the grid, or go on inside the cell the splitter falls into."""
        width = max(0, self.bits - grid_bits)
        below, rows = self.below, self.rows_below
        for cell, size, count in cells:
            low = self.low + (cell << width)
            above, rows_above, after = below + size, rows + count, low + (1 << width)
            if above < self.wanted:
                below, rows = above, rows_above
                continue
            left, right = self.wanted - below, above - self.wanted
            if left <= self.slack and left <= right or after > -_LOW - 1:
                self.settle(low, below, rows)
            elif right <= self.slack or count == 1 and right < left:
                self.settle(after, above, rows_above)
            elif count == 1:
                self.settle(low, below, rows)
            elif width:
                self.low, self.bits, self.below, self.rows_below = low, width, below, rows
            elif self.text is None:  # one text is too large to stay whole: go on by id
                self.text, self.low, self.bits, self.below, self.rows_below = low, _LOW, 64, below, rows
            elif left <= right:
                self.settle(low, below, rows)
            else:
                self.settle(after, above, rows_above)
            return
        self.settle(self.low + (1 << self.bits) - 1, below, rows)


def keyed(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The narrow rows that are sorted: id, size and the two halves of the sort key."""
    words = F.col(text)
    return documents.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(words), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(words, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(words).alias("__k1"),
        F.xxhash64(F.col(key), F.lit("id")).alias("__k2"),
    )


def _count_cells(rows: DataFrame, intervals: list[tuple], grid_bits: int) -> dict[tuple, list[tuple[int, int, int]]]:
    """Exact bytes and rows in every filled grid cell of the intervals, in one aggregate."""

    def lookup(values: list, kind: str = "long") -> Column:
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("__space"))

    widths = [max(0, bits - grid_bits) for _, _, bits, _ in intervals]
    ends = [(t, i + (1 << bits) - 1) if deep else (t + (1 << bits) - 1, -_LOW - 1) for t, i, bits, deep in intervals]
    inside = (F.col("__k1") < lookup([e[0] for e in ends])) | (
        (F.col("__k1") == lookup([e[0] for e in ends])) & (F.col("__k2") <= lookup([e[1] for e in ends]))
    )
    key = F.when(lookup([i[3] for i in intervals], "boolean"), F.col("__k2")).otherwise(F.col("__k1"))
    # as unsigned numbers the keys of an interval differ in their last bits only
    shifted = F.call_function("shiftrightunsigned", key.bitwiseXOR(F.lit(_LOW)), lookup(widths, "int"))
    found = (
        rows.select("size", "__k1", "__k2", _at_or_below([i[:2] for i in intervals]).alias("__space"))
        .where("__space > 0")
        .where(inside)
        .groupBy("__space", shifted.bitwiseAND(F.lit((1 << grid_bits) - 1)).alias("__cell"))
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .collect()
    )
    out: dict[tuple, list[tuple[int, int, int]]] = {i: [] for i in intervals}
    for r in found:
        out[intervals[r["__space"] - 1]].append((r["__cell"], r["bytes"], r["rows"]))
    return {k: sorted(v) for k, v in out.items()}


def splitters(rows: DataFrame, shards: int, parts: int = PARTS, tolerance: float = TOLERANCE) -> list[Splitter]:
    """The ``shards * parts - 1`` inner splitters over staged ``keyed`` rows, in order.

    Borders between shards keep to ``tolerance`` of a shard, those between the parts of a
    shard only serve to spread the work and keep to a twentieth of a part.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    pieces = shards * parts
    found = [
        Splitter(total * i / pieces, tolerance * total / shards if i % parts == 0 else total / pieces / 20)
        for i in range(1, pieces)
    ]
    bits = FIRST_GRID_BITS
    while open_ := [s for s in found if s.key is None]:
        cells = _count_cells(rows, sorted({s.interval for s in open_}), bits)
        for s in open_:
            s.narrow(cells[s.interval], bits)
        bits = GRID_BITS
    for i, s in enumerate(found, 1):  # a looser border inside a shard may have passed the shard's own
        if i % parts:
            low = found[i // parts * parts - 1] if i >= parts else None
            high = found[i // parts * parts + parts - 1] if i // parts < shards - 1 else None
            for border in (low, high):
                if border and (s.key < border.key if border is low else s.key > border.key):
                    s.key, s.below, s.rows_below = border.key, border.below, border.rows_below
    return found


def _at_or_below(keys: list[tuple[int, int]]) -> Column:
    """How many of the ascending (text, id) keys are at or below the row's, by a tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        k1, k2 = keys[middle]
        left = F.col("__k1") < F.lit(k1)
        if k2 != _LOW:
            left = left | ((F.col("__k1") == F.lit(k1)) & (F.col("__k2") < F.lit(k2)))
        return F.when(left, tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(keys))


def shard(
    documents: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", parts: int = PARTS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and the row's gapless ``slot`` in its shard."""
    if shards < 1 or parts < 1:
        raise ValueError("there must be a shard and a part")
    rows = stage(keyed(documents, key, text), "shard-keys")
    found = splitters(rows, shards, parts, tolerance)
    # rows below each part, counted on the way
    starts = [0, *(s.rows_below for s in found)]
    first = F.array(*[F.lit(n - starts[i // parts * parts]).cast("long") for i, n in enumerate(starts)])
    part = F.col("__part")
    # the only exchange: rows go to the task of their part
    order = Window.partitionBy("__part").orderBy("__k1", "__k2", "doc_id")
    return (
        rows.withColumn("__part", _at_or_below([s.key for s in found]))
        .withColumn("__row", F.row_number().over(order))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.floor(part / parts).cast("int").alias("shard"),
            (F.element_at(first, part + 1) + F.col("__row") - 1).cast("long").alias("slot"),
        )
    )
