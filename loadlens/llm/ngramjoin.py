"""Jaccard join of word n-gram sets: size-banded tiles, bitmap bounds, exact intersection.

Two sets with a Jaccard similarity of ``percent`` differ in few elements for their sizes: at
most H = floor((100 - percent) * (a + b) / (100 + percent)). The 64-bit hashes of the elements
are cut into k = H + 3 ranges; each differing element spoils one range at the most, so three
ranges at least hold the same elements in both sets. What a range holds makes a key. A set
with at most two empty ranges shares a range that is not empty, so only sets with more empty
ranges have keys for those. k is that of the larger size, rounded up to a level; a set has the
keys of all levels that a partner can have.

Sets with a key in common have the least of them as their hub. What hangs together by hubs is
a tile where it fits one; otherwise a hub and its members are. Where these are too many, every member is compared with the hub first: a linked one is
*core*, the others are *near* where they could be linked with a core one (their distance from the
hub is at most twice the wanted one) and *far* where they can't; two core ones are in one
component anyway. The other pairs are compared in tiles: members are parted by size band (sets
of linked pairs are in the same or neighbouring bands) and into blocks; a tile holds two blocks.

In a tile every set has a bitmap of hashed elements. Bits in which two bitmaps differ count
elements that the sets do not share, which bounds their overlap from above; only pairs that
could be linked, and that are not in one component of the tile, are intersected as sorted
arrays. A spanning forest of the links leaves the task.

Sets are told apart by 64-bit numbers of their contents, elements by 64-bit hashes.

Edge cases: texts that are null or have no word have no set, are linked with nothing and keep
their own id; a row with a null id is linked with nothing and has no component; rows with one
id and several texts belong to the components of their texts; repeated rows and equal texts
are one set; texts of any length are taken whole; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import Marks, marks_of
from loadlens.llm.components import connected
from loadlens.llm.neardup import set_name, shingle_set
from loadlens.llm.words import mix64
from loadlens.sources.shared import stage

#: elements and sets of a block; empty ranges that need no key; bits of a bitmap
BLOCK_ELEMENTS, BLOCK_SETS = 150_000, 512
SLACK = 2
BITS_LEAST, BITS_MOST = 256, 1 << 15
_CELLS = 1 << 21  # words of bitmaps that are compared at once


def differing(a: int, b: int, percent: int) -> int:
    """Elements that only one of two linked sets of these sizes has, at the most."""
    return (100 - percent) * (a + b) // (100 + percent)


def levels_for(size: int, percent: int) -> list[int]:
    """Upper sizes of the levels at which a set of ``size`` can meet a larger or a smaller one."""
    most = 100 * size // percent
    out, level = [], 2
    while True:
        if level >= size and differing(level, level, percent):
            out.append(level)
        if level >= most:
            return out
        level = max(level + 1, level * 3 // 2)


def range_keys(elements: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a sorted set; two linked sets that differ share one."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(elements), dtype=np.uint64)))
    out = []
    for level in levels_for(len(elements), percent):
        k = differing(level, level, percent) + 1 + SLACK
        cuts = np.searchsorted(elements, np.arange(1, k, dtype=np.uint64) * np.uint64(2**64 // k))
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(elements)]))
        place = mix64(np.uint64(level << 32) + np.arange(k, dtype=np.uint64))
        keys = mix64((sums[ends] - sums[starts]) ^ place)
        empty = starts == ends
        out.append(keys if empty.sum() > SLACK else keys[~empty])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def number_of(elements: np.ndarray) -> int:
    return int(np.frombuffer(set_name(elements), ">i8")[0])


def fingerprints(documents: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """``doc_id``, ``n_shingles``, the set's number ``cls`` and its ``keys`` for every row."""
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                counts, numbers, keys = [], [], []
                for body in batch.column(1):
                    elements = shingle_set(body.as_py() or b"", size)
                    counts.append(len(elements))
                    numbers.append(number_of(elements) if len(elements) else None)
                    keys.append(range_keys(elements, percent).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(counts, pa.int64()), pa.array(numbers, pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "cls", "keys"],
                )

    return rows.mapInArrow(run, "doc_id long, n_shingles long, cls long, keys array<long>")


def _sets(documents: DataFrame, wanted: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """``cls`` and its ``elements`` of the documents in ``wanted`` (``doc_id``).

    An id with several texts or rows has several sets; the joins with ``cls`` sort that out.
    """
    ids = stage(wanted.select(F.col("doc_id").alias("__id")).distinct(), "wanted-documents")
    texts = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).join(
        ids, F.col("doc_id") == F.col("__id"), "left_semi"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                sets = [shingle_set(v.as_py() or b"", size) for v in whole.slice(start, 256).column(0)]
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number_of(s) for s in sets], pa.int64()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["cls", "elements"],
                )

    return stage(texts.select("text").mapInArrow(run, "cls long, elements array<long>"), "sets")


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A bitmap of hashed elements for every set, as wide as the largest set needs."""
    most = max(map(len, sets))
    bits = min(BITS_MOST, max(BITS_LEAST, 1 << (4 * most - 1).bit_length()))
    out = np.zeros((len(sets), bits), bool)
    for own, elements in zip(out, sets, strict=True):
        own[(mix64(elements) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def most_shared(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap of sets: a differing bit is an element that only one of them has."""
    differ = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return (size_a + size_b - differ) // 2


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _alike(inter: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | bool:
    return 100 * inter >= percent * (a + b - inter)


def tile_links(sets: list[np.ndarray], first: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets of two blocks, or within one.

    ``first`` marks those of the first block; where all are, the block is compared with itself.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    maps = bitmaps(sets)
    left = np.flatnonzero(first)
    right = left if first.all() else np.flatnonzero(~first)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    step = max(1, _CELLS // max(1, len(right) * maps.shape[1]))
    for begin in range(0, len(left), step):
        rows = left[begin : begin + step]
        bound = most_shared(maps[rows][:, None], maps[right][None], sizes[rows][:, None], sizes[right][None])
        least, most = np.minimum(sizes[rows][:, None], sizes[right][None]), np.maximum(sizes[rows][:, None], sizes[right][None])
        possible = (100 * least >= percent * most) & _alike(bound, least, most, percent)
        if right is left:
            possible &= right[None] > rows[:, None]
        for i, own in zip(rows.tolist(), possible, strict=True):
            for j in right[own].tolist():
                if find(i) != find(j) and _alike(shared(sets[i], sets[j]), int(sizes[i]), int(sizes[j]), percent):
                    out.append((i, j))
                    root[find(j)] = find(i)
    return out


def _with_hub(rows: DataFrame, percent: int) -> DataFrame:
    """``hub``, ``cls``, its size ``n`` and its ``side``: 0 core, 1 near, 2 far, of rows with both sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side, sizes = [], []
            for own, hub in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (x.values.to_numpy().view(np.uint64) for x in (own, hub))
                n = shared(a, b)
                union = len(a) + len(b) - n
                sizes.append(len(a))
                # similarity of 1 - 2 * (1 - percent / 100) or more
                side.append(0 if 100 * n >= percent * union else 1 if 100 * n >= (2 * percent - 100) * union else 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(side, pa.int32())],
                ["hub", "cls", "n", "side"],
            )

    return rows.select("hub", "cls", "elements", "hub_elements").mapInArrow(run, "hub long, cls long, n long, side int")


#: tiles of a row: its own block against every block of the units that it can be linked with. A unit
#: is a size band and a side; units of core sets meet only those of near ones, far ones no core ones.
_TILES = """flatten(transform(
    filter(flatten(transform(array(band - 1, band, band + 1), b -> transform(array(0, 1, 2), s -> named_struct('b', b, 's', s)))),
        u -> blocks[u.b * 3 + u.s] IS NOT NULL AND (side = 1 OR u.s = 1 OR (side = 2 AND u.s = 2))),
    u -> transform(sequence(0, blocks[u.b * 3 + u.s] - 1), j -> IF(
        band * 3 + side < u.b * 3 + u.s OR (band * 3 + side = u.b * 3 + u.s AND own <= j),
        named_struct('low', band * 3 + side, 'i', own, 'high', u.b * 3 + u.s, 'j', j),
        named_struct('low', u.b * 3 + u.s, 'i', j, 'high', band * 3 + side, 'j', own)))))"""


_TILE = ("hub", "low", "i", "high", "j")


def _large_tiles(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links with hubs, and rows of tiles for the rest, of hubs with more members than a tile takes."""
    hubs = members.select("hub").distinct()
    hub_sets = hubs.join(sets.select(F.col("cls").alias("hub"), F.col("elements").alias("hub_elements")), "hub")
    apart = members.where("cls <> hub").select("hub", "cls").join(sets, "cls").join(hub_sets, "hub")
    compared = stage(_with_hub(apart, percent).distinct(), "hub-sides")
    by_hub = compared.where("side = 0").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    # neighbouring bands differ by a little more than linked sizes can
    banded = compared.withColumn("band", F.floor(F.log("n") / float(-np.log(percent / 100) * 1.0001)).cast("int"))
    units = (
        banded.groupBy("hub", (F.col("band") * 3 + F.col("side")).alias("unit"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("size"))
        .withColumn("blocks", F.greatest(F.ceil(F.col("size") / BLOCK_ELEMENTS), F.ceil(F.col("n") / BLOCK_SETS)).cast("int"))
        .groupBy("hub")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("unit", "blocks"))).alias("blocks"), F.sum("n").alias("n_all"),
            F.sum(F.when(F.col("unit") % 3 > 0, F.col("n")).otherwise(0)).alias("n_rest"),
        )
        .where("n_rest > 0 AND n_all > 1")
        .select("hub", "blocks")
    )
    dealt = (
        banded.join(units, "hub")
        .withColumn("own", F.expr("cast(pmod(xxhash64(cls), blocks[band * 3 + side]) as int)"))
        .select("hub", "cls", (F.col("band") * 3 + F.col("side")).alias("unit"), "own", F.explode(F.expr(_TILES)).alias("t"))
        .select("hub", "cls", "t.low", "t.i", "t.high", "t.j", F.expr("unit = t.low AND own = t.i").alias("first"))
        .distinct()
    )
    # a tile of one block needs two sets, one of two blocks a set of each
    full = dealt.groupBy(*_TILE).agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("same"), F.max("first").alias("one"))
    full = full.where("n > 1 AND one AND (NOT same OR (low = high AND i = j))").select(*_TILE)
    return by_hub, dealt.join(full, list(_TILE))


def _too_large(members: DataFrame, by: str) -> DataFrame:
    """The groups that do not fit a tile."""
    totals = members.groupBy(by).agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("size"))
    return stage(totals.where(f"sets > {BLOCK_SETS} OR (size > {BLOCK_ELEMENTS} AND sets > 2)").select(by), "large-groups")


def _only(sets: DataFrame, marks: Marks) -> DataFrame:
    """The sets whose number is marked; the others need not be moved."""
    sent = sets.sparkSession.sparkContext.broadcast((marks.slots, marks.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Marks(*sent.value).table()
        for batch in batches:
            yield batch.filter(pa.array(Marks.hit(batch.column(0).to_numpy(), table)))

    return sets.mapInArrow(run, "cls long, elements array<long>")


def _marked(classes: DataFrame, marks: Marks) -> DataFrame:
    """``cls``, ``n`` and ``key`` of the keys that are marked; the others, most of all, go nowhere."""
    sent = classes.sparkSession.sparkContext.broadcast((marks.slots, marks.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Marks(*sent.value).table()
        for batch in batches:
            keys = batch.column(2).flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), [len(x) for x in batch.column(2)])
            kept = Marks.hit(keys, table)
            own = batch.select(["cls", "n"]).take(pa.array(owner[kept], pa.int64()))
            yield own.append_column("key", pa.array(keys[kept]))

    return classes.select("cls", "n", "keys").mapInArrow(run, "cls long, n long, key long")


def links(documents: DataFrame, classes: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """Edges (``a``, ``b``) between classes whose components are those of all links.

    ``classes`` has ``cls``, its smallest ``doc_id``, its number ``n`` of elements and its ``keys``.
    """
    keyed = classes.select("cls", F.explode("keys").alias("key"))
    common = stage(
        keyed.groupBy("key").agg(F.min("cls").alias("hub"), F.max("cls").alias("last")).where("hub < last").select("key", "hub"),
        "shared-keys",
    )
    # joins go by exchange at every size: how much they join grows with the input
    members = stage(
        _marked(classes, marks_of(common, "key")).join(common.hint("merge"), "key").select("hub", "cls", "n").distinct(), "hub-members"
    )
    wanted = members.select("cls").distinct().join(classes.select("cls", "doc_id"), "cls")
    sets = _sets(documents, wanted, size, key, text)
    # what hangs together by keys is a tile where it fits one; else each hub with its members; else blocks of them
    roots = connected(members.where("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")))
    placed = stage(members.join(roots, F.col("cls") == F.col("node")).select("root", "hub", "cls", "n"), "hub-members")
    wide = _too_large(placed.select("root", "cls", "n").distinct(), "root")
    rest = placed.join(wide, "root", "left_semi")
    large = _too_large(rest, "hub")
    whole = placed.join(wide, "root", "left_anti").select(F.col("root").alias("hub"), "cls").distinct()
    small = whole.unionByName(rest.join(large, "hub", "left_anti").select("hub", "cls")).select(
        "hub", "cls", *[F.lit(0).alias(c) for c in _TILE[1:]], F.lit(True).alias("first")
    )
    cut = stage(rest.join(large, "hub", "left_semi").select("hub", "cls"), "large-members")
    by_hub, tiles = _large_tiles(cut, _only(sets, marks_of(cut, "cls")), percent)
    rows = small.unionByName(tiles).hint("merge").join(sets, "cls")

    def compare(table: pa.Table) -> pa.Table:
        numbers = table["cls"].to_numpy()
        own = [x.values.to_numpy().view(np.uint64) for chunk in table["elements"].chunks for x in chunk]
        first = table["first"].to_numpy()
        pairs = np.array(tile_links(own, first, percent), np.int64).reshape(-1, 2)
        return pa.table({"a": numbers[pairs[:, 0]], "b": numbers[pairs[:, 1]]})

    rest = rows.select(*_TILE, "cls", "first", "elements").groupBy(*_TILE).applyInArrow(compare, "a long, b long")
    return by_hub.unionByName(rest)


def jaccard_components(
    documents: DataFrame, size: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row: the smallest id reachable by links."""
    if not 50 < percent < 100:
        raise ValueError("percent must be between 51 and 99")
    prints = stage(fingerprints(documents, size, percent, key, text), "ngram-sets")
    classes = stage(
        prints.where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls").agg(
            F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.min("keys").alias("keys")
        ),
        "ngram-classes",
    )
    roots = connected(links(documents, classes, size, percent, key, text))
    rooted = stage(
        classes.select("cls", "doc_id").join(roots, F.col("cls") == F.col("node"), "left")
        .select("cls", "doc_id", F.coalesce("root", "cls").alias("root")),
        "rooted-classes",
    )
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("cls", "component_id")
    found = prints.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
    # a row with a null id has no component
    return found.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
