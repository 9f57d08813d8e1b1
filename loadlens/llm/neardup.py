"""Near-duplicates by circulant MinHash, banding and exact verification.

Signatures take two permutations of the 32-bit numbers, sigma and pi: coordinate k of a
set is the least pi(sigma(x) - k), so pi shifted around by k places serves as the k-th
permutation. ``bands`` of ``rows`` coordinates make bucket keys; at similarity 0.85 a
pair shares none with a probability below one in a million.

Documents with equal sets are one class, and only classes are compared. Pairs within a
bucket are not listed: every member is compared with the bucket's hub, the class with
the smallest number. Jaccard distance is a metric, so with distance ``x`` to the hub

* members within the wanted distance of the hub are in one component already, and
* two others can be linked only if their ``x`` differ by that distance at the most.

What is left is compared in tiles: a hub's members are cut by ``x`` into bins of that
width and bins into blocks of bounded size; tiles pair blocks of the same or neighbouring
bins. All pairs of a tile are compared exactly, by one matrix product, and a spanning
forest of the links leaves the task. So every pair that shares a bucket is linked,
refuted, or tied through a component, on full sets.

Shingles are 64-bit hashes of word sequences; a set's name is 128 bits of its sums, and a
class's number 64 bits of that.

Edge cases: texts that are null or have no word have no shingles, are linked with nothing
and keep their own id; a row with a null id is linked with nothing and has no component;
rows with one id and several texts belong to the components of their texts; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.llm.common import free_worker
from loadlens.llm.components import connected
from loadlens.llm.words import mix64, span_hashes, window_hashes, word_spans
from loadlens.sources.shared import stage

BANDS, ROWS = 36, 7
BLOCK_SHINGLES, BLOCK_MEMBERS = 200_000, 512
_BLOCK = 1 << 14  # shingles that are permuted at once


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word ``size``-grams of an ASCII lower-cased text."""
    data = np.frombuffer(text.lower(), np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(span_hashes(data, starts, ends), min(size, len(starts))))


def set_name(shingles: np.ndarray) -> bytes:
    one = mix64(shingles ^ np.uint64(0x243F6A8885A308D3)).sum(dtype=np.uint64)
    two = mix64(shingles ^ np.uint64(0x13198A2E03707344)).sum(dtype=np.uint64)
    return np.array([one, two], ">u8").tobytes()


def _permute(x: np.ndarray) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    t = x >> np.uint32(16)
    for factor, shift in ((0x7FEB352D, 15), (0x846CA68B, 16)):
        x ^= t
        x *= np.uint32(factor)
        np.right_shift(x, np.uint32(shift), out=t)
    x ^= t
    return x


def signatures(sets: list[np.ndarray], length: int) -> np.ndarray:
    """Circulant MinHash signatures of sets that are not empty."""
    out = np.full((len(sets), length), 0xFFFFFFFF, np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= _BLOCK):
            size += len(sets[end])
            end += 1
        for begin in range(0, size, _BLOCK) if end == at + 1 else (0,):
            part = [sets[at][begin : begin + _BLOCK]] if end == at + 1 else sets[at:end]
            starts = np.cumsum([0, *map(len, part[:-1])])
            sigma = _permute((np.concatenate(part) & np.uint64(0xFFFFFFFF)).astype(np.uint32) ^ np.uint32(0x9E3779B9))
            for k in range(length):
                own = np.minimum.reduceat(_permute(sigma - np.uint32(k)), starts)
                np.minimum(out[at:end, k], own, out=out[at:end, k])
        at = end
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.tile(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), 1))
    wide = signature.astype(np.uint64).reshape(len(signature), bands, rows)
    for r in range(rows):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, r])
    return out.view(np.int64)


def fingerprints(
    documents: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, the text's ``hash``, ``n_shingles``, ``set`` and the ``bands`` of every row."""
    picked = documents.select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).cast("binary").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sets = [shingle_set(v.as_py() or b"", size) for v in batch.column(2)]
                some = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if some:
                    found = band_keys(signatures([sets[i] for i in some], bands * rows), bands, rows)
                    for i, row in zip(some, found, strict=True):
                        keys[i] = row
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_name(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "hash", "n_shingles", "set", "bands"],
                )

    return picked.mapInArrow(run, "doc_id long, hash long, n_shingles long, `set` binary, bands array<long>")


def _sets_of(documents: DataFrame, wanted: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """``set``, its ``shingles``: of the classes in ``wanted`` (``doc_id``, ``set``)."""
    # one column, staged: where it is small the documents need no shuffle
    ids = stage(wanted.select(F.col("doc_id").alias("__id")).distinct(), "wanted-documents")
    texts = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).join(
        ids, F.col("doc_id") == F.col("__id"), "left_semi"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                sets = [shingle_set(v.as_py() or b"", size) for v in whole.slice(start, 256).column(0)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([set_name(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["set", "shingles"],
                )

    found = texts.select("text").mapInArrow(run, "`set` binary, shingles array<long>")
    return found.join(wanted.select("set").distinct(), "set", "left_semi").dropDuplicates(["set"])


def linked_pairs(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of the pairs with ``100 * intersection >= percent * union``."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(shared) - 1
    row, column = row[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    for begin in range(0, int(shared.sum()), width):
        low, high = np.searchsorted(column, (begin, begin + width))
        block = np.zeros((len(sets), width), np.float32)
        block[row[low:high], column[low:high] - begin] = 1
        both += block @ block.T
    both = np.rint(both).astype(np.int64)
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def spanning_forest(linked: np.ndarray) -> list[tuple[int, int]]:
    root = np.arange(len(linked))
    out = []
    for i in range(len(linked)):
        for j in np.flatnonzero(linked[i, :i]):
            if root[i] != root[j]:
                out.append((i, int(j)))
                root[root == root[i]] = root[j]
    return out


def links(documents: DataFrame, classes: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """Edges (``a``, ``b``) between class numbers whose components are those of all links.

    ``classes`` has ``cls``, the class's number, its ``set``, smallest ``doc_id`` and ``bands``.
    """
    far = 1 - percent / 100
    # two numbers to a row, as there is a row for every band of every class
    buckets = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("cls").alias("hub"), F.max("cls").alias("last")).where("hub < last")
    # always by exchange: how many buckets are shared grows with the input
    members = stage(
        buckets.join(shared.select("bucket", "hub").hint("merge"), "bucket").select("hub", "cls").distinct(), "hub-members"
    )
    wanted = stage(members.select("cls").distinct().join(classes.select("cls", "set", "doc_id"), "cls"), "hub-classes")
    sets = stage(
        _sets_of(documents, wanted.select("doc_id", "set"), size, key, text).join(wanted.select("set", "cls"), "set").select("cls", "shingles"),
        "sets",
    )
    hubs = sets.select(F.col("cls").alias("hub"), F.col("shingles").alias("hub_shingles"))
    inter = F.size(F.array_intersect("shingles", "hub_shingles"))
    union = F.size("shingles") + F.size("hub_shingles") - inter
    compared = stage(
        members.where("cls <> hub").join(sets, "cls").join(hubs, "hub").select(
            "hub", "cls", F.size("shingles").alias("n"),
            (100 * inter >= percent * union).alias("linked"), (1 - inter / union).alias("x"),
        ),
        "hub-distances",
    )
    by_hub = compared.where("linked").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    # bin 0 is linked with the hub; the others are cut by distance
    binned = compared.withColumn(
        "bin", F.when(F.col("linked"), 0).otherwise(F.greatest(F.lit(1), F.ceil(F.col("x") / far - 1e-9).cast("int") - 1))
    )
    sizes = (
        binned.groupBy("hub", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("size"))
        .withColumn("blocks", F.greatest(F.ceil(F.col("size") / BLOCK_SHINGLES), F.ceil(F.col("n") / BLOCK_MEMBERS)).cast("int"))
        .groupBy("hub")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("bin", "blocks"))).alias("blocks"),
            F.sum("n").alias("all"), F.sum(F.when(F.col("bin") > 0, F.col("n")).otherwise(0)).alias("rest"),
        )
        .where("rest > 0 AND all > 1")
        .select("hub", "blocks")
    )
    tiles = F.expr(
        """flatten(array(
            IF(bin > 0, transform(sequence(0, blocks[bin] - 1), j ->
                named_struct('low', bin, 'i', least(own, j), 'high', bin, 'j', greatest(own, j))), array()),
            IF(blocks[bin + 1] IS NOT NULL, transform(sequence(0, coalesce(blocks[bin + 1], 1) - 1), j ->
                named_struct('low', bin, 'i', own, 'high', bin + 1, 'j', j)), array()),
            IF(blocks[bin - 1] IS NOT NULL, transform(sequence(0, coalesce(blocks[bin - 1], 1) - 1), j ->
                named_struct('low', bin - 1, 'i', j, 'high', bin, 'j', own)), array())
        ))"""
    )
    dealt = (
        binned.join(sizes, "hub")
        .withColumn("own", F.pmod(F.xxhash64("cls"), F.element_at("blocks", F.col("bin"))).cast("int"))
        .select("hub", "cls", F.explode(tiles).alias("t"))
        .select("hub", "cls", "t.low", "t.i", "t.high", "t.j")
    )
    tile = ["hub", "low", "i", "high", "j"]
    # a tile needs two members
    wanted = dealt.groupBy(*tile).count().where("count > 1").drop("count")
    rows = dealt.join(wanted, tile).join(sets, "cls")

    def compare(rows: pa.Table) -> pa.Table:
        numbers = rows["cls"].to_numpy()
        found = [x.values.to_numpy().view(np.uint64) for chunk in rows["shingles"].chunks for x in chunk]
        pairs = np.array(spanning_forest(linked_pairs(found, percent)), np.int64).reshape(-1, 2)
        return pa.table({"a": numbers[pairs[:, 0]], "b": numbers[pairs[:, 1]]})

    rest = rows.select(*tile, "cls", "shingles").groupBy(*tile).applyInArrow(compare, "a long, b long")
    return by_hub.unionByName(rest)


def components(
    documents: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id``, ``hash`` of the text, ``n_shingles`` and ``component_id`` (null if it has no links) for every row."""
    prints = stage(fingerprints(documents, size, bands, rows, key, text), "set-fingerprints")
    classes = stage(
        prints.where("`set` IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("set")
        .agg(F.min("doc_id").alias("doc_id"), F.min("bands").alias("bands"))
        .select("set", F.xxhash64("set").alias("cls"), "doc_id", "bands"),
        "set-classes",
    )
    roots = connected(links(documents, classes, size, percent, key, text))
    rooted = stage(
        classes.join(roots, F.col("cls") == F.col("node"), "left").select(
            "set", F.col("doc_id").alias("first"), F.coalesce("root", "cls").alias("root")
        ),
        "rooted-classes",
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("set", "component_id")
    # exact copies share a set: a very large group is one key of this join, which AQE splits
    found = prints.select("doc_id", "hash", "n_shingles", "set").join(named, "set", "left")
    return found.select(
        "doc_id", "hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row."""
    component = F.coalesce("component_id", "doc_id")
    return components(documents, **options).select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``documents`` with one row of every component: the smallest id, then text hash; repeated rows go too.

    Rows without words or without an id are linked with nothing and stay.
    """
    found = stage(
        components(documents, key=key, text=text, **options).where("component_id IS NOT NULL"), "near-components"
    )
    row = F.struct("doc_id", "hash")
    best = found.groupBy("component_id").agg(F.min(row).alias("best"))
    marked = found.join(best, "component_id").groupBy("doc_id", "hash").agg(
        F.max(row == F.col("best")).alias("best"), F.count(F.lit(1)).alias("n")
    )
    fate = stage(
        marked.where("NOT best OR n > 1").select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), "best"), "near-fate"
    )
    same = (F.col(key).cast("long") == F.col("__id")) & (F.xxhash64(text) == F.col("__hash"))
    alone = documents.join(fate, same, "left_anti")
    repeated = documents.join(fate.where("best"), same, "left_semi").dropDuplicates([key, text])
    return alone.unionByName(repeated)
