"""Benchmark decontamination: SimHash windows of item size, searched by Hamming blocks.

A document window of as many words as an item is a match if the weighted Jaccard
similarity of their word shingles (the smaller over the larger of the counts, summed) is
``threshold`` or more. Letter case does not count: documents and items are compared in lower case.

1. Only windows that could match are fingerprinted. Of windows of equal size, similarity
   ``t`` means that at least ``2t / (1 + t)`` of the shingles are the item's own, so a
   window with fewer shingles of items of its size is out. This loses nothing.
2. The SimHash of a window has 64 bits; bit i is the majority of bit i of its shingles'
   hashes. Counters of four bits share a long (16 bits each), so 16 sums make one.
3. Multi-index search: fingerprints within ``radius`` of 64 bits agree within
   ``radius // 8`` bits in at least one of 8 blocks of 8 bits. Items are entered under
   every value of a block so near to theirs, windows look up their own blocks, together
   with the size; that finds all fingerprints within the radius, which are then counted
   exactly.
4. Exact weighted similarity of the shingles themselves decides.

The radius limits what step 3 finds: at similarity 0.8 the expected distance is 10 bits with
a deviation of 3, so the default of 23 leaves out fewer than one such pair in 10,000.

Edge cases: null texts and texts without words match nothing; an item or document with
fewer words than a shingle is one shingle; items with equal texts match each, and the
texts of one id are searched each; rows equal in id and text count once, items also if their
texts differ in letter case only; null ids are an id of their own; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.sources.shared import stage

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 23
BLOCKS, BLOCK_BITS = 8, 8
LANES = 16
_EACH_LANE = 0x0001000100010001


def words_of(text: Column) -> Column:
    """Words of a text in lower case."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles_of(words: Column, size: int = SHINGLE) -> Column:
    """All shingles in order, as strings; a shorter text is one shingle, no word is none."""
    n = F.size(words)
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))),
            lambda i: F.array_join(F.slice(words, i, size), " "),
        )
    )


def _hash_rows(documents: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``doc``, ``hash`` of the text, and position and hash of every shingle."""
    n = F.size("words")
    first = documents.where(F.col(text).isNotNull()).select(
        F.col(key).alias("doc"), F.xxhash64(text).alias("hash"), words_of(F.col(text)).alias("words")
    )
    # the words of a shingle side by side: rows are hashed by compiled code, not one array at a time
    columns = [F.slice("words", k + 1, F.greatest(n - k, F.lit(0))).alias(f"w{k}") for k in range(size)]
    rows = first.where("size(words) > 0").select(
        "doc", "hash", n.alias("n"), F.posexplode(F.arrays_zip(*columns)).alias("pos", "w")
    )
    whole = F.col("pos") <= F.greatest(F.col("n") - size, F.lit(0))
    return rows.where(whole).select("doc", "hash", "pos", _shingle_hash([F.col(f"w.w{k}") for k in range(size)]).alias("h"))


def _shingle_hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def item_rows(benchmark: DataFrame, key: str = "item_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Items with words: ``item``, ``item_hash`` of the text in lower case, number of ``words`` and the ``shingles``."""
    words = words_of(F.col(text))
    return (
        benchmark.where(F.col(text).isNotNull())
        .select(F.col(key).alias("item"), F.xxhash64(F.lower(text)).alias("item_hash"), words.alias("w"))
        .where("size(w) > 0")
        .dropDuplicates(["item", "item_hash"])
        .select("item", "item_hash", F.size("w").alias("words"), shingles_of(F.col("w"), size).alias("shingles"))
    )


def _hashes(shingles: Column, size: int) -> Column:
    """The hashes of shingle strings, equal to those of ``_hash_rows``."""

    def one(s: Column) -> Column:
        words = F.split(s, " ")
        return _shingle_hash([F.get(words, F.lit(k)) for k in range(size)])

    return F.transform(shingles, one)


def candidate_windows(documents: DataFrame, items: DataFrame, threshold: float, key: str, text: str, size: int) -> DataFrame:
    """Windows (document, first word, number of words) with enough shingles of items of their size."""
    known = (
        items.select("words", F.explode(_hashes(F.col("shingles"), size)).alias("h"))
        .groupBy("h")
        .agg(F.collect_set("words").alias("sizes"))
    )
    # staged, so that its size decides how it is joined; documents are as many as they are
    known = stage(known, "item-shingles")
    anchors = (
        _hash_rows(documents, key, text, size)
        .join(known, "h")
        .select("doc", "hash", "pos", F.explode("sizes").alias("words"))
    )
    shingles = F.greatest(F.col("words") - size + 1, F.lit(1))
    need = F.ceil(2 * threshold / (1 + threshold) * shingles - 1e-9).cast("int")
    at = (
        anchors.groupBy("doc", "hash", "words")
        .agg(F.sort_array(F.collect_set("pos")).alias("at"))
        .withColumns({"shingles": shingles, "need": need})
        .where("size(at) >= need")
    )
    # the i-th to the (i + need - 1)-th anchor lie in windows that start in this range
    low = "at[i + need - 1] - shingles + 1"
    starts = F.expr(
        "array_distinct(flatten(transform(filter(sequence(0, size(at) - need), i -> "
        f"at[i + need - 1] - at[i] < shingles), i -> sequence(greatest(0, {low}), at[i]))))"
    )
    return at.select("doc", "hash", "words", F.explode(starts).alias("start"))


def simhash(hashes: Column) -> list[Column]:
    """Sums of the bits of the hashes: 16 longs of 4 counters, aggregates over shingle rows."""
    return [
        F.sum(F.shiftrightunsigned(hashes, k).bitwiseAND(F.lit(_EACH_LANE))).alias(f"lane{k}") for k in range(LANES)
    ]


def fingerprint(total: Column) -> Column:
    """Bit i is set if more than half of ``total`` hashes have it."""
    out = F.lit(0).cast("long")
    for k in range(LANES):
        for lane in range(4):
            count = F.shiftrightunsigned(F.col(f"lane{k}"), 16 * lane).bitwiseAND(F.lit(0xFFFF))
            bit = 1 << (k + 16 * lane)
            out = out.bitwiseOR(F.when(count * 2 > total, F.lit(bit - (1 << 64) if bit >> 63 else bit)).otherwise(F.lit(0)))
    return out


def blocks_of(print_: Column) -> Column:
    return F.array(*[F.shiftrightunsigned(print_, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int") for b in range(BLOCKS)])


def near_values(radius: int) -> list[int]:
    """Bit masks of a block with at most ``radius // BLOCKS`` bits."""
    return [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= radius // BLOCKS]


def _fingerprints(rows: DataFrame, by: list[str], size: int) -> DataFrame:
    exploded = rows.select(*by, F.explode(_hashes(F.col("shingles"), size)).alias("h"))
    sums = exploded.groupBy(*by).agg(*simhash(F.col("h")), F.count(F.lit(1)).alias("total"))
    return sums.select(*by, fingerprint(F.col("total")).alias("print"))


def weighted_similarity(left: Column, right: Column) -> Column:
    """Shared over all shingles, each counted as often as it occurs."""

    def numbered(shingles: Column) -> Column:
        # the n-th occurrence of a shingle is an element of its own, so sets count multiplicity
        return F.transform(
            shingles,
            lambda s, i: F.struct(s.alias("s"), F.size(F.filter(F.slice(shingles, 1, i + 1), lambda t: t == s)).alias("n")),
        )

    shared = F.size(F.array_intersect(numbered(left), numbered(right)))
    return shared / (F.size(left) + F.size(right) - shared)


def contaminated(
    documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS,
    size: int = SHINGLE, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row for each document, text and matching window: ``doc``, ``hash``, ``item``, ``start``, ``words``, ``similarity``."""
    items = stage(item_rows(benchmark, item_key, item_text, size), "items")
    starts = stage(candidate_windows(documents, items, threshold, key, text, size), "windows")
    texts = documents.where(F.col(text).isNotNull()).select(
        F.col(key).alias("__doc"), F.xxhash64(text).alias("__hash"), F.col(text).alias("__text")
    )
    by_document = starts.groupBy("doc", "hash").agg(F.collect_set(F.struct("start", "words")).alias("at"))
    same = F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("hash") == F.col("__hash"))

    def cut(a: Column) -> Column:
        shingles = shingles_of(F.slice("w", a["start"] + 1, a["words"]), size)
        return F.struct(a["start"].alias("start"), a["words"].alias("words"), shingles.alias("shingles"))

    windows = stage(
        texts.join(by_document, same)
        .dropDuplicates(["__doc", "__hash"])
        .select("doc", "hash", words_of(F.col("__text")).alias("w"), "at")
        # a document's words must not be copied into a row for each window
        .select("doc", "hash", F.explode(F.transform("at", cut)).alias("a"))
        .select("doc", "hash", "a.start", "a.words", "a.shingles"),
        "window-shingles",
    )
    place = ["doc", "hash", "start", "words"]
    # windows with the same words, such as a passage that many documents share, are looked up once
    content = F.xxhash64("shingles").alias("content")
    distinct = windows.select(*place, "shingles", content)
    unique = distinct.groupBy("content", "words").agg(F.min("shingles").alias("shingles"))
    unique = stage(unique, "distinct-windows")
    prints = _fingerprints(unique, ["content", "words"], size)
    item_prints = _fingerprints(items, ["item", "item_hash", "words"], size)
    entered = item_prints.select(
        "item", "item_hash", F.col("words").alias("item_words"), F.col("print").alias("item_print"),
        F.posexplode(blocks_of(F.col("print"))).alias("block", "own"),
    ).select("item", "item_hash", "item_words", "item_print", "block", F.explode(F.array(*[F.lit(m) for m in near_values(radius)])).alias("mask"), "own")
    entered = entered.withColumn("value", F.col("own").bitwiseXOR(F.col("mask"))).drop("own", "mask")
    looked_up = prints.select("*", F.posexplode(blocks_of(F.col("print"))).alias("block", "value"))
    near = (
        looked_up.join(entered, ["block", "value"])
        .where("words = item_words")
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
        .select("content", "words", "item", "item_hash")
        .distinct()
    )
    known = items.select(
        F.col("item").alias("__item"), F.col("item_hash").alias("__item_hash"), F.col("shingles").alias("item_shingles")
    )
    similarity = weighted_similarity(F.col("shingles"), F.col("item_shingles"))
    verified = (
        near.join(unique, ["content", "words"])
        .join(known, (F.col("item_hash") == F.col("__item_hash")) & F.col("item").eqNullSafe(F.col("__item")))
        .select("content", "words", "item", similarity.alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )
    return distinct.drop("shingles").join(verified, ["content", "words"]).select(*place, "item", "similarity")


def matches(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document and item: its best window, the first of the best, and how many match."""
    best = F.max(F.struct("similarity", (-F.col("start")).alias("start"), "words"))
    return (
        contaminated(documents, benchmark, **options)
        .groupBy("doc", "item")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("n_windows"))
        .select(
            F.col("doc").alias("doc_id"),
            F.col("item").alias("item_id"),
            F.col("best.similarity").alias("similarity"),
            (-F.col("best.start")).cast("long").alias("start_word"),
            F.col("best.words").cast("long").alias("n_words"),
            "n_windows",
        )
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``documents`` without those that hold a benchmark item."""
    found = contaminated(documents.select(key, text), benchmark, key=key, text=text, **options)
    hit = stage(found.select(F.col("doc").alias("__hit_doc"), F.col("hash").alias("__hit_hash")).distinct(), "contaminated")
    same = F.col(key).eqNullSafe(F.col("__hit_doc")) & (F.xxhash64(text) == F.col("__hit_hash"))
    return documents.join(hit, same, "left_anti")
