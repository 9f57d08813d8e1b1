"""Phrase collocations: frequent word sequences by direct-address tiles of pair counts.

The frequent words of a language are ranked by frequency, and pairs of neighbouring words
are counted by the pair of their ranks. The square of all pairs is cut into tiles of 1024
by 1024 cells: a tile that gets many pairs at once is counted by one dense ``bincount``, the
others as sorted (pair, count) lists. Frequent pairs are then ranked themselves and take the
place of words: two pairs that overlap in a word make a sequence of three, and so on. A
sequence is frequent only if both sequences that it consists of are, so nothing is missed.

What tasks know of a level has a bounded size: the ranks of at most ``HEAD`` sequences, and one
bit table of ``1 << BITS`` bits in which every frequent sequence is marked. A frequent
sequence beyond the head goes by its hash instead of a rank and is counted in the sorted
lists; one that the table lets through by chance is counted like the others and then found to
be rare. Counts are exact, sums run over all tasks; sequences are told apart by 64-bit hashes.

Edge cases: a null text is empty, a null language is ``und``; texts of any length are taken in
parts that overlap by the words a sequence needs; repeated rows count as often as they occur;
an empty table gives no rows; ids and extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadlens.llm.words import among, mix64, span_hashes, word_spans
from loadlens.sources.shared import stage

HEAD, BITS = 1 << 18, 26
#: side of a tile as a power of two; pairs that make it dense
SIDE, DENSE = 10, 1 << 17
_PAIRS, _WORDS = 1 << 21, 150_000  # pairs and distinct words that a task holds at once
_BLOCK = 1 << 20  # bytes of text that are taken at once
_CUTS = b".,;:!?\n\x0b\x0c\r"
_CUT = among(_CUTS)
_APART = _CUT | among(b" \t")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


def segments(text: bytes, overlap: int, limit: int = _BLOCK) -> Iterator[bytes]:
    """Parts of a text; every sequence of ``overlap`` + 1 words of a piece is in exactly one."""
    begin, size = 0, limit
    while len(text) - begin > size:
        end = begin + size
        cut = max(text.rfind(c, begin + 1, end) for c in (bytes([b]) for b in _CUTS))
        if cut > begin:
            yield text[begin:cut]
            begin, size = cut, limit
            continue
        cut = max(text.rfind(b" ", begin, end), text.rfind(b"\t", begin, end))
        words = text[begin : max(cut, begin)].rsplit(None, overlap) if overlap else [text[begin : max(cut, begin)]]
        if cut <= begin or len(words) <= overlap or not words[0]:
            size *= 2  # few words, very long ones
            continue
        yield text[begin:cut]
        begin, size = (begin + len(words[0]), limit) if overlap else (cut, limit)
    yield text[begin:]


def language_hash(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode() or b"\0", np.uint8)
    return mix64(span_hashes(data, np.array([0]), np.array([len(data)])))[0]


@dataclass
class Words:
    """The words of several texts: where they are, hashes that depend on the language, and pieces."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    text: np.ndarray  # number of the text that a word is in
    next: np.ndarray  # whether the next word is in the same piece

    def sequences(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the sequences of ``length`` words from each word on, and whether there is one."""
        h, there = self.hashes, np.ones(len(self.hashes), bool)
        for _ in range(length - 1):
            h = joined_hash(h[:-1], h[1:])
            there = there[:-1] & there[1:] & self.next[: len(h)]
        return h, there


def joined_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * _FACTOR + mix64(second))


def words_of(texts: list[bytes], languages: np.ndarray) -> Words:
    body = b"\n".join(texts).lower()
    data = np.frombuffer(body, np.uint8)
    starts, ends = word_spans(data, _APART)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    text = np.searchsorted(offsets, starts, "right") - 1
    hashes = mix64(span_hashes(data, starts, ends) ^ languages[text]) if len(starts) else np.empty(0, np.uint64)
    piece = np.cumsum(_CUT[data], dtype=np.int32)[starts] if len(starts) else np.empty(0, np.int32)
    return Words(body, starts, ends, hashes, text, piece[:-1] == piece[1:])


def _blocks(batches: Iterator[pa.RecordBatch], overlap: int) -> Iterator[tuple[list[str], Words]]:
    """Words of (lang, text) rows, about a block of bytes at a time, and the languages of its texts."""
    texts: list[bytes] = []
    langs: list[str] = []
    size = 0
    known: dict[str, np.uint64] = {}

    def done() -> tuple[list[str], Words]:
        if len(known) > 100_000:
            known.clear()
        for lang in set(langs) - set(known):
            known[lang] = language_hash(lang)
        return langs, words_of(texts, np.array([known[x] for x in langs], np.uint64))

    for batch in batches:
        for lang, body in zip(batch.column(0), batch.column(1), strict=True):
            for part in segments(body.as_py() or b"", overlap):
                texts.append(part)
                langs.append(lang.as_py())
                size += len(part)
                if size >= _BLOCK:
                    yield done()
                    texts, langs, size = [], [], 0
    if texts:
        yield done()


def count_words(rows: DataFrame) -> DataFrame:
    """``lang``, ``word``, its ``h`` and count ``f`` of (lang, text) rows; the null word stands for all."""

    def table(found: dict) -> pa.RecordBatch:
        keys = list(found)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([found[k][0] for k in keys], pa.string()),
                pa.array([found[k][1].decode() for k in keys], pa.string()),
                pa.array(np.array(keys, np.uint64).view(np.int64)),
                pa.array([found[k][2] for k in keys], pa.int64()),
            ],
            ["lang", "word", "h", "f"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        totals: dict[str, int] = {}
        for langs, words in _blocks(batches, 0):
            distinct, first, counts = np.unique(words.hashes, return_index=True, return_counts=True)
            starts, ends, text = words.starts[first].tolist(), words.ends[first].tolist(), words.text[first].tolist()
            for k, h in enumerate(distinct.tolist()):
                own = found.get(h)
                if own is None:
                    found[h] = [langs[text[k]], words.data[starts[k] : ends[k]], int(counts[k])]
                else:
                    own[2] += int(counts[k])
            for t, n in enumerate(np.bincount(words.text, minlength=len(langs)).tolist()):
                totals[langs[t]] = totals.get(langs[t], 0) + n
            if len(found) > _WORDS:
                yield table(found)
                found = {}
        if found:
            yield table(found)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()),
                pa.nulls(len(totals), pa.int64()), pa.array(list(totals.values()), pa.int64()),
            ],
            ["lang", "word", "h", "f"],
        )

    counted = rows.mapInArrow(run, "lang string, word string, h long, f long")
    return counted.groupBy("lang", "word").agg(F.min("h").alias("h"), F.sum("f").alias("f"))


@dataclass
class Codes:
    """The frequent sequences of a level, in a bounded size."""

    head: np.ndarray  # hashes by rank
    slots: np.ndarray
    bits: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bit table, ranks by the low bits of a hash, and the head sorted with its ranks."""
        marked = np.zeros(1 << (BITS - 6), np.uint64)
        marked[self.slots] = self.bits
        size = max(10, (4 * len(self.head)).bit_length())
        direct = np.zeros(1 << size, np.int32)
        # of two that meet in a cell, the more frequent one stays
        direct[(self.head[::-1] & np.uint64((1 << size) - 1)).astype(np.int64)] = np.arange(len(self.head), dtype=np.int32)[::-1]
        return marked, direct, self.head, np.argsort(self.head)

    @staticmethod
    def number(hashes: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
        """Rank of each hash in the head; a number of 2 ** 62 or more beyond it; -1 if not marked."""
        marked, direct, head, order = tables
        out = np.full(len(hashes), -1, np.int64)
        bit = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        some = np.flatnonzero((marked[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1))
        h = hashes[some]
        found = (h & np.uint64(2**62 - 1) | np.uint64(2**62)).view(np.int64)
        if len(head):
            rank = direct[(h & np.uint64(len(direct) - 1)).astype(np.int64)]
            hit = head[rank] == h
            rest = np.flatnonzero(~hit)
            at = order[np.minimum(np.searchsorted(head, h[rest], sorter=order), len(head) - 1)]
            rank[rest] = at
            hit[rest] = head[at] == h[rest]
            found[hit] = rank[hit]
        out[some] = found
        return out


def codes_of(level: DataFrame) -> Codes:
    """Ranks of the most frequent sequences of ``level`` (``h``, ``f``), and a mark for every one."""
    step = F.floor(F.log2("f") * 16).cast("int")
    most, taken = None, 0
    for row in sorted(level.groupBy(step.alias("step")).count().collect(), reverse=True):
        taken += row["count"]
        if taken > HEAD:
            break
        most = row["step"]
    head = level.where(step >= most).select("h", "f").toArrow() if most is not None else None
    h = head["h"].to_numpy().view(np.uint64) if head is not None else np.empty(0, np.uint64)
    order = np.lexsort((h, -head["f"].to_numpy())) if len(h) else np.empty(0, np.int64)
    bit = F.shiftrightunsigned("h", 64 - BITS)
    # at most 2 ** (BITS - 6) rows, however many sequences there are
    marks = level.groupBy(F.shiftright(bit, 6).alias("slot")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
    ).toArrow()
    return Codes(h[order], marks["slot"].to_numpy().astype(np.int64), marks["bits"].to_numpy().view(np.uint64))


_CELL = (1 << SIDE) - 1
_TILES_WIDE = -(-HEAD >> SIDE)


def packed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Pairs of ranks as one number: the tile, then the cell in it."""
    tile = (first >> SIDE) * _TILES_WIDE + (second >> SIDE)
    return (tile << (2 * SIDE)) | ((first & _CELL) << SIDE) | (second & _CELL)


def unpacked(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tile = pairs >> (2 * SIDE)
    return (tile // _TILES_WIDE << SIDE) | (pairs >> SIDE & _CELL), (tile % _TILES_WIDE << SIDE) | (pairs & _CELL)


def count_tiles(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct packed pairs and their counts: dense tiles by bincount, the others sorted."""
    tile = (pairs >> (2 * SIDE)).astype(np.int32)
    filled = np.bincount(tile)
    out = []
    for t in np.flatnonzero(filled >= DENSE):
        cells = np.bincount(pairs[tile == t] & ((1 << (2 * SIDE)) - 1), minlength=1 << (2 * SIDE))
        some = np.flatnonzero(cells)
        out.append((some + (int(t) << (2 * SIDE)), cells[some]))
    thin = pairs[filled[tile] < DENSE]
    thin.sort()
    out.append(_sorted_counts(thin))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sorted_counts(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))[: len(pairs)])
    return pairs[starts], np.diff(np.concatenate((starts, [len(pairs)])))


def count_others(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and their counts, where one is no rank."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)])
    return a[starts], b[starts], np.diff(np.concatenate((starts, [len(a)])))


def count_pairs(rows: DataFrame, length: int, codes: Codes) -> DataFrame:
    """``a``, ``b`` and count ``f`` of neighbouring sequences of ``length`` words that are both marked."""
    sent = rows.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value.tables()
        held: list[np.ndarray] = []
        others: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            pairs, n = count_tiles(np.concatenate(held))
            held.clear()
            for k in range(0, len(pairs), 100_000):
                a, b = unpacked(pairs[k : k + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n[k : k + 100_000])], ["a", "b", "f"])
            a, b, n = count_others(*(np.concatenate(x) for x in zip(*others, strict=True)))
            others.clear()
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "f"])

        for _, words in _blocks(batches, length):
            h, there = words.sequences(length)
            if len(h) < 2:
                continue
            number = np.full(len(h), -1, np.int64)
            number[there] = Codes.number(h[there], tables)
            both = (number[:-1] >= 0) & (number[1:] >= 0) & words.next[: len(h) - 1]
            a, b = number[:-1][both], number[1:][both]
            ranked = (a < HEAD) & (b < HEAD)
            held.append(packed(a[ranked], b[ranked]))
            others.append((a[~ranked], b[~ranked]))
            size += len(a)
            if size >= _PAIRS:
                yield from counted()
                size = 0
        if size:
            yield from counted()

    return rows.mapInArrow(run, "a long, b long, f long").groupBy("a", "b").agg(F.sum("f").alias("f"))


def _numbered(level: DataFrame, codes: Codes) -> DataFrame:
    """``level`` with the number ``id`` of every sequence."""
    sent = level.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value.tables()
        for batch in batches:
            h = batch.column(batch.schema.get_field_index("h")).to_numpy().view(np.uint64)
            yield batch.append_column("id", pa.array(Codes.number(h, tables)))

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in level.dtypes)
    return level.mapInArrow(run, kinds + ", id long")


def _hashed(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the hash ``h`` of the sequence, from those of its two parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)).to_numpy().view(np.uint64) for c in ("left_h", "right_h"))
            yield batch.append_column("h", pa.array(joined_hash(a, b).view(np.int64)))

    return pairs.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in pairs.dtypes) + ", h long")


def frequent_sequences(rows: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, list[DataFrame]]:
    """Word totals by ``lang``, and for every length the sequences that occur ``least`` times.

    A sequence has its ``phrase``, count ``f``, and the counts of its first and last 1, 2, ... words
    (``firsts``, ``lasts``), itself included.
    """
    counted = stage(count_words(rows).where(f"word IS NULL OR f >= {least}"), "frequent-words")
    totals = counted.where("word IS NULL").select("lang", F.col("f").alias("n"))
    level = counted.where("word IS NOT NULL").select(
        "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "h", "f",
        F.array("f").alias("firsts"), F.array("f").alias("lasts"),
        F.lit(None).cast("long").alias("left_h"), F.lit(None).cast("long").alias("right_h"),
    )
    levels = [level]
    for length in range(1, longest):
        codes = codes_of(level)
        if not len(codes.slots):
            break
        found = stage(count_pairs(rows, length, codes).where(F.col("f") >= least), "frequent-pairs")
        numbered = stage(_numbered(level.drop("left_h", "right_h"), codes), "ranked-sequences")
        left = numbered.select(F.col("id").alias("a"), "lang", "phrase", F.col("firsts").alias("before"), F.col("h").alias("left_h"))
        right = numbered.select(F.col("id").alias("b"), "last", F.col("lasts").alias("after"), F.col("h").alias("right_h"))
        joined = found.join(left, "a").join(right, "b").select(
            "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f",
            F.concat("before", F.array("f")).alias("firsts"), F.concat("after", F.array("f")).alias("lasts"), "left_h", "right_h",
        )
        level = stage(_hashed(joined), "frequent-sequences").select(levels[0].columns)
        levels.append(level)
    return totals, levels


def collocations(
    documents: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """The ``top`` phrases of every language by score, with their rank.

    The score of a phrase is that of its weakest cut: 1000 * a * n / (l * r), floored, for a
    phrase found ``a`` times among ``n`` words, its parts ``l`` and ``r`` times. A phrase that
    never occurs but within the same longer one is left to that.
    """
    rows = documents.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("binary").alias("text")
    )
    totals, levels = frequent_sequences(rows, least, longest)
    kept = []
    for k, level in enumerate(levels[1:], 2):
        if k < len(levels):
            # what is inside a longer phrase is inside one that is a word longer, and as frequent
            longer = levels[k]
            inside = longer.where(F.col("f") >= F.element_at("firsts", -2)).select(F.col("left_h").alias("h")).unionByName(
                longer.where(F.col("f") >= F.element_at("lasts", -2)).select(F.col("right_h").alias("h"))
            )
            level = level.join(inside.distinct(), "h", "left_anti")
        kept.append(level.select("lang", "phrase", "f", "firsts", "lasts"))
    if not kept:
        kept = [levels[0].where("false").select("lang", "phrase", "f", "firsts", "lasts")]
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    wide = "decimal(19,0)"
    cut = f"""array_min(transform(sequence(1, size(firsts) - 1), k -> named_struct(
        'score', (cast(f as {wide}) * cast(1000 * n as {wide}))
            div (cast(firsts[k - 1] as {wide}) * cast(lasts[size(lasts) - k - 1] as {wide})),
        'k', k, 'l', firsts[k - 1], 'r', lasts[size(lasts) - k - 1])))"""
    scored = found.join(totals, "lang").withColumn("cut", F.expr(cut)).select(
        "lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score"
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
