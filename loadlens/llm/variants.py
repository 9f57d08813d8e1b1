"""Spelling variants: words that differ by one code point, found in dense tiles of code points.

Two words of which the longer has m code points differ by exactly one inserted, deleted or
replaced code point if the lengths of their common prefix and suffix add up to m - 1 or
more. Let p be the length of the common prefix. The positions 0 to m - 1 are cut into
windows; for the window that holds p, both words have the same code points before the
window and the same number of equal ones after it. So words meet under a key made of m,
the window, and what lies outside it: for m their own length (as the longer or an equal
one) and one more (as the shorter one).

All words of one key are a tile: rows of a matrix of padded code points, once aligned to the
left and once to the right. Prefix and suffix lengths of all pairs of the tile come from two
comparisons of blocks of rows. A pair is reported for the window that holds p, so once.

A tile's rows are the words that agree outside three positions. A key with more rows than a
tile takes is cut into blocks, and every pair of blocks is a tile of its own: no pair is left
out and no task gets a whole group.

Edge cases: a null text has no runs; a null id leaves the runs of its text as they are; words of
any length are compared, long ones in wider windows and smaller tiles; repeated rows count as
often as they occur; no documents give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.sources.shared import stage

#: positions in a window, windows in a word at the most
WIDTH, WINDOWS = 3, 16
#: rows and code points of a tile, cells that are compared at once
TILE_ROWS, TILE_POINTS, CELLS = 1024, 1 << 21, 1 << 21
_OTHER = re.compile(rb"[\xc2\xc4-\xff][\x80-\xbf]+")
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 0x80 <= b <= 0xBF or b == 0xC3 else 32 for b in range(256)
)
_DISTINCT = 300_000  # words that a task counts before it passes them on


def runs_of(text: bytes) -> list[bytes]:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` of a UTF-8 text, A-Z lower-cased."""
    return _OTHER.sub(b" ", text).translate(_LETTERS).split()


def noisy(doc_id: str, run: bytes, every: int) -> str:
    """The run, without one code point where ``every`` divides the crc32 of id and run."""
    word = run.decode()
    h = crc32(run, crc32(f"{doc_id}:".encode()))
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def count_words(documents: DataFrame, every: int = 31, shortest: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and its ``n`` occurrences, of all words with ``shortest`` code points or more."""

    def table(found: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for batch in batches:
            for doc_id, body in zip(batch.column(0), batch.column(1), strict=True):
                name = doc_id.as_py()
                start = 0 if name is None else crc32(f"{name}:".encode())
                for own, n in Counter(runs_of(body.as_py() or b"")).items():
                    # a byte makes half a code point at the least
                    if len(own) < shortest:
                        continue
                    if name is not None and crc32(own, start) % every == 0:
                        own = noisy(name, own, every).encode()
                    found[own] = found.get(own, 0) + n
                if len(found) > _DISTINCT:
                    yield table({w: n for k, n in found.items() if len(w := k.decode()) >= shortest})
                    found = {}
        yield table({w: n for k, n in found.items() if len(w := k.decode()) >= shortest})

    rows = documents.select(F.col(key).cast("string").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def window_keys(words: DataFrame) -> DataFrame:
    """A row for every window of every word: ``m``, the window's ``width`` and number ``at``, and its ``key``."""
    width = f"greatest({WIDTH}, ceil(m / {WINDOWS}))"
    of_length = f"transform(sequence(0, cast(ceil(m / {width}) as int) - 1), i -> named_struct('m', m, 'width', cast({width} as int), 'at', i))"
    both = F.expr(f"flatten(transform(array(char_length(word), char_length(word) + 1), m -> {of_length}))")
    rows = words.select("word", "n", F.explode(both).alias("w")).select("word", "n", "w.m", "w.width", "w.at")
    before = "substring(word, 1, at * width)"
    after = "IF((at + 1) * width >= m, '', right(word, m - (at + 1) * width))"
    return rows.withColumn("key", F.expr(f"xxhash64(m, at, {before}, {after})"))


def _matrix(words: list[str], longest: int) -> np.ndarray:
    """Code points, aligned to the left and padded with zeros."""
    return np.array(words, f"U{longest}").view(np.uint32).reshape(len(words), longest)


def _aligned(words: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    return _matrix(words, longest), _matrix([w[::-1] for w in words], longest)


def _equal_start(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of the rows of ``a`` and ``b``."""
    same = a == b
    first = np.argmin(same, axis=-1)
    return np.where(same.all(axis=-1), same.shape[-1], first)


def near_rows(
    words: list[str], group: np.ndarray, m: int, width: int, at: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that are one edit apart, of words that are sorted by tile.

    ``group`` numbers the tiles; ``low`` and ``high`` are the blocks that a tile compares and
    ``own`` is a word's block: two words of one block are compared where both are the same.
    """
    lengths = np.array([len(w) for w in words])
    left, right = _aligned(words, m)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(words)])))
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        # the pair's longer word has m code points, and one block is not compared with itself twice
        fits = (np.maximum(lengths[i], lengths[j]) == m) & ((low[i] == high[i]) | (own[i] != own[j]))
        i, j = i[fits], j[fits]
        for begin in range(0, len(i), max(1, CELLS // m)):
            a, b = i[begin : begin + max(1, CELLS // m)], j[begin : begin + max(1, CELLS // m)]
            p = _equal_start(left[a], left[b])
            p, a, b = p[mine := p // width == at[a]], a[mine], b[mine]
            hit = p + _equal_start(right[a], right[b]) >= m - 1
            hit &= (lengths[a] != lengths[b]) | (p < m)
            found.append((a[hit], b[hit]))

    small = np.flatnonzero(np.repeat(sizes <= 32, sizes))
    # tiles of a few rows are compared together, rows at one distance at a time
    for d in range(1, int(sizes[sizes <= 32].max(initial=1))):
        i = small[small + d < len(words)]
        i = i[group[i] == group[i + d]]
        keep(i, i + d)
    for s, n in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
        step = max(1, CELLS // int(n))
        for begin in range(0, int(n), step):
            rows = np.arange(s + begin, s + min(begin + step, n))
            i, j = np.repeat(rows, n), np.tile(np.arange(s, s + n), len(rows))
            keep(i[i < j], j[i < j])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def near_pairs(words: DataFrame) -> DataFrame:
    """``word``, ``near``, ``near_n``: both directions of every pair of distinct words one edit apart."""
    keyed = window_keys(words)
    rows_of_tile = f"greatest(2, least({TILE_ROWS}, {TILE_POINTS} div m))"
    # staged, so that the join is planned from what was found: no or few keys
    large = stage(
        keyed.groupBy("m", "key").count().where(f"count > {rows_of_tile}")
        .selectExpr("m as large_m", "key as large_key", f"cast(ceil(count / {rows_of_tile}) as int) as blocks"),
        "large-tiles",
    )
    tiles = """transform(sequence(0, coalesce(blocks, 1) - 1), j ->
        named_struct('low', least(j, own), 'high', greatest(j, own)))"""
    dealt = (
        keyed.join(large, (F.col("m") == F.col("large_m")) & (F.col("key") == F.col("large_key")), "left")
        .withColumn("own", F.expr("cast(pmod(xxhash64(word), coalesce(blocks, 1)) as int)"))
        .select("m", "key", "width", "at", "own", "word", "n", F.explode(F.expr(tiles)).alias("t"))
        .select("m", "key", "t.low", "t.high", "width", "at", "own", "word", "n")
        .repartition("m", "key", "low", "high")
        .sortWithinPartitions("m", "key", "low", "high")
    )

    def compare(table: pa.Table) -> pa.RecordBatch:
        m, key, low, high = (table.column(c).to_numpy() for c in range(4))
        change = (m[1:] != m[:-1]) | (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        group = np.concatenate(([0], np.cumsum(change)))
        many = np.bincount(group)[group] > 1
        table, m, group = table.filter(pa.array(many)), m[many], group[many]
        words, n = table["word"].to_pylist(), table["n"].to_numpy()
        width, at, own, low, high = (table[c].to_numpy() for c in ("width", "at", "own", "low", "high"))
        out_a: list[np.ndarray] = []
        out_b: list[np.ndarray] = []
        begin = 0
        while begin < len(words):
            # a stretch of whole tiles of one length, with a bounded matrix
            end = int(np.searchsorted(m, m[begin], "right"))
            most = begin + max(2, TILE_POINTS // int(m[begin]))
            if end > most:
                cut = int(np.searchsorted(group, group[most], "left"))
                end = cut if cut > begin else int(np.searchsorted(group, group[begin], "right"))
            part = slice(begin, end)
            a, b = near_rows(
                words[part], group[part], int(m[begin]), int(width[begin]), at[part], own[part], low[part], high[part]
            )
            out_a += [a + begin, b + begin]
            out_b += [b + begin, a + begin]
            begin = end
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_a, out_b))
        column = table["word"].combine_chunks() if len(words) else pa.array([], pa.string())
        return pa.RecordBatch.from_arrays(
            [column.take(pa.array(a, pa.int64())), column.take(pa.array(b, pa.int64())), pa.array(n[b], pa.int64())],
            ["word", "near", "near_n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # all but the last tile is complete
            m, key, low, high = (batch.column(c).to_numpy() for c in range(4))
            last = (m == m[-1]) & (key == key[-1]) & (low == low[-1]) & (high == high[-1])
            cut = int(np.flatnonzero(~last).max(initial=-1)) + 1
            if held:
                first = [held[-1].column(c)[-1].as_py() for c in range(4)]
                if cut or first != [m[0], key[0], low[0], high[0]]:
                    yield compare(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                    held = []
            elif cut:
                yield compare(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield compare(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "word string, near string, near_n long")


def roots_of(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of its chain; ``forms`` has ``word`` and ``form`` and no cycle."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        # every step doubles the distance that a word looks ahead
        joined = stage(now.join(further, "root", "left").select("word", "root", "beyond"), "roots")
        if not joined.where("beyond IS NOT NULL").limit(1).count():
            return joined.select("word", "root")
        now = stage(joined.select("word", F.coalesce("beyond", "root").alias("root")), "roots")


def group_variants(words: DataFrame, times: int = 10) -> DataFrame:
    """Every word of ``words`` (``word``, ``n``) with its near words, ``form`` and ``root``.

    A word's form is its most frequent near word (of equal ones the smallest), where that
    occurs ``times`` as often at the least.
    """
    near = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near")).alias("best")
    )
    best_n = -F.col("best.minus_n")
    formed = best_n >= times * F.col("n")
    joined = stage(
        words.join(near, "word", "left").select(
            "word", F.when(formed, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, best_n).alias("form_n"),
        ),
        "variants",
    )
    roots = roots_of(joined.where("form IS NOT NULL"))
    return joined.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(
    documents: DataFrame, every: int = 31, shortest: int = 7, least: int = 2, times: int = 10, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Variants among all words of ``documents`` that occur ``least`` times."""
    words = stage(count_words(documents, every, shortest, key, text).where(F.col("n") >= least), "variant-words")
    return group_variants(words, times)
