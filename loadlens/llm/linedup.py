"""Line dedup: repeated runs of lines by a suffix array over line identifiers.

A line is deleted exactly if it lies in a run of consecutive lines of at least
``min_words`` words that also occurs earlier, in the order of document id, text hash and
line number. So every maximal repeated run of that size loses all copies but the first.

How the runs are found: lines that occur once end every run and are left out early, and
so are stretches of repeated lines with fewer than ``min_words`` words. The others are
the text of the suffix array. Prefix doubling ranks all positions by their first
``2 ** k`` lines: the dense rank of (own rank, rank ``2 ** k`` lines further on), found by
a range-partitioned sort of the distinct pairs. It stops at the depth that the longest
minimal run needs. A minimal run is the shortest one of ``min_words`` words from a line
on, or back from one; its first and last ``2 ** k`` lines overlap and so their two ranks
identify it. Minimal runs with equal ranks form an interval of the suffix array whose
longest common prefix holds the run; all but the first in it are later copies, and the
union of these is the union of all maximal repeated runs, cut by what occurs earlier.

Edge cases: a null text stays null and has no lines; an empty line is a line without
words; rows equal in id and text count as one document and get the same result; equal
lines are told apart from hash collisions by two 64-bit hashes; null ids sort first;
extra columns are ignored.
"""

from __future__ import annotations

from math import floor, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadlens.operators.ordered import RN, order_rows
from loadlens.sources.shared import stage

MIN_WORDS = 50
_WORDS = r"size(regexp_extract_all(content, '[^\\x20\\x09-\\x0D]++', 0))"


def line_rows(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Document key (id and text hash), number, two hashes and the words of every line."""
    lines = documents.where(F.col(text).isNotNull()).select(
        F.col(key).alias("doc"), F.xxhash64(text).alias("hash"), F.posexplode(F.split(text, "\n", -1)).alias("line", "content")
    )
    return lines.select(
        "doc",
        "hash",
        "line",
        F.xxhash64("content").alias("h1"),
        F.xxhash64(F.lit(7), "content").alias("h2"),
        F.expr(_WORDS).alias("words"),
    )


def stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Stretches of consecutive repeated lines with ``min_words`` words or more, line by line.

    ``before`` and ``after`` are the words of the stretch up to the line's start and end.
    """
    repeated = lines.groupBy("h1", "h2").count().where("count > 1").drop("count")
    # a very common line is one key of this join, which AQE splits
    kept = lines.join(repeated, ["h1", "h2"], "left_semi").repartition("doc", "hash")
    document = Window.partitionBy("doc", "hash").orderBy("line")
    stretch = Window.partitionBy("doc", "hash", "stretch")
    return (
        kept.dropDuplicates(["doc", "hash", "line"])
        .withColumn("stretch", F.col("line") - F.row_number().over(document))
        .withColumn("after", F.sum("words").over(stretch.orderBy("line")))
        .withColumn("before", F.col("after") - F.col("words"))
        .withColumn("total", F.max("after").over(stretch))
        .where(F.col("total") >= min_words)
        .drop("words")
    )


def minimal_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """Start and length of the shortest runs of ``min_words`` words, from a line on and back from one."""
    stretch = Window.partitionBy("doc", "hash", "stretch")
    line, end = F.col("line"), F.lead("line").over(stretch.orderBy("line")).isNull()
    # borders between lines: one before every line and one after the last
    border = F.array(F.struct(line.alias("at"), F.col("before").alias("sum")))
    after = F.array(F.struct((line + 1).alias("at"), F.col("after").alias("sum")))
    borders = rows.withColumn("__end", end).select(
        "doc", "hash", "stretch", F.explode(F.when(F.col("__end"), F.concat(border, after)).otherwise(border)).alias("b")
    ).select("doc", "hash", "stretch", "b.at", "b.sum")
    by_words = stretch.orderBy("sum")
    ahead = F.min("at").over(by_words.rangeBetween(min_words, Window.unboundedFollowing))
    back = F.max("at").over(by_words.rangeBetween(Window.unboundedPreceding, -min_words))
    found = borders.select("doc", "hash", "at", ahead.alias("ahead"), back.alias("back"))
    runs = F.array(
        F.struct(F.col("at").alias("start"), (F.col("ahead") - F.col("at")).alias("length")),
        F.struct(F.col("back").alias("start"), (F.col("at") - F.col("back")).alias("length")),
    )
    return (
        found.select("doc", "hash", F.explode(runs).alias("r"))
        .select("doc", "hash", F.col("r.start").alias("line"), "r.length")
        .where("line IS NOT NULL AND length IS NOT NULL")
        .distinct()
    )


def _dense_rank(rows: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Add the rank, from 1, of the pair among the distinct pairs; equal pairs are one row of the sort."""
    pairs = order_rows(rows.select(left, right).distinct(), [left, right]).df
    ranked = pairs.select(F.col(left), F.col(right), (F.col(RN) + 1).alias(name))
    return rows.join(ranked, [left, right])


def prefix_ranks(rows: DataFrame, longest: int) -> tuple[DataFrame, int]:
    """Ranks of all positions by their first 1, 2, 4, ... lines, up to ``longest`` lines; staged.

    Column ``r<k>`` has the rank by ``2 ** k`` lines; suffixes that end within them rank
    before those that go on.
    """
    levels = floor(log2(max(1, longest)))
    stretch = Window.partitionBy("doc", "hash", "stretch").orderBy("line")
    ranked = stage(_dense_rank(rows.select("doc", "hash", "stretch", "line", "h1", "h2"), "h1", "h2", "r0").drop("h1", "h2"), "ranks")
    for k in range(levels):
        further = F.coalesce(F.lead(f"r{k}", 1 << k).over(stretch), F.lit(0).cast("long"))
        paired = stage(ranked.withColumn("__further", further), "pairs")
        ranked = stage(_dense_rank(paired, f"r{k}", "__further", f"r{k + 1}").drop("__further"), "ranks")
    return ranked, levels


def later_copies(documents: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs (document key, first line, length) that also occur earlier."""
    lines = stage(line_rows(documents, key, text), "lines")
    rows = stage(stretches(lines, min_words), "stretches")
    runs = stage(minimal_runs(rows, min_words), "runs")
    longest = runs.agg(F.coalesce(F.max("length"), F.lit(1))).first()[0]
    ranked, levels = prefix_ranks(rows, longest)
    ranks = ranked.select("doc", "hash", "line", F.array(*[f"r{k}" for k in range(levels + 1)]).alias("ranks"))
    depth = F.expr("cast(floor(log2(length)) as int)")
    at = runs.withColumn("k", depth).withColumn("far", F.expr("line + length - cast(shiftleft(1, k) as int)"))

    def rank_at(df: DataFrame, line: str, name: str) -> DataFrame:
        other = ranks.select(
            F.col("doc").alias("__doc"), F.col("hash").alias("__hash"), F.col("line").alias("__line"), "ranks"
        )
        same = F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("hash") == F.col("__hash")) & (F.col(line) == F.col("__line"))
        joined = df.join(other, same)
        return joined.withColumn(name, F.element_at("ranks", F.col("k") + 1)).drop("__doc", "__hash", "__line", "ranks")

    named = rank_at(rank_at(at, "line", "head"), "far", "tail")
    # stage: it is counted and joined; a very common run is one key of the join, which AQE splits
    named = stage(named.select("doc", "hash", "line", "length", "head", "tail"), "named-runs")
    place = F.struct("doc", "hash", "line")
    intervals = (
        named.groupBy("length", "head", "tail")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    return named.join(intervals, ["length", "head", "tail"]).where(place > F.col("first")).select("doc", "hash", "line", "length")


def dedup_lines(
    documents: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``documents`` with ``text`` less the later copies, ``n_lines`` and ``n_deleted_lines``."""
    deleted = (
        later_copies(documents.select(key, text), min_words, key, text)
        .groupBy("doc", "hash")
        .agg(F.collect_set(F.struct("line", "length")).alias("__runs"))
    )
    same = F.col("__doc").eqNullSafe(F.col("doc")) & (F.col("__hash") == F.col("hash"))
    lines = F.split(F.col("__text"), "\n", -1)
    gone = F.array_distinct(
        F.flatten(F.transform("__runs", lambda r: F.sequence(r["line"], r["line"] + r["length"] - 1)))
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    renamed = documents.withColumnsRenamed({c: f"__in_{i}" for i, c in enumerate(documents.columns)})
    at = {c: f"__in_{i}" for i, c in enumerate(documents.columns)}
    joined = (
        renamed.withColumns({"__doc": F.col(at[key]), "__text": F.col(at[text]), "__hash": F.xxhash64(at[text])})
        .join(deleted, same, "left")
        .withColumn("__lines", lines)
        .withColumn("__gone", F.coalesce(gone, F.array().cast("array<int>")))
    )
    new = F.when(
        F.size("__gone") > 0, F.array_join(F.transform(kept, lambda i: F.element_at("__lines", i + 1)), "\n")
    ).otherwise(F.col("__text"))
    return joined.select(
        *[(new if c == text else F.col(at[c])).alias(c) for c in documents.columns],
        F.when(F.col("__text").isNull(), 0).otherwise(F.size("__lines")).cast("long").alias("n_lines"),
        F.size("__gone").cast("long").alias("n_deleted_lines"),
    )
