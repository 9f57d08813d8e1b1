"""Connected components of a graph that is a table of edges.

Large-star and small-star steps alternate: every node's neighbours are tied to the
smallest of them, until each component is a star. A step is an aggregate and a join, so
a node with very many neighbours is no single task's work, and nothing but two numbers
per step reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.sources.shared import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:  # the smaller neighbours only
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # a second key, so that the join has exchanges of its own and a node of very many edges can be split
    apart = F.xxhash64("u").alias("h")
    smallest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).select("u", "m", apart)
    joined = both.select("u", "v", apart).join(smallest, ["u", "h"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        tied = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = tied.unionByName(smallest.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of an edge; a root is the smallest node of its component.

    ``edges`` has columns ``a`` and ``b`` of one ordered type; an edge to itself makes no component.
    """
    now = stage(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    while True:
        now = stage(_star(stage(_star(now, True), "large-star"), False), "small-star")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
