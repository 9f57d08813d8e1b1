"""A pipeline from raw documents to tokens, stage by stage.

Each stage takes the documents that its predecessor kept and returns those it keeps, with
all their columns; the last one returns tokens. Extra columns are carried along, also
where their names clash with a stage's own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm import bpe, decontam, linedup, neardup, rules
from loadlens.llm.common import table
from loadlens.sources.shared import stage

#: SQL cannot express learned rules, so the stages are tested against brute force.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under names that no operator uses, and those names."""
    names = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), names


def _back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(own).alias(c) for c, own in names.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rule or that the learned decision list rejects."""
    rows, names = _apart(docs)
    learned = rules.learn_from_texts(rows, table(spark, sf_dir, "labels"), names["doc_id"], names["text"])
    counted = rules.statistics(rows, names["text"], tuple(names.values()))
    return _back(counted.where(~F.expr(rules.BASE_FAILED) & rules.verdict(learned)), names)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs; a document of which no word is left goes."""
    rows, names = _apart(docs)
    text = names["text"]
    cut = linedup.dedup_lines(rows, key=names["doc_id"], text=text)
    changed = F.col("n_deleted_lines") > 0
    cut = cut.where(~changed | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in names:
        n_chars = F.col(names["n_chars"])
        kind = dict(rows.dtypes)[names["n_chars"]]
        cut = cut.withColumn(names["n_chars"], F.when(changed, F.length(text).cast(kind)).otherwise(n_chars))
    return _back(cut, names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every component of near-duplicates (five words, similarity 0.8)."""
    rows, names = _apart(docs)
    return _back(neardup.drop_near_duplicates(rows, key=names["doc_id"], text=names["text"]), names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    rows, names = _apart(docs)
    items = table(spark, sf_dir, "benchmark")
    return _back(decontam.drop_contaminated(rows, items, key=names["doc_id"], text=names["text"]), names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, with digests of the ids and of the text decoded from them."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, vocabulary, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES[:-1]:
        docs = stage(work(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
