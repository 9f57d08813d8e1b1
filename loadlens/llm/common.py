"""Helpers shared by the operators on documents."""

from __future__ import annotations

import gc
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are the runs between it. ``bytes.split()`` splits at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the value written as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


#: what a Python worker keeps from task to task, as long as it runs the same operator
worker_tables: dict = {}


def free_worker() -> None:
    """For tasks that need none of the tables that other operators have left in their worker."""
    if worker_tables:
        worker_tables.clear()
        gc.collect()  # states of a transducer refer to each other


#: bits of a table of marks, as a power of two: at most 16 MB, however many keys are marked
MARK_BITS = 27


@dataclass(frozen=True)
class Marks:
    """A bit for every key of a table, by the leading bits of the key: no key is missed, a few others hit."""

    slots: np.ndarray
    bits: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(1 << (MARK_BITS - 6), np.uint64)
        out[self.slots] = self.bits
        return out

    @staticmethod
    def hit(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
        bit = (keys.view(np.uint64) >> np.uint64(64 - MARK_BITS)).astype(np.int64)
        return ((table[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def marks_of(df: DataFrame, key: str) -> Marks:
    """Marks of the keys (64-bit hashes) in a column; at most 2 ** (MARK_BITS - 6) rows reach the driver."""
    bit = F.shiftrightunsigned(key, 64 - MARK_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    found = df.groupBy(F.shiftright(bit, 6).alias("slot")).agg(F.bit_or(one).alias("bits")).toArrow()
    return Marks(found["slot"].to_numpy().astype(np.int64), found["bits"].to_numpy().view(np.uint64))
