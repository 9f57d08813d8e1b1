"""Staging tables in the shared folder of the session.

A staged table cuts the lineage: later stages read Parquet that every executor
can reach, so losing an executor never repeats the work before it.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_scope: ContextVar[str] = ContextVar("staging_scope", default="")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session of one machine without it gets a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # not local-cluster
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-loadlens-")
    return _local_dirs[app]


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/loadlens/{spark.sparkContext.applicationId}{_scope.get()}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below this application's part of the shared folder."""
    return f"{_run_dir(spark)}/{label}-{uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """A scope whose staged tables are deleted at its end; results must be written within it."""
    token = _scope.set(f"{_scope.get()}/run-{uuid4().hex}")
    try:
        yield
    finally:
        drop_staged(spark)
        _scope.reset(token)


def drop_staged(spark: SparkSession) -> bool:
    """Delete all staged tables of the present scope, or of the application outside any."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
