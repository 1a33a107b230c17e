"""Spark-side helpers of the operators: tables, folds, row keys, stage tables."""

from __future__ import annotations

import importlib

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_border

__all__ = ["fold", "row_key", "ship", "small", "stage", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """A table written in the shared folder and read again: cuts lineage, survives lost executors."""
    return stage_border(df)


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(-1))


def row_key(doc: str, text: str) -> Column:
    """Names a row: rows that agree in id and text are the same document twice and are treated alike."""
    return F.xxhash64(F.col(doc), F.col(text))


#: Rows and bytes of an Arrow batch: documents can be long, and a batch is held by the JVM and the Python worker alike.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ship(spark: SparkSession, *names: str) -> None:
    """Bound Arrow batches, and send these modules inside the task, so executors need not have the package installed."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    for name in names:
        cloudpickle.register_pickle_by_value(importlib.import_module(f"{__package__}.{name}"))


#: Bytes up to which a counted table is sent to every task.
SMALL_BYTES = 24 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A staged table with a broadcast hint if its counted rows are few enough; else it is joined by shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL_BYTES else df
