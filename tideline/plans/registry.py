"""Registered queries: a Spark plan over the tables and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import configure, size_shuffles


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}

#: The tables that the queries read (a few of them each).
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")


def query(name: str, covers: str, sql: str | None = None):
    """Register ``build(spark, folder)`` under ``name``; ``covers`` lists inventory ids."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(size_shuffles(configure(spark), folder, TABLES), folder)

        QUERIES[name] = Query(name, covers, run, sql)
        return build

    return register
