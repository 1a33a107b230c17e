"""Checks that required tables, columns and mappings are present, as a report table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from .tables import resolve_column

SCHEMA = "source string, requirement string, present int, found string"


def check_columns(spark: SparkSession, tables: Mapping[str, Sequence[str] | None], required: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """One row per required column: which accepted name was found.

    ``tables`` gives the columns of each source (None: the source is absent).
    """
    rows = []
    for source, spec in required.items():
        have = tables.get(source)
        rows.append((source, "<table>", int(have is not None), source if have is not None else None))
        for name, candidates in spec.items():
            found = resolve_column(have or [], candidates)
            rows.append((source, name, int(found is not None), found))
    return spark.createDataFrame(rows, SCHEMA)


def check_mappings(spark: SparkSession, config: Mapping, required: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per configuration key that must be set, e.g. ``{'medications.prescribing_columns': ['patid']}``."""
    rows = []
    for section, keys in required.items():
        node = config
        for part in section.split("."):
            node = (node or {}).get(part)
        for key in keys:
            value = (node or {}).get(key)
            rows.append((section, key, int(bool(value)), str(value) if value else None))
    return spark.createDataFrame(rows, SCHEMA)
