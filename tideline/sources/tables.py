"""Reading tables, canonical names, semi-filtered scans, views and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import HOUR_SITE, OPTIONAL


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV (plain or gzip) with a header; columns are taken by name and parsed by the schema.

    Values that do not parse become null.  Gzip files are one task each: use
    ``convert_to_parquet`` once before running on large files.
    """
    names = spark.read.option("header", True).csv(path).columns
    raw = T.StructType([T.StructField(n, T.StringType()) for n in names])
    wide = spark.read.option("header", True).schema(raw).csv(path)
    wanted = [f for f in schema.fields if f.name in names]
    return wide.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted])


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Parquet or CSV by suffix; other suffixes are refused."""
    name = path.rstrip("/").lower()
    if name.endswith((".csv", ".csv.gz")):
        df = read_csv(spark, path, schema) if schema is not None else spark.read.option("header", True).csv(path)
    elif name.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported source format: {path}")
    return df.select(*columns) if columns else df


def column_names(spark: SparkSession, path: str) -> list[str]:
    """Header or Parquet schema only; no data is read."""
    return read_table(spark, path).columns


def convert_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType, partitions: int | None = None) -> None:
    """One-off copy of a non-splittable CSV into Parquet."""
    df = read_csv(spark, source, schema)
    (df.repartition(partitions) if partitions else df).write.mode("errorifexists").parquet(target)


def hour_site_tables(spark: SparkSession, root: str, suffix: str = ".csv.gz") -> dict[str, DataFrame]:
    """The fifteen tables of the hour-level site by short name."""
    out = {}
    for path, schema in HOUR_SITE.items():
        full = f"{root.rstrip('/')}/{path}{suffix}"
        out[path.split("/")[1]] = read_table(spark, full, None if suffix.startswith(".csv") else schema.names, schema)
    return out


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def rename_from_mapping(df: DataFrame, mapping: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """Canonical names for mapped columns that exist; other keys are skipped."""
    out = normalise_columns(df)
    renames = {mapping[k].lower(): k for k in keys if mapping.get(k) and mapping[k].lower() in out.columns}
    return out.withColumnsRenamed(renames)


def resolve_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """First candidate present, ignoring case."""
    known = {c.upper(): c for c in columns}
    return next((known[c.upper()] for c in candidates if c.upper() in known), None)


def canonical(df: DataFrame, spec: Mapping[str, Sequence[str]], optional: set[str] = OPTIONAL) -> DataFrame:
    """Select the canonical columns of ``spec``; a missing optional one becomes null."""
    picked, missing = [], []
    for name, candidates in spec.items():
        found = resolve_column(df.columns, candidates)
        if found is not None:
            picked.append(F.col(found).alias(name))
        elif name in optional:
            picked.append(F.lit(None).cast("string").alias(name))
        else:
            missing.append(name)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(*picked)


def require_columns(df: DataFrame, columns: Sequence[str], table: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{table} missing required columns: {missing}")


def semi_scan(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key is among ``ids``.  The size of ``ids`` decides between broadcast and shuffle."""
    keys = [on] if isinstance(on, str) else list(on)
    return df.join(ids.select(*keys).distinct(), keys, "left_semi")


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def write_result(df: DataFrame, path: str, form: str = "csv") -> None:
    """Result-table sink."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)


def save_cohort(df: DataFrame, path: str) -> DataFrame:
    """Keep an analytic cohort for later inference runs; reuse is explicit, by path."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join that must not change the number of left rows: duplicate right keys are an error.

    The check is a grouped count with a map-side combine, ended by the first duplicate found.
    """
    repeated = right.groupBy(*on).count().where("count > 1").limit(1).count()
    if repeated:
        raise ValueError(f"right side repeats keys {list(on)}")
    return left.join(right, list(on), how)
