"""Session settings and stage borders shared by every job."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Hot entities: AQE splits an oversized join partition by map output, so copies of one row
# are split too.  Forcing it allows the extra shuffle between the split join and the
# aggregate above it; the partial aggregate stays below that shuffle.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Input bytes for each partition that a shuffle starts with; bytes of a task, read from files or, after AQE has joined
#: small partitions, from a shuffle.
INPUT_BYTES, TASK_BYTES = 4 << 20, 16 << 20


def size_shuffles(spark: SparkSession, folder: str, tables: Sequence[str]) -> SparkSession:
    """As many shuffle partitions as the input asks for, and small tasks, so that the memory of one does not grow with it.

    With a fixed number of partitions, or a share of all rows per core, a task's sorts and hash maps grow in step with the
    tables; a partial aggregate over nearly unique keys behind a broadcast join does so with the part of the file it reads.
    """
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    size = 0
    for name in tables:
        path = files.Path(f"{folder}/{name}.parquet")
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(path):
            size += system.getContentSummary(path).getLength()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // INPUT_BYTES))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(TASK_BYTES))
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on."""
    from .operators import kernels

    # Ship the numpy kernels inside the task, so executors need not have the package installed.
    cloudpickle.register_pickle_by_value(kernels)
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "tideline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for stage borders: ``spark.checkpoint.dir``, else the session's warehouse; both are shared on a cluster.

    A run has one folder of its own in it, which is removed when the application ends.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    run = f"{top.rstrip('/')}/tideline-{spark.sparkContext.applicationId}"
    if run not in _RUNS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _RUNS.add(run)
    return run


_RUNS: set[str] = set()


def stage_border(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Later passes rescan the table (with column pruning) instead of recomputing the lineage, and
    a lost executor costs a re-read rather than a rebuild.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``stage_border`` with aggregates of the rows taken while they are written (no scan of their own)."""
    seen = Observation()
    out = stage_border(df.observe(seen, *[c.alias(k) for k, c in counts.items()]))
    return out, seen.get
