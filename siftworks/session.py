"""Session defaults and the working folder for checkpoints and streaming output."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Set to true, tables of the query catalogue with fewer partitions than cores are dealt over the cores. For measurements
# on one machine, where a table is one small file; on a cluster file splits do it (spark.sql.files.maxPartitionBytes).
SPREAD = "spark.siftworks.spreadSmallTables"

SETTINGS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # methods above this size are never compiled to machine code; the rule array is one
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Give a session of your own the settings that can be changed while it runs and that speed and memory depend on."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and measurements; on a cluster, bring your own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("siftworks")
    for key, value in {**SETTINGS, SPREAD: "true", "spark.sql.shuffle.partitions": str(shuffle_partitions), **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_base: str | None = None


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder,
    which goes when the driver ends.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if _local_base is None:
            _local_base = tempfile.mkdtemp(prefix="siftworks-")
            atexit.register(shutil.rmtree, _local_base, ignore_errors=True)
        base = _local_base
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    For a small result of an expensive plan that is used more than once: the plan
    runs once, and a lost executor costs no recomputation.
    """
    folder = work_dir(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by ``keys`` when a scan has fewer partitions than the session has cores.

    A small unsplittable file would otherwise keep one core busy; a large input
    has many splits already and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)
