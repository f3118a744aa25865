"""Session helpers: builder defaults, durable checkpoints, folders for written tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "seismark", shuffle_partitions: int = 8,
                  driver_memory: str = "16g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_utc(spark: SparkSession) -> None:
    """Timestamps in this package are zone-free; pin the zone used when they become epochs."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage in the shared checkpoint folder of the cluster.

    The folder named by ``spark.checkpoint.dir`` wins. A temporary folder is only made for a local
    master, where driver and executors share one disk.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            sc.setCheckpointDir(configured)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return df.checkpoint(eager)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where a scan has fewer splits than the session has (one small file is one split).

    A large table has more splits than cores and is returned as it is, so no shuffle is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tasks_for(df: DataFrame, rows: int = 100_000) -> int:
    """Number of partitions that leaves about ``rows`` rows to a task, at least one a core. For a stored table: its count is metadata."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder for written tables: under ``spark.checkpoint.dir`` on a cluster, a temporary one for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/seismark/{spark.sparkContext.applicationId}/{name}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")), name)
