"""Session helpers: a configured local session for tests and the bench,
and the shared checkpoint folder the cluster names."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


#: The state store of streams: on disk, so state may outgrow memory, and only
#: changed keys are written per batch.  ``streaming_c2_pairs`` needs it.
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "tracehound") -> SparkSession:
    """Build (or reuse) a session with the settings the library assumes:
    UTC session zone, AQE with skew-join and partition coalescing, no UI."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(map=STREAM_SETTINGS)
        .config("spark.driver.memory", os.environ.get("TRACEHOUND_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def pin_utc(spark: SparkSession) -> None:
    """All times in this library are UTC wall clock."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    This is whatever ``spark.checkpoint.dir`` names (on a cluster: a shared
    file system).  Only a local master (tests, one machine) may go without:
    a fresh local folder is then created and registered."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir is not set; on {master} it must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="tracehound-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


# Runtime SQL settings for a large cluster (about 1000 executors, ~100 TB of
# logs).  Sizes are per task, so they do not change with the data volume:
# AQE starts from many shuffle partitions and coalesces them to ~256 MB,
# splits skewed join partitions, and broadcasts only sides measured below
# 64 MB at run time.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    **STREAM_SETTINGS,
}


def apply_cluster_settings(spark: SparkSession, overrides: dict[str, str] | None = None) -> None:
    """Set ``CLUSTER_SETTINGS`` (plus ``overrides``) on a running session."""
    for k, v in {**CLUSTER_SETTINGS, **(overrides or {})}.items():
        spark.conf.set(k, v)
