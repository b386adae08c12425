"""Session settings the reports are written for."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    # Re-plan joins and partition counts from measured sizes, split skewed join partitions even
    # where that costs one more exchange.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Cut the big side of a cohort or journey join early by a Bloom filter of the small side.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
    # Plans are built from many small columns; recording the Python line of each one costs more
    # than planning does.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # A session that serves many reports meets far more than the default 100 generated classes.
    "spark.sql.codegen.cache.maxEntries": "2000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def tuned(builder, shuffle_partitions: int | None = None):
    """Apply the settings. On a cluster leave `shuffle_partitions` to the submit command: a few per
    core and at most a few hundred megabytes each; adaptive execution merges those that turn out
    small."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder


def local_session(cores: int | None = None, app: str = "playtrail") -> SparkSession:
    """One-machine session for tests and the benchmark."""
    cores = cores or os.cpu_count() or 1
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    spark = tuned(builder, shuffle_partitions=cores).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str | None:
    """Shared folder the cluster names for checkpoints, or None where it names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or None


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for what a job writes and reads again: below the cluster's folder for
    checkpoints, or, on one machine without one, below a temporary folder."""
    root = checkpoint_root(spark)
    if root is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("no folder that all executors see: set spark.checkpoint.dir")
        root = tempfile.mkdtemp(prefix="playtrail-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
