"""Session settings used by tests and ``bench.py``.

On a cluster the session is built by the platform; the library never
creates one. ``local_session`` exists for local runs only. The settings
that matter at scale are the same ones a cluster job would set:

* AQE on, with partition coalescing and skew-join splitting, so shuffle
  partition counts adapt at run time and a hot join key is split;
* a broadcast threshold, so Spark broadcasts a join side only when its
  measured size is under it and sort-merges beyond it;
* the session time zone pinned to UTC, so month truncation and date
  arithmetic do not depend on the machine.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Broadcast a join side only when Spark's size estimate (or, under AQE, the
# measured shuffle size) is below this many bytes.
BROADCAST_THRESHOLD_BYTES = 32 * 1024 * 1024


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "orderscope", driver_memory: str = "8g") -> SparkSession:
    """Build (or get) a local session with the library's recommended settings."""
    n = (os.cpu_count() or 8) if cores == "*" else int(cores)
    parts = shuffle_partitions or max(2 * int(n), 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Keep the driver's job/stage/query history short: a long-lived local
        # session (tests, bench) otherwise accumulates it in driver memory.
        .config("spark.ui.retainedJobs", "200")
        .config("spark.ui.retainedStages", "200")
        .config("spark.sql.ui.retainedExecutions", "50")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST_THRESHOLD_BYTES))
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", str(BROADCAST_THRESHOLD_BYTES))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, if any."""
    value = spark.conf.get("spark.checkpoint.dir", None)
    if value:
        return value
    current = spark.sparkContext.getCheckpointDir()
    return current or None


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the session's checkpoint folder, setting one only where it is unset.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as
    is; without it this is an error there, as executors do not see each
    other's disks. Only a local run with nothing configured gets a fresh
    scratch folder.
    """
    existing = checkpoint_dir(spark)
    if existing:
        spark.sparkContext.setCheckpointDir(existing)
        return existing
    if fallback is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = fallback or tempfile.mkdtemp(prefix="orderscope-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path
