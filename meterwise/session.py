"""SparkSession helpers: the settings every job in this package assumes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

from meterwise.config import LOG_TAIL_LINES

# Settings the jobs rely on for correct results (not just speed).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # JSON.parse keeps the last of repeated keys; variant parsing must accept them too.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Plan shapes the jobs count on at scale, applied to any session (also one made by others):
# every "N newest per key" list, up to the 5,000-line log tail, is cut to N rows per key in
# each map task before its shuffle (the default stops at 1,000).
PLAN_CONF = {
    "spark.sql.optimizer.windowGroupLimitThreshold": str(LOG_TAIL_LINES),
}

# Settings for scale: runtime re-planning, skew splitting, size-checked broadcast.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Broadcast only sides whose measured size is under this bound.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call-site capture for error messages costs several JVM round trips per Column call
    # (read once per process, so it belongs in the builder config).
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8, app_name: str = "meterwise") -> SparkSession:
    """Local/test session. On a cluster, use the cluster's session and call ``configure``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("METERWISE_DRIVER_MEMORY", "16g"))
    )
    for k, v in {**REQUIRED_CONF, **PLAN_CONF, **SCALE_CONF}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def cluster_conf(largest_shuffle_bytes: int, partition_bytes: int = 128 * 1024 * 1024) -> dict[str, str]:
    """Partition sizing for a cluster run, from the largest shuffle a job writes (e.g. the
    ledger's projected columns for T6/T7, about a fifth of its Parquet size per column set).

    The shuffle starts with enough partitions that each holds ``partition_bytes`` at most
    (so no task spills for want of partitions); AQE then merges small ones back to that
    size and splits skewed ones (a hot account) in joins. Scans read 256 MB splits.
    Pass the result to the builder (``.config(k, v)``) before the session starts.
    """
    n = max(200, -(-largest_shuffle_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * partition_bytes),
    }


def configure(spark: SparkSession) -> SparkSession:
    """Apply the semantics-bearing settings to an existing session."""
    for k, v in {**REQUIRED_CONF, **PLAN_CONF}.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only when unset in
    local mode (tests). On a cluster the folder must be shared (every executor and a
    restarted driver read it), so a missing setting is an error, not a local folder."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master  # local-cluster has executors of its own, with folders of their own
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set: point it at a folder every executor can reach")
    scratch = tempfile.mkdtemp(prefix="meterwise-ckpt-")
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", scratch)
    spark.sparkContext.setCheckpointDir(scratch)
    return scratch
