"""Session construction and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# Settings every job relies on. ANSI stays on (Spark 4 default); overflow is
# handled per expression with try_cast, never by switching ANSI off.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "ledgerline", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings above.

    On a cluster leave ``master`` None so spark-submit decides; size
    ``shuffle_partitions`` to the data (AQE coalesces small ones anyway).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in conf.items():
        if not k.startswith("spark.ui"):
            try:
                spark.conf.set(k, v)
            except AnalysisException as e:      # a static setting of an already running session stays
                if "CANNOT_MODIFY" not in str(e):
                    raise
    return spark


def _single_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def work_root(spark: SparkSession) -> str:
    """Shared folder for written tables: the cluster's ``spark.checkpoint.dir``.

    Only a session in local mode (tests, a laptop) that names none gets a
    private temporary folder, registered as the checkpoint dir. On a cluster a
    folder of one machine would lose data, so a missing setting is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not _single_machine(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)          # so DataFrame.checkpoint() writes to the same place
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused location below the work root (one per call)."""
    return os.path.join(work_root(spark), "ledgerline", f"{name}-{uuid.uuid4().hex[:12]}")


def input_bytes(spark: SparkSession, *paths: str) -> int:
    """Bytes stored below the paths, summed by the file system."""
    total = 0
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total


def size_session(spark: SparkSession, stored_bytes: int) -> None:
    """Apply ``cluster_conf`` to a running session (a cluster run's entry points)."""
    if not _single_machine(spark.sparkContext.master):
        for k, v in cluster_conf(stored_bytes).items():
            spark.conf.set(k, v)


def cluster_conf(input_bytes: int, target_partition_bytes: int = 256 * 1024 * 1024) -> dict:
    """Shuffle sizing for a cluster run over ``input_bytes`` of source data.

    Starts with about one shuffle partition per ``target_partition_bytes`` of
    input (AQE then coalesces partitions that come out small and splits skewed
    ones), and lets file scans read splits of the same size. Pass the result
    as ``build_session(extra=...)``.
    """
    parts = max(200, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        # Broadcast decided on *measured* sizes only (after the small side ran):
        # a day's aggregate of a few tens of MB joins the huge users table
        # without shuffling it. The plan-time (estimated) threshold stays default.
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        # Runtime bloom filters (built where the small side is a filtered scan,
        # e.g. a day's payments pruning the fixed-expense table) from up to 128 MB.
        "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": str(128 * 1024 * 1024),
    }
