"""Session settings and shared working folders."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small shuffles stay spread over the cores; large ones are still bounded by the advisory size.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    # State of streams grows with their keys: it is kept on disk, not on the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
# Settings that only a new session can take. Recording the call site of every column expression costs more
# than planning the queries does.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}
LOCAL_MASTER = re.compile(r"local(\[[^\]]*\])?")


def build_session(app_name: str = "airloom", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators assume.

    ``shuffle_partitions`` is the starting count that adaptive execution coalesces from; on a cluster set it
    so that one partition of the largest shuffle stays near 200 MB.
    """
    builder = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    for key, value in {**SETTINGS, **START_SETTINGS}.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the run-time settings on a session somebody else has built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the checkpoint folder, which all machines must share.

    It is the one in ``spark.checkpoint.dir`` or set on the context; without one this is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{base.rstrip('/')}/airloom/{purpose}-{uuid.uuid4().hex}"


def ensure_checkpoint_folder(spark: SparkSession) -> SparkSession:
    """Set a temporary checkpoint folder where none is named and all tasks run in this process, as in tests.

    On a cluster a folder of one machine would be missing on the others, so there its absence is an error.
    """
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not LOCAL_MASTER.fullmatch(spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="airloom-"))
    return spark


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once to a fresh folder in the shared one and read back.

    Later steps start from the files: neither its plan nor lost executors cost them anything.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
