"""Session defaults and the shared folder for reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Only settings that are safe on any cluster size.  Partition counts are left to adaptive execution, which starts wide and
# coalesces, so the same job fits 60 thousand rows and 100 TB.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}
_RUN_FOLDERS: set[str] = set()
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "shelfmark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may go without: one machine sees its own temporary folder.  On a cluster each executor would write to its
    own disk, so a missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(configured)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def run_folder(spark: SparkSession) -> str:
    """This application's own folder for written intermediate tables; it is deleted when the application ends."""
    folder = f"{checkpoint_root(spark).rstrip('/')}/shelfmark-{spark.sparkContext.applicationId}"
    if folder not in _RUN_FOLDERS:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _RUN_FOLDERS.add(folder)
    return folder


def materialise(frame: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Writes a frame to the shared folder and reads it back.

    For results that several later steps start from: nothing above is computed twice, a lost executor rereads a file, and the
    planner knows the size.
    """
    target = f"{run_folder(frame.sparkSession)}/{label}-{uuid.uuid4().hex}"
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(target)
    return frame.sparkSession.read.schema(frame.schema).parquet(target)
