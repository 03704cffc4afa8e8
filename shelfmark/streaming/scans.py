"""Change tracking where every micro-batch is one whole scan.

A batch goes through the same comparison as a batch job (``changes.snapshot_run``), so a stream gives the same event types, state
columns and missing files.  Each batch writes its results under its own number; a batch that is repeated after a failure writes the
same files again, and the next one reads what the one before left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators import changes as C


def _path(root: str, name: str, batch: int) -> str:
    return f"{root.rstrip('/')}/{name}/batch={batch}"


def read_log(spark: SparkSession, root: str, name: str, batches: int) -> DataFrame | None:
    """All rows of ``events`` or ``master`` that the first ``batches`` batches wrote."""
    return spark.read.parquet(*[_path(root, name, k) for k in range(batches)]) if batches else None


def read_state(spark: SparkSession, root: str, batches: int) -> DataFrame:
    """The state after the first ``batches`` batches."""
    return spark.read.parquet(_path(root, "state", batches - 1))


def track_scans(observations: DataFrame, root: str, scan_root: str, stage: str = "metadata") -> StreamingQuery:
    """Starts a query that takes all available observations as one scan of ``scan_root``; await it, then start the next.

    The scan's time is its latest observation.  Tables and the checkpoint lie under ``root``, a folder that all executors share.
    """

    def scan(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = batch.agg(F.max("observed_at").alias("at")).first().at
        master = read_log(spark, root, "master", number)
        state = read_state(spark, root, number) if number else C.initial_load(batch.limit(0))
        run = C.snapshot_run(
            state.select(*C.MASTER) if master is None else master, state, spark.createDataFrame([], "event_id string"), batch, scan_root,
            F.lit(at).cast("timestamp"), stage)
        for name in ("state", "master", "events"):
            run[name].write.mode("overwrite").parquet(_path(root, name, number))

    return (
        observations.writeStream.foreachBatch(scan).option("checkpointLocation", f"{root.rstrip('/')}/checkpoint")
        .trigger(availableNow=True).start()
    )
