"""State and master tables kept in sorted buckets by key, so that a scan moves the scan and not the state.

A join by key with such a table reads the buckets where they lie; only the other side is shuffled, into as many partitions as the table
has buckets.  The number of buckets stays with the table: about one for every few hundred MB that the state is expected to reach.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import changes as C
from shelfmark.session import run_folder

BUCKETS = 64


def keep(frame: DataFrame, label: str, buckets: int = BUCKETS, key: str = "file_key", folder: str | None = None, dealt: bool = False) -> DataFrame:
    """Writes a table in buckets and returns it.

    Rows are dealt by key before the write, so that a bucket is one file; ``dealt`` says that they already lie that way, as they do in
    what comes out of a join with a kept table.  Without a ``folder`` on storage that all executors share, the application's own one is
    used, which ends with it.
    """
    spark = frame.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{(folder or run_folder(spark)).rstrip('/')}/{name}"
    rows = frame if dealt else frame.repartition(buckets, key)
    rows.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)


def update(state: DataFrame, master: DataFrame, observed: DataFrame, scan_root: str, observed_at: Column, stage: str = "metadata",
           buckets: int = BUCKETS) -> dict[str, DataFrame]:
    """One scan against kept tables: ``events``, the next ``state`` (kept again) and the rows to add to the ``master``.

    The comparison is written as it comes out of the join with the state, by bucket, and the next state from there: the scan is the only
    thing that is dealt by key.
    """
    diff = keep(C.snapshot_diff(state, C.latest_observation(observed), scan_root, observed_at, stage), "diff", buckets, dealt=True)
    return {"events": C.with_event_id(C.change_events(diff)), "state": keep(C.next_state(diff), "state", buckets, dealt=True),
            "master": C.master_additions(diff, master)}


def moved_sides(frame: DataFrame) -> int:
    """Shuffles in the plan of a frame, for tests and reviews of plans."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")
