"""Undo plan of a move journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def undo_plan(journal: DataFrame, existing: DataFrame) -> DataFrame:
    """``journal`` is ``(seq, ts, old, new)``, ``existing`` has the paths now present as ``path``.  Nothing is moved.

    Adds ``status``: skipped_missing when the moved file is gone, skipped_occupied when the old path is in use again, else
    would_restore.  Undo runs newest first, so callers sort by ``seq`` descending when they print it.
    """
    present = existing.select("path").distinct()
    at_new = present.select(F.col("path").alias("new"), F.lit(True).alias("_new"))
    at_old = present.select(F.col("path").alias("old"), F.lit(True).alias("_old"))
    status = F.when(F.col("_new").isNull(), "skipped_missing").when(F.col("_old"), "skipped_occupied").otherwise("would_restore")
    return (
        journal.join(at_new, "new", "left").join(at_old, "old", "left").withColumn("status", status).select(*journal.columns, "status")
    )
