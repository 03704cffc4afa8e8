"""Row numbers inside groups of any size.

A plain ``row_number`` sends a whole group to one task.  ``ordinal`` cuts all rows into ranges of (group, order), numbers each group
within a range, and adds how many of its rows lie in the ranges before.  A task holds one range, whatever the groups' sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import materialise


def ordinal(rows: DataFrame, group: list[str], order: list[str], name: str = "ordinal", total: str | None = None,
            ranges: int | None = None) -> DataFrame:
    """Adds the 0-based position of each row in its group by ``order`` (ascending), and optionally the group size.

    ``group`` and ``order`` together identify a row and hold no nulls.  The ranges are written once, so that a range keeps its rows
    when a task runs again; ``ranges`` sets their number, else the session's shuffle setting does.
    """
    keys = [*group, *order]
    cut = rows.repartitionByRange(ranges, *keys) if ranges else rows.repartitionByRange(*keys)
    cut = materialise(cut.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = cut.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)  # one row a range that the group touches
    offsets = counts.select(
        *group, "_range", (F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    local = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order)) - 1
    out = cut.withColumn(name, local).join(offsets, [*group, "_range"]).withColumn(name, (F.col(name) + F.col("_before")).cast("int"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.select(*rows.columns, name, *([total] if total else []))
