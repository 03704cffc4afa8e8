"""Exact running sums in a global order, without bringing the rows to one task."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import materialise


def with_offset(frame: DataFrame, order: list[str], weight: str | None = None) -> tuple[DataFrame, int]:
    """The frame, sorted and written, with `offset` (sum of the weights of all rows before; row number without a weight), and the total.

    Rows are cut into ranges of the order and summed within them; only one sum a range meets at the driver.
    """
    inner = T.StructType([*frame.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("offset", T.LongType())])

    def run(batches):
        done = 0
        for batch in batches:
            sizes = np.ones(len(batch), np.int64) if weight is None else batch.column(batch.schema.get_field_index(weight)).to_numpy().astype(np.int64)
            ends = done + np.cumsum(sizes)
            columns = [*batch.columns, pa.array(ends - sizes, pa.int64())]
            done = int(ends[-1]) if len(ends) else done
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "offset"])

    cut = frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = materialise(cut.mapInArrow(run, inner), "ranged")
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sums = {row.part: row.n for row in ranged.groupBy("part").agg(size.alias("n")).collect()}
    parts = sorted(sums)
    before = dict(zip(parts, [0, *accumulate(sums[k] for k in parts)], strict=False))
    if not parts:
        return ranged.drop("part"), 0
    starts = frame.sparkSession.createDataFrame([(k, before[k]) for k in parts], "part int, before long")
    placed = ranged.join(F.broadcast(starts), "part").withColumn("offset", F.col("offset") + F.col("before")).drop("part", "before")
    return placed, before[parts[-1]] + sums[parts[-1]]
