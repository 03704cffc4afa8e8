"""Table access and batch helpers shared by the operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.session import materialise

__all__ = ["BATCH_ROWS", "arrow_rows", "bits_of", "bit_test", "byte_slices", "is_empty", "materialise", "table"]

BATCH_ROWS = 500
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arrow_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Caps the rows of an Arrow batch for this session, so that a batch of long texts stays small in JVM and Python."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def is_empty(frame: DataFrame) -> bool:
    return not frame.take(1)


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Cuts a binary column into (first row, offsets, bytes) pieces of at most `limit` bytes, or of one row if it is longer.

    Nulls count as empty.  Offsets start at 0; the bytes are a view, not a copy.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


def bits_of(slots: DataFrame, log2_bits: int = 22) -> np.ndarray:
    """A one-hash Bloom filter: 2**log2_bits bits (512 KB by default) of the column `slot`, whatever the number of rows.

    The bits are merged by an aggregate with map-side combine into 2**(log2_bits - 6) words, so what reaches the driver and the
    workers has a fixed size.  It only saves work: rows that pass are joined exactly.
    """
    words = (
        slots.where(F.col("slot").isNotNull())
        .select(F.shiftright("slot", 6).alias("w"), F.expr("1L").alias("one"), F.pmod("slot", F.lit(64)).cast("int").alias("s"))
        .groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, s)")).alias("v"))
    )
    out = np.zeros(1 << (log2_bits - 6), np.int64)
    for row in words.collect():
        out[row.w] = row.v
    return out.view(np.uint64)


def bit_test(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether the bit of each slot is set."""
    slots = slots.astype(np.uint64)
    return (bits[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 1
