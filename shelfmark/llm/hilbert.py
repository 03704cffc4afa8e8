"""Sharding along a Hilbert curve: metadata dimensions are quantised, rows sorted by their place on the curve and cut into equal runs.

A run of the curve is compact in all dimensions at once, so the minima and maxima of a shard prune on each of them.  Shards differ by
one row at most; the first ones take the extra rows.

Defined results: a null dimension is its lowest cell; rows with the same place follow each other by the tie columns; repeated rows are
rows of their own; fewer rows than shards leave the last shards empty; an empty table gives no rows; extra columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.ordering import with_offset

BITS = 8


def curve_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (rows, dimensions), 0 <= cell < 2**bits; dimensions * bits must stay below 64.

    From the highest bit down, cells are reflected and exchanged until the transposed index remains; then its bits are interleaved.
    """
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    for bit in range(bits - 1, 0, -1):
        high, below = np.int64(1) << bit, (np.int64(1) << bit) - 1
        for k in range(len(x)):
            turned = (x[k] & high) != 0
            swap = np.where(turned, 0, (x[0] ^ x[k]) & below)
            x[0] = np.where(turned, x[0] ^ below, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (np.int64(1) << bit), turn ^ ((np.int64(1) << bit) - 1), turn)
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for value in x:
            out = (out << 1) | (((value ^ turn) >> bit) & 1)
    return out


def category_cell(column: Column, bits: int = BITS) -> Column:
    return F.when(column.isNull(), 0).otherwise(F.pmod(F.xxhash64(column), F.lit(1 << bits))).cast("int")


def log_cell(column: Column, bits: int = BITS, highest: int = 40) -> Column:
    """Equal steps of the logarithm; values of 2**highest and more share the last cell."""
    cell = F.floor(F.log2(F.coalesce(column, F.lit(0)).cast("double") + 1) * ((1 << bits) / highest))
    return F.least(cell, F.lit((1 << bits) - 1)).cast("int")


def with_place(frame: DataFrame, cells: list[Column], bits: int = BITS) -> DataFrame:
    @F.pandas_udf("long")
    def place(*columns: pd.Series) -> pd.Series:
        return pd.Series(curve_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    return frame.withColumn("place", place(*cells))


def into_shards(frame: DataFrame, cells: list[Column], ties: list[str], shards: int, bits: int = BITS) -> DataFrame:
    """All columns, with shard (0 .. shards - 1) and slot (0, 1, ... within the shard)."""
    ordered, total = with_offset(with_place(frame, cells, bits), ["place", *ties])
    base, extra = divmod(total, shards)
    long_rows = extra * (base + 1)
    row, each = F.col("offset"), max(base, 1)
    shard = F.when(row < long_rows, F.floor(row / (base + 1))).otherwise(extra + F.floor((row - long_rows) / each))
    slot = F.when(row < long_rows, row % (base + 1)).otherwise((row - long_rows) % each)
    return ordered.select(*frame.columns, shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def document_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def document_shards(documents: DataFrame, shards: int, keep: list[str]) -> DataFrame:
    """Documents by source, language and size; equal texts of one place follow each other."""
    rows = documents.select(
        *keep, document_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        category_cell(F.col("source")).alias("cell_source"), category_cell(F.col("lang")).alias("cell_lang"))
    cells = [F.col("cell_source"), F.col("cell_lang"), log_cell(F.col("size"))]
    return into_shards(rows, cells, ["text_crc32", "doc_id"], shards).drop("cell_source", "cell_lang")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order, so that file statistics prune on every dimension."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
