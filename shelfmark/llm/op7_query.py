"""op7: all documents in 24 shards along a Hilbert curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.llm.common import arrow_rows, table
from shelfmark.llm.hilbert import document_shards

SHARDS = 24


def op7_hilbert_shards(spark, sf_dir):
    arrow_rows(spark, 10000)
    rows = document_shards(table(spark, sf_dir, "documents"), SHARDS, ["doc_id"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_hilbert_shards": op7_hilbert_shards}
ORACLES: dict[str, str] = {}
