"""Line deduplication: classes of equal line runs by distributed prefix doubling over line numbers, later copies deleted.

Lines of all documents form one sequence in the order of doc_id; between documents one number is left out, so no run crosses them.
Round k knows, for every suffix that is not alone, the class of its first 2**k lines: all suffixes with a common prefix of at least
that length, an interval of the suffix array.  A class is named by the position of its first member, so names are exact and say at once
whether an earlier copy exists.  A round joins the names at p and p + 2**k and names the pairs; suffixes that become unique
leave, and rounds end when no run that is looked up is longer.
The interval of any length m is given by two overlapping classes, at p and p + m - 2**k.

A repeated run counts if it has at least `min_words` words.  Every line of such a run lies in a shortest run of that many words which
begins at it or ends at it and lies within the run; these shortest runs are looked up, and those that have an earlier copy are deleted.

Defined results: lines are compared without outer white space, by a 128-bit hash; a null text stays null and has no lines; rows that
repeat doc_id and text are one document and get the same result; a document that loses all lines keeps an empty text; blank and short
lines go only as part of a run; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import is_empty, materialise
from shelfmark.llm.ordering import with_offset

MIN_WORDS = 10


def shortest_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the number of lines of the shortest run with `least` words that begins there, and that ends there (0: none)."""
    total = np.concatenate(([0], np.cumsum(words)))
    n = len(words)
    ends = np.searchsorted(total, total[:-1] + least)
    ahead = np.where(ends <= n, ends - np.arange(n), 0)
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1
    return ahead, np.where(total[1:] >= least, np.arange(1, n + 1) - starts, 0)


def _line_rows(documents: DataFrame, least: int) -> DataFrame:
    """doc_id, text_hash, n_lines, lines array<struct<high, low, ahead, back>> of every text that is not null."""
    kind = pa.list_(pa.struct([("high", pa.int64()), ("low", pa.int64()), ("ahead", pa.int32()), ("back", pa.int32())]))

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                lines = [x.strip() for x in text.split("\n")]
                ids = np.frombuffer(b"".join(hashlib.blake2b(x.encode(), digest_size=16).digest() for x in lines), np.int64)
                ahead, back = shortest_runs(np.array([len(x.split()) for x in lines]), least)
                out.append(pa.StructArray.from_arrays(
                    [pa.array(ids[::2]), pa.array(ids[1::2]), pa.array(ahead, pa.int32()), pa.array(back, pa.int32())],
                    ["high", "low", "ahead", "back"]))
            counts = [len(x) for x in out]
            flat = pa.concat_arrays(out) if out else pa.array([], kind.value_type)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts, dtype=np.int64))), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), lists.cast(kind)], ["doc_id", "text_hash", "n_lines", "lines"])

    rows = documents.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id long, text_hash long, n_lines long, lines array<struct<high:long,low:long,ahead:int,back:int>>"
    found = rows.mapInArrow(run, schema)
    return found.groupBy("doc_id", "text_hash").agg(F.first("n_lines").alias("n_lines"), F.first("lines").alias("lines"))


def _name(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """pos, name: the first position with the same keys, for keys that occur more than once.

    Classes are written before the join: read back, both sides of it are dealt out anew, and a very frequent key can be split.
    """
    classes = rows.groupBy(*keys).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = materialise(classes, "classes")
    return materialise(rows.select("pos", *keys).join(classes, keys).select("pos", F.col("first").alias("name")), label)


def _double(level: DataFrame, length: int, label: str) -> DataFrame:
    """Classes of twice the length."""
    ahead = level.select((F.col("pos") - length).alias("pos"), F.col("name").alias("name_ahead"))
    return _name(level.join(ahead, "pos"), ["name", "name_ahead"], label)


def repeated_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, n_lines, removed (sorted numbers of the lines that belong to later copies of repeated runs)."""
    rows = _line_rows(documents, min_words)
    rows, _ = with_offset(rows.withColumn("room", F.col("n_lines") + 1), ["doc_id", "text_hash"], "room")
    rows = rows.withColumnRenamed("offset", "begin")
    lines = rows.select("begin", F.posexplode("lines").alias("number", "line"))
    lines = materialise(lines.select("begin", (F.col("begin") + F.col("number")).alias("pos"), "line.*"), "lines")
    level = _name(lines, ["high", "low"], "level")
    windows = lines.select("begin", F.col("pos").alias("start"), F.col("ahead").alias("size")).union(
        lines.select("begin", F.col("pos") - F.col("back") + 1, "back")).where("size > 0")
    single = level.where("name < pos").select(F.col("pos").alias("start"))
    copies = [materialise(windows.where("size = 1").distinct().join(single, "start").select("begin", "start", "size"), "copies")]
    longer = materialise(windows.where("size > 1").distinct(), "windows")
    longest = longer.agg(F.max("size").alias("n")).first().n or 1
    length = 1
    while 2 * length <= longest and not is_empty(level):  # longer classes would decide nothing
        level = _double(level, length, "level")
        length *= 2
        here = longer.where((F.col("size") >= length) & (F.col("size") < 2 * length))
        left = level.select(F.col("pos").alias("start"), F.col("name").alias("left"))
        right = level.select(F.col("pos").alias("tail"), F.col("name").alias("right"))
        known = here.join(left, "start").withColumn("tail", F.col("start") + F.col("size") - length).join(right, "tail")
        known = materialise(known.select("begin", "start", "size", "left", "right"), "known")
        first = known.groupBy("size", "left", "right").agg(F.min("start").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        first = materialise(first, "first")
        later = known.join(first, ["size", "left", "right"]).where("start > first").select("begin", "start", "size")
        copies.append(materialise(later, "copies"))
    copies = reduce(DataFrame.union, copies)
    gone = copies.select("begin", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).distinct()
    removed = gone.groupBy("begin").agg(F.sort_array(F.collect_list((F.col("pos") - F.col("begin")).cast("int"))).alias("removed"))
    out = rows.select("doc_id", "text_hash", "n_lines", "begin").join(removed, "begin", "left")
    return out.select("doc_id", "text_hash", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, removed, text (what is left) for every row."""
    found = materialise(repeated_lines(documents, min_words), "removed")
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    same = rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["text_hash"] == found["text_hash"]) & rows["text"].isNotNull()
    joined = rows.join(found, same, "left").select(rows["doc_id"], "text", "n_lines", "removed")
    lines = F.split("text", "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.when(F.array_contains("removed", i), F.lit(None)).otherwise(x)), lambda x: x.isNotNull())
    return joined.select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        "removed", F.when(F.coalesce(F.size("removed"), F.lit(0)) == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
