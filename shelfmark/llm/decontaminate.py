"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

An item gives windows of `window` consecutive words (all its words if it has fewer).  A window's shingles (runs of up to three words)
are ordered by how rare they are in the documents; a document can only contain the whole window if it contains the rarest one, so
that one is the prefix that is joined.  Its place in the window bounds where the window may start and end; then the words themselves
are compared.  The documents are read twice, once to count item shingles and once to find prefixes; both times a Bloom filter of
fixed size leaves out other shingles, and nothing that grows with the benchmark is broadcast.

Defined results: null text has no words; a document or an item without words has no hits; repeated items and windows count once for
an item; repeated document rows are judged each on their own; no items leave every document clean; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import bit_test, bits_of, byte_slices, materialise
from shelfmark.llm.words import run_hashes, word_hashes, word_spans

WINDOW = 10
SHINGLE = 3
LOG2_BITS = 24
MASK = np.uint64((1 << LOG2_BITS) - 1)
SLICE = 2 << 20


def _slot(column):
    return F.col(column).bitwiseAND(F.lit((1 << LOG2_BITS) - 1))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, size, content (words joined by a space), shingles array<long> of every window."""

    def run(batches):
        for batch in batches:
            out = {"item_id": [], "size": [], "content": [], "shingles": []}
            for row, text in enumerate(batch.column(1).to_pylist()):
                data = np.frombuffer(text or b"", np.uint8)
                low, starts, ends, _ = word_spans(np.array([0, len(data)]), data)
                size = min(window, len(starts))
                if not size:
                    continue
                words = [bytes(low[a:b]).decode("utf-8", "replace") for a, b in zip(starts, ends, strict=True)]
                shingles = run_hashes(word_hashes(low, starts, ends), min(SHINGLE, size)).view(np.int64)
                each = size - min(SHINGLE, size) + 1
                for k in range(len(words) - size + 1):
                    out["item_id"].append(batch.column(0)[row].as_py())
                    out["size"].append(size)
                    out["content"].append(" ".join(words[k : k + size]))
                    out["shingles"].append(shingles[k : k + each].tolist())
            yield pa.RecordBatch.from_arrays([
                pa.array(out["item_id"], pa.int64()), pa.array(out["size"], pa.int32()), pa.array(out["content"], pa.string()),
                pa.array(out["shingles"], pa.list_(pa.int64()))], list(out))

    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("t"))
    return rows.mapInArrow(run, "item_id long, size int, content string, shingles array<long>").dropDuplicates(["item_id", "content"])


def _matches(bits: np.ndarray, low, starts, ends, firsts, lengths: list[int]):
    """(shingle hash, word index of its start, text row) of item shingles; none crosses two texts."""
    hashes = word_hashes(low, starts, ends)
    row_of = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    for length in lengths:
        runs = run_hashes(hashes, length)
        at = np.flatnonzero(bit_test(bits, runs & MASK))
        at = at[row_of[at] == row_of[at + length - 1]] if len(at) else at
        yield runs[at].view(np.int64), at, row_of[at]


def shingle_counts(documents: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """h, n: how often item shingles occur in all documents."""

    def run(batches):
        for batch in batches:
            for _, offsets, data in byte_slices(batch.column(0), SLICE):
                low, starts, ends, firsts = word_spans(offsets, data)
                found = [h for h, _, _ in _matches(bits, low, starts, ends, firsts, lengths)]
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64())], ["h", "n"])

    rows = documents.select(F.col("text").cast("binary").alias("t"))
    return rows.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """h, at (its place in the window), size, content, item_id: the rarest shingle of each window."""
    each = windows.select("item_id", "size", "content", F.posexplode("shingles").alias("at", "h")).join(counts, "h", "left")
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "at")
    rarest = each.groupBy("item_id", "size", "content").agg(F.min(order).alias("rarest"))
    return rarest.select("rarest.h", "rarest.at", "size", "content", "item_id")


def candidates(documents: DataFrame, bits: np.ndarray | None, lengths: list[int], window: int, keep: list[str]) -> DataFrame:
    """The kept columns, n_words, found array<struct<h, pos, from, words>>: prefixes with the words that any window around them can have."""
    kind = pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int64()), ("from", pa.int64()), ("words", pa.string())]))

    def run(batches):
        for batch in batches:
            n_words, found = [], []
            for _, offsets, data in byte_slices(batch.column(len(keep)), SLICE):
                low, starts, ends, firsts = word_spans(offsets, data)
                here = [[] for _ in range(len(offsets) - 1)]
                for hashes, at, rows in _matches(bits, low, starts, ends, firsts, lengths) if bits is not None else ():
                    for h, p, row in zip(hashes.tolist(), at.tolist(), rows.tolist(), strict=True):
                        first, last = max(firsts[row], p - window + 1), min(firsts[row + 1], p + window)
                        words = b" ".join(low[starts[k] : ends[k]].tobytes() for k in range(first, last)).decode("utf-8", "replace")
                        here[row].append({"h": h, "pos": p - int(firsts[row]), "from": int(first - firsts[row]), "words": words})
                n_words += np.diff(firsts).tolist()
                found += here
            columns = [*batch.columns[: len(keep)], pa.array(n_words, pa.int64()), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_words", "found"])

    rows = documents.select(*keep, F.col("text").cast("binary").alias("_bytes"))
    one = T.StructType([T.StructField(x, T.LongType()) for x in ("h", "pos", "from")] + [T.StructField("words", T.StringType())])
    schema = documents.select(*keep).schema.add("n_words", T.LongType()).add("found", T.ArrayType(one))
    return rows.mapInArrow(run, schema)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """One row a document row: the kept columns (default doc_id), n_words, n_hit, items (sorted ids as strings), contaminated."""
    keep = ["doc_id"] if keep is None else keep
    windows = materialise(item_windows(benchmark, window), "item-windows")
    lengths = [row.n for row in windows.select(F.least("size", F.lit(SHINGLE)).alias("n")).distinct().collect()]
    none = F.array().cast("array<string>")
    if not lengths:
        clean = candidates(documents, None, [], window, keep)
        return clean.select(*keep, "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"), F.lit(False).alias("contaminated"))
    every = windows.select(F.explode("shingles").alias("h"))
    counts = shingle_counts(documents, bits_of(every.select(_slot("h").alias("slot")), LOG2_BITS), lengths)
    prefix = materialise(prefixes(windows, counts), "prefixes")
    bits = bits_of(prefix.select(_slot("h").alias("slot")), LOG2_BITS)
    found = candidates(documents, bits, lengths, window, keep).withColumn("row", F.monotonically_increasing_id())
    found = materialise(found, "candidates")
    each = found.where(F.size("found") > 0).select("row", "n_words", F.explode("found").alias("c")).select("row", "n_words", "c.*")
    start = F.col("pos") - F.col("at")
    words = F.slice(F.split("words", " "), (F.col("start") - F.col("from") + 1).cast("int"), F.col("size"))
    hits = (
        each.join(prefix, "h").withColumn("start", start)
        .where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
        .where(F.array_join(words, " ") == F.col("content"))
        .select("row", "start", "size", "item_id")
    )
    hits = materialise(hits, "hits")
    covered = hits.select("row", "start", "size").distinct().select("row", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("p"))
    n_hit = covered.distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    items = hits.select("row", F.col("item_id").cast("string").alias("item")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = found.select("row", *keep, "n_words").join(n_hit.join(items, "row"), "row", "left")
    n = F.coalesce("n_hit", F.lit(0))
    return out.select(*keep, "n_words", n.alias("n_hit"), F.coalesce("items", none).alias("items"), (n > 0).alias("contaminated"))
