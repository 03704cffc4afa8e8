"""Near-duplicate classes: DartMinHash signatures of word shingles, banded joining, exact check of candidates, components.

A document is the weighted set of its runs of five words (of all its words if it has fewer), weighted by how often they occur.
Documents with equal sets are one node from the start, so exact copies cost nothing later.  In each band's bucket every node is
compared with the bucket's pivot, never with all others; pivots are the nodes that share most buckets, the middle of a group of near
copies.  Pairs are checked exactly on the shingles and give classes.  Nodes that are not in the class of their pivot go on: first with
a second pivot, whose class saves comparisons within it, then all of them, second pivots and their classes too, with those members of
other classes that they can still match.  A node cannot match at all if it has edits of its own in over a fifth of its shingles; two
nodes cannot match if they share too little beyond what the first pivot has, so groups are dealt out again by what their nodes have
beyond their pivot (``_dealt``).  Sub-buckets that still hold several classes are compared block by block (``_settled``); pairs are never
listed.  So every match that shares a bucket is found or joins nodes of one class.  A pair of similarity 0.8 shares none of the 32 bands of five coordinates with a probability of
3 in a million.

Defined results: a null text is a class of its own; texts without words are copies if they are equal; repeated rows belong to one
class; the class id is the smallest doc_id of the class (null only where no other is there; rows with null ids are linked by their texts
like all others); extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import bit_test, bits_of, byte_slices, is_empty, materialise
from shelfmark.llm.components import components
from shelfmark.llm.dart import common_weight, excess, signature
from shelfmark.llm.words import mix, run_hashes, word_hashes, word_spans

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
FEW, MANY, WORDS_OF_BLOCK = 64, 512, 1 << 20  # bounds of a block of nodes that are compared at once
COLUMNS = 4096
SLICE = 2 << 20
LOG2_BITS = 22


def shingle_sets(column, size: int = WORDS):
    """(row, text bytes, sorted shingle hashes, counts) of each text of a binary column."""
    row = 0
    for _, offsets, data in byte_slices(column, SLICE):
        low, starts, ends, firsts = word_spans(offsets, data)
        hashes = word_hashes(low, starts, ends)
        for k in range(len(offsets) - 1):
            own = hashes[firsts[k] : firsts[k + 1]]
            keys, counts = np.unique(run_hashes(own, min(size, len(own))) if len(own) else own, return_counts=True)
            yield row, data[offsets[k] : offsets[k + 1]], keys, counts
            row += 1


def _name(text: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Equal for equal sets; of the text itself where there are no words."""
    content = b"s" + keys.tobytes() + counts.astype(np.int64).tobytes() if len(keys) else b"t" + text.tobytes()
    return hashlib.blake2b(content, digest_size=16).digest()


def signed(documents: DataFrame, keep: list[str], bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The kept columns, node (16 bytes, null for a null text), keys (one bucket key a band; null without words)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep))
            null = texts.is_null().to_pylist()
            nodes, buckets = [], []
            for row, text, keys, counts in shingle_sets(texts):
                nodes.append(None if null[row] else _name(text, keys, counts))
                if not len(keys):
                    buckets.append(None)
                    continue
                parts = signature(keys, counts.astype(np.float64), bands * rows).reshape(bands, rows)
                key = np.arange(bands, dtype=np.uint64)
                for k in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
                buckets.append(key.view(np.int64).tolist())
            columns = [*batch.columns[: len(keep)], pa.array(nodes, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "node", "keys"])

    rows_in = documents.select(*keep, F.col("text").cast("binary").alias("_bytes"))
    schema = documents.select(*keep).schema.add("node", T.BinaryType()).add("keys", T.ArrayType(T.LongType()))
    return rows_in.mapInArrow(run, schema)


def _sets_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, shingles, counts of the wanted (row_hash, node) rows, made again from the texts."""
    slot = F.pmod(F.col("row_hash"), F.lit(1 << LOG2_BITS))
    bits = bits_of(wanted.select(slot.alias("slot")), LOG2_BITS)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(bit_test(bits, batch.column(2).to_numpy(zero_copy_only=False))))
            nodes, shingles, counted = [], [], []
            for _, text, keys, counts in shingle_sets(batch.column(1)):
                nodes.append(_name(text, keys, counts))
                shingles.append(keys.view(np.int64))
                counted.append(counts.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.binary()), pa.array(shingles, pa.list_(pa.int64())), pa.array(counted, pa.list_(pa.int32()))],
                ["row_hash", "node", "shingles", "counts"])

    rows = documents.where(F.col("text").isNotNull()).select(F.xxhash64("doc_id", "text").alias("row_hash"), F.col("text").cast("binary").alias("t"))
    found = rows.select("row_hash", "t", slot.alias("slot")).mapInArrow(run, "row_hash long, node binary, shingles array<long>, counts array<int>")
    found = found.join(wanted, ["row_hash", "node"], "left_semi")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("counts").alias("counts"))


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("counts").alias("ca"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("counts").alias("cb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "ca", "sb", "cb")


def _set_pairs(batch: pa.RecordBatch):
    """(shingles, counts, shingles, counts) of each row of _with_sets."""
    flat = [np.asarray(batch.column(k).flatten()) for k in range(2, 6)]
    cuts = [np.concatenate(([0], np.cumsum(batch.column(k).value_lengths().to_numpy()))) for k in range(2, 6)]
    for i in range(len(batch)):
        parts = [flat[k][cuts[k][i] : cuts[k][i + 1]] for k in range(4)]
        yield parts[0].view(np.uint64), parts[1], parts[2].view(np.uint64), parts[3]


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, common weight and similarity of pairs of nodes."""

    def run(batches):
        for batch in batches:
            found = [(common_weight(*x), float(x[1].sum()) + float(x[3].sum())) for x in _set_pairs(batch)]
            common = [c for c, _ in found]
            sim = [c / (total - c) for c, total in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.float64()), pa.array(sim, pa.float64())], ["a", "b", "common", "sim"])

    return _with_sets(pairs, sets).mapInArrow(run, "a binary, b binary, common double, sim double")


def _beyond(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """node, pivot, shingle, w: what a node has beyond its pivot.  pairs: a (node), b (pivot)."""

    def run(batches):
        for batch in batches:
            parts = [excess(*x) for x in _set_pairs(batch)]
            row = pa.array(np.repeat(np.arange(len(parts)), [len(k) for k, _ in parts]))
            keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
            weights = np.concatenate([w for _, w in parts]) if parts else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(keys.view(np.int64)), pa.array(weights.astype(np.int32))],
                                             ["node", "pivot", "shingle", "w"])

    return _with_sets(pairs, sets).mapInArrow(run, "node binary, pivot binary, shingle long, w int")


def _ordered(left: str, right: str):
    return F.least(left, right).alias("a"), F.greatest(left, right).alias("b")


def _open_rows(near: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose node is not in the class of its bucket's pivot."""
    own = near.join(labels.withColumnRenamed("label", "own"), "node", "left")
    other = labels.select(F.col("node").alias("pivot"), F.col("label").alias("other"))
    apart = own.join(other, "pivot", "left").where(F.coalesce("own", "node") != F.coalesce("other", "pivot"))
    return apart.select("key", "node", "weight")


def _shared(sets: DataFrame, used: DataFrame) -> DataFrame:
    """node, size (of its set), common (size of the part that other used nodes have too)."""
    mine = sets.join(used.select("node").distinct(), "node", "left_semi")
    size = F.aggregate("counts", F.lit(0), lambda x, y: x + y)
    mine = mine.select("node", size.alias("size"), F.arrays_zip("shingles", "counts").alias("z"))
    each = mine.select("node", F.explode("z").alias("z")).select("node", "z.shingles", "z.counts")
    alone = each.groupBy("shingles").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.min("counts").alias("w")).where("n = 1")
    lost = alone.groupBy("node").agg(F.sum("w").alias("lost"))
    return mine.select("node", "size").join(lost, "node", "left").select("node", "size", (F.col("size") - F.coalesce("lost", F.lit(0))).alias("common"))


def _mixed(members: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one class, with n (nodes in the bucket); of buckets with the same nodes one is kept."""
    content = F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("content")
    seen = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), content, F.min("label").alias("low"), F.max("label").alias("high"))
    once = materialise(seen.where("low != high").groupBy("n", "content").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "mixed")
    return materialise(members.join(once, "bucket"), "members")


def _dealt(group: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Sub-buckets (bucket, node, size, label) of groups that were compared with one node each, its pivot.

    group: bucket, pivot, node, near (weight in common with the pivot), size, label.  A group is held against the pivot and all shingles
    that over half of its nodes have beyond it, so that these make no sub-buckets.  What two nodes share is at most what this middle has in
    common with either, plus what they share beyond it.  So either both sizes are so small that the first part is enough (one sub-bucket
    for these), or a certain weight is shared beyond the middle: then the rarest shingles beyond it, up to where less than that weight is
    left, have one in common (a sub-bucket for each of these shingles).
    """
    need = threshold / (1 + threshold)  # of the sum of both sizes; no match is smaller than `threshold` times a node
    least = materialise(group.groupBy("bucket").agg(F.min("size").alias("least"), F.count(F.lit(1)).alias("nodes")), "least")
    pairs = group.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    beyond = group.select("bucket", "node", "pivot", "label").join(materialise(_beyond(pairs, sets), "beyond"), ["node", "pivot"])
    beyond = materialise(beyond.drop("pivot"), "beyond")
    counted = beyond.groupBy("bucket", "shingle").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    # Only shingles that nodes of two classes have can be shared by a pair that still counts.
    rarity = counted.where("low != high").join(least, "bucket").select("bucket", "shingle", "n", (F.col("n") * 2 > F.col("nodes")).alias("hot"))
    ranked = materialise(beyond.drop("label").join(materialise(rarity, "rarity"), ["bucket", "shingle"]), "ranked")
    more = ranked.where("hot").groupBy("bucket", "node").agg(F.sum("w").alias("more"))
    group = group.join(least, "bucket").join(materialise(more, "more"), ["bucket", "node"], "left")
    near = F.col("near") + F.coalesce("more", F.lit(0))
    both = F.col("size") + F.greatest("least", threshold * F.col("size"))
    group = materialise(group.select("bucket", "node", "size", "label", (need * both - near - 1e-9).alias("lack")), "group")
    by_size = group.where("lack <= 0").select(F.xxhash64("bucket").alias("sub"), "node", "size", "label")
    window = Window.partitionBy("bucket", "node").orderBy(F.desc("n"), F.desc("shingle"))
    ranked = ranked.where("not hot").withColumn("left", F.sum("w").over(window))  # weight of this one and all more frequent ones
    ranked = ranked.select("bucket", "node", "shingle", "left").join(group, ["bucket", "node"])
    by_rest = ranked.where(F.col("left") >= F.greatest(F.lit(1.0), F.ceil("lack")))
    by_rest = by_rest.select(F.xxhash64("bucket", "shingle").alias("sub"), "node", "size", "label")
    return materialise(by_size.union(by_rest).withColumnRenamed("sub", "bucket").distinct(), "dealt")


def _elements(shingles: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, element) of weighted sets: a shingle that occurs n times is n elements, so that common weights are common elements."""
    row = np.repeat(np.arange(len(shingles)), shingles.value_lengths().to_numpy())
    keys, times = np.asarray(shingles.flatten()).view(np.uint64), np.asarray(counts.flatten()).astype(np.int64)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    keys = np.repeat(keys, times)
    return np.repeat(row, times), np.where(nth == 0, keys, mix(keys + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _common(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], n_left: int, n_right: int) -> np.ndarray:
    """How many elements each of n_left rows has in common with each of n_right rows; COLUMNS elements at a time."""
    (own_a, times), own_b = np.unique(left[1], return_counts=True), np.unique(right[1])
    both = own_a[times > 1] if left is right else np.intersect1d(own_a, own_b, assume_unique=True)
    (row_a, at_a), (row_b, at_b) = [(row[held], np.searchsorted(both, keys[held])) for row, keys in (left, right) for held in (np.isin(keys, both),)]
    out = np.zeros((n_left, n_right))
    for first in range(0, len(both), COLUMNS):
        a, b = np.zeros((n_left, COLUMNS), np.float32), np.zeros((n_right, COLUMNS), np.float32)
        for side, row, at in ((a, row_a, at_a), (b, row_b, at_b)):
            inside = (at >= first) & (at < first + COLUMNS)
            side[row[inside], at[inside] - first] = 1
        out += a @ b.T
    return out


def _joining(links: np.ndarray, labels: np.ndarray) -> list[int]:
    """Which rows of links (pairs of positions in labels) join classes that the rows before them leave apart."""
    root = np.arange(labels.max() + 1) if len(labels) else labels

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    chosen = []
    for k, (x, y) in enumerate(links):
        x, y = top(labels[x]), top(labels[y])
        if x != y:
            root[x] = y
            chosen.append(k)
    return chosen


def _settled(members: DataFrame, sets: DataFrame, threshold: float, few: int = FEW):
    """Frames (a, b) of matches that join the classes of each bucket of members (bucket, node, size, label).

    A bucket that holds several classes is cut into blocks, and each block meets each block; what a group holds is bounded by nodes
    (an eighth of the bucket, `few` at least and MANY at most) and by words (WORDS_OF_BLOCK).  All nodes of two blocks are compared
    exactly at once; of the matches those that join classes go on.
    """
    members = _mixed(members)
    if is_empty(members):
        return []
    words = materialise(members.groupBy("bucket").agg(F.sum("size").alias("words")), "words")
    per_block = F.least(F.lit(MANY), F.greatest(F.lit(few), F.col("n") / 8))
    blocks = F.greatest(F.ceil(F.col("n") / per_block), F.ceil(F.col("words") / WORDS_OF_BLOCK)).cast("int").alias("blocks")
    placed = members.join(words, "bucket").select("bucket", "node", "label", blocks)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.select("bucket", "node", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    # Blocks of one class have nothing to compare.
    apart = placed.groupBy("bucket", "low", "high").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first != last")
    placed = placed.join(materialise(apart.select("bucket", "low", "high"), "apart"), ["bucket", "low", "high"])
    placed = materialise(placed.select("bucket", "low", "high", "block", "node", "label"), "placed")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("node")
        nodes, names = group.column("node").combine_chunks(), group.column("label").combine_chunks()
        labels = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        block = group.column("block").to_numpy()
        row, keys = _elements(group.column("shingles").combine_chunks(), group.column("counts").combine_chunks())
        sizes = np.bincount(row, minlength=len(block)).astype(np.float64)
        sides = [np.nonzero(block == x)[0] for x in (block.min(), block.max())]
        parts = []
        for x, side in zip((block.min(), block.max()), sides):
            held = block[row] == x
            parts.append((np.searchsorted(side, row[held]), keys[held]))
        common = _common(*(parts if block.min() < block.max() else parts[:1] * 2), len(sides[0]), len(sides[1]))
        match = common / (sizes[sides[0]][:, None] + sizes[sides[1]][None, :] - common) >= threshold
        found = np.argwhere(match & (labels[sides[0]][:, None] != labels[sides[1]][None, :]))
        found = np.stack([sides[0][found[:, 0]], sides[1][found[:, 1]]], 1)
        found.sort(axis=1)  # a < b, since nodes are in order
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        found = found[_joining(found, labels)]
        return pa.table({"a": nodes.take(pa.array(found[:, 0])), "b": nodes.take(pa.array(found[:, 1]))})

    met = placed.join(sets, "node").groupBy("bucket", "low", "high").applyInArrow(compare, "a binary, b binary")
    return [materialise(met.distinct(), "match")]


def links(documents: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD, rounds: int = 2) -> DataFrame:
    """a, b: checked matches that join the nodes of every class.  nodes: node, row_hash (of one of its rows), keys."""
    rows = nodes.where("keys is not null").select("node", F.explode("keys").alias("key"))
    # Aggregates are written before they are joined by their own key: read back, both sides are dealt out anew, and a hot key can be split.
    shared_keys = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-keys")
    full = materialise(rows.join(shared_keys, "key"), "buckets")
    weight = full.groupBy("node").agg(F.sum("n").alias("weight"))
    full = materialise(full.select("key", "node").join(weight, "node"), "weighted")
    used = full.select("node").distinct()
    wanted = materialise(nodes.select("row_hash", "node").join(used, "node", "left_semi"), "wanted")
    sets = materialise(_sets_of(documents, wanted), "sets")
    open_rows, found, first, begun, could = full, None, None, None, None
    for _ in range(rounds):
        pivots = open_rows.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top")).select("key", F.col("top.node").alias("pivot"))
        pivots = materialise(pivots, "pivots")
        near = materialise(open_rows.join(pivots, "key").where("node != pivot"), "near")
        checked = materialise(_checked(near.select(*_ordered("node", "pivot")).distinct(), sets), "checked")
        match = checked.where(F.col("sim") >= threshold).select("a", "b")
        found = materialise(match if found is None else found.union(match), "found")
        if first is None:
            first = near.select("key", "node", "pivot", *_ordered("node", "pivot")).join(checked.select("a", "b", "common"), ["a", "b"])
            begun = near
        labels = components(found)
        # Always against the first pivots: a second pivot and its class have met no other member of the first one's class.
        open_rows = materialise(_open_rows(begun, labels), "open")
        if is_empty(open_rows):
            return found
        if could is None:
            shared = materialise(_shared(sets, full.join(open_rows.select("key").distinct(), "key", "left_semi")), "shared")
            could = shared.where(F.col("common") >= threshold * F.col("size")).select("node")
        open_rows = materialise(open_rows.join(could, "node", "left_semi"), "open")
        if is_empty(open_rows):
            return found
    # Groups by first pivot, of the pivots with open rows: all their nodes that can match anything beside the pivot.
    begun = materialise(first.join(open_rows.select("key").distinct(), "key", "left_semi").select("pivot").distinct(), "begun")
    facts = shared.join(could, "node", "left_semi").join(labels, "node", "left").select("node", "size", F.coalesce("label", "node").alias("label"))
    # Dealt out by node before the distinct, else it would keep the dealing by pivot, and a hot pivot could not be split.
    group = first.join(begun, "pivot", "left_semi").select("pivot", "node", F.col("common").alias("near")).repartition("node").distinct()
    group = materialise(group.join(facts, "node").withColumn("bucket", F.xxhash64("pivot")), "group")
    for match in _settled(_dealt(group, sets, threshold), sets, threshold):
        found = found.union(match)
    return materialise(found, "found")


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (default: doc_id), class_id, n_links (checked matches of its text with other texts), first_row for every row.

    first_row is true for the row of the class with the smallest doc_id (ties by a hash of id and text; repeated rows alike).
    """
    keep = ["doc_id"] if keep is None else keep
    # Kept columns go by numbers inside, so that no name can clash.
    inner = documents.select(F.col("doc_id"), F.col("text"), F.xxhash64("doc_id", "text").alias("row_hash"), *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep)])
    kept = [f"kept_{k}" for k in range(len(keep))]
    rows = materialise(signed(inner, ["doc_id", "row_hash", *kept]), "signed")
    known = rows.where("node is not null")
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")).alias("lowest")
    nodes = materialise(known.groupBy("node").agg(lowest, F.first("keys", ignorenulls=True).alias("keys")), "nodes")
    edges = materialise(links(inner, nodes.select("node", "lowest.row_hash", "keys"), threshold).distinct(), "links")
    labels = components(edges)
    classed = nodes.select("node", "lowest").join(labels, "node")
    of_class = classed.groupBy("label").agg(F.min("lowest").alias("of_class"))
    degree = edges.select(F.col("a").alias("node")).union(edges.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    linked = labels.join(of_class, "label").join(degree, "node").select("node", "of_class", "n_links")
    classes = nodes.join(linked, "node", "left").select(
        "node", F.coalesce("of_class", "lowest").alias("of_class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = rows.select("doc_id", "row_hash", *kept, "node").join(materialise(classes, "classes"), "node", "left")
    class_id = F.when(F.col("of_class").isNull(), F.col("doc_id")).otherwise(F.col("of_class.doc_id")).alias("class_id")
    first_row = F.coalesce(F.col("of_class.row_hash") == F.col("row_hash"), F.lit(True)).alias("first_row")
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], class_id, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), first_row)
