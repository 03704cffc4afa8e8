"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 equal segments; for each it has a mean m and a standard deviation s.  For two vectors and segments
of length L the squared distance is at least the sum of L * ((m - m')^2 + (s - s')^2), so, as the norms are the statistics' own, the
inner product is at most the sum of L * (m * m' + s * s').  Blocks of queries meet blocks of candidates: coarse bounds first, then finer
ones for the rows and columns that are left, and whole vectors for what survives all of them.  A query's threshold is the score of
its k-th best candidate so far.  Bounds only save work: they have a margin over rounding, and scores are exact.

Components are whole numbers, floor(scale * x).  Queries go out in chunks of at most `chunk_bytes`, whatever their number; a chunk
first meets a fixed share of the candidates, which gives it thresholds, and then all of them.  A task keeps k candidates a query of the
chunk and the tasks' lists are merged by a window.  The candidates are read once per chunk and never shuffled.

Defined results: vectors that are null or hold null or non-finite components (also after scaling) take no part.  Shorter vectors count
as filled with zeros.  A row is no candidate of itself, but repeated rows are candidates of each other.  A null id is no query; as a
candidate it comes after others of the same score.  Ties go to the smaller id.  Scores of any size are ranked exactly; a score beyond 64
bits is returned as null.  Extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import materialise
from shelfmark.llm.ordering import with_offset
from shelfmark.session import run_folder

K, SCALE = 20, 64
SEGMENTS = (1, 4, 16)
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 2048
CHUNK_BYTES = 16 << 20
SAMPLE = 16
MARGIN = 1e-9
SPARSE = 0.02
LOWEST = {np.float64: -np.inf, np.int64: np.iinfo(np.int64).min, object: -(1 << 4000)}
OUT = "query_id long, rank int, vec_id long, score long"


def whole_vectors(frame: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """vec_id, v array<double> of whole numbers, top (greatest absolute component) of the vectors that take part."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                values = np.floor(values * scale)
            rows = np.repeat(np.arange(len(lengths)), lengths)
            kept = lists.is_valid().to_numpy(zero_copy_only=False).copy()
            kept[rows[~np.isfinite(values)]] = False
            top = np.zeros(len(lengths))
            np.maximum.at(top, rows[kept[rows]], np.abs(values[kept[rows]]))
            offsets = np.concatenate(([0], np.cumsum(lengths[kept])))
            vectors = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[kept[rows]]))
            ids = batch.column(0).take(pa.array(np.flatnonzero(kept)))
            yield pa.RecordBatch.from_arrays([ids, vectors, pa.array(top[kept])], ["vec_id", "v", "top"])

    rows = frame.select(F.col(id_column).cast("long").alias("vec_id"), vector)
    return rows.mapInArrow(run, "vec_id long, v array<double>, top double")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width))
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), place] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def statistics(vectors: np.ndarray, segments: tuple[int, ...] = SEGMENTS) -> list[np.ndarray]:
    """One matrix a resolution, coarse to fine: means and deviations of the segments, times the root of the segment length.

    The product of two such rows is the upper bound of the inner product of the vectors.
    """
    out = []
    for count in segments:
        pieces = vectors.reshape(len(vectors), count, -1)
        root = pieces.shape[2] ** 0.5
        out.append(np.concatenate((pieces.mean(2) * root, pieces.std(2) * root), axis=1))
    return out


def _floats(scores: np.ndarray) -> np.ndarray:
    if scores.dtype != object:
        return scores.astype(np.float64)
    return np.array([float(x) if abs(x) < 1 << 1000 else (np.inf if x > 0 else -np.inf) for x in scores.tolist()])


class _Best:
    """The k best candidates of every query of a chunk, and their thresholds."""

    def __init__(self, floors: np.ndarray, k: int):
        self.floors, self.k, self.rows, self.waiting = floors, k, None, []
        self.count = 0

    def add(self, query, score, known, vec_id) -> None:
        self.waiting.append((query, score, known, vec_id))
        self.count += len(query)
        if self.count > (1 << 20) + 4 * self.k * len(self.floors):
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        query, score, known, vec_id = (np.concatenate(c) for c in zip(*([self.rows] if self.rows else []), *self.waiting, strict=True))
        order = np.lexsort((vec_id, ~known, -score, query))
        query, score, known, vec_id = query[order], score[order], known[order], vec_id[order]
        starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        last = place == self.k - 1
        self.floors[query[last]] = np.maximum(self.floors[query[last]], score[last])
        few = place < self.k
        self.rows, self.waiting, self.count = (query[few], score[few], known[few], vec_id[few]), [], int(few.sum())


def _block(best: _Best, at: np.ndarray, q: dict, c: dict, lowest) -> None:
    """Compares the queries `at` with one block of candidates (columns in the order of ties)."""
    rows, columns, floors = at, np.arange(len(c["row"])), best.floors
    needed = _floats(floors[rows]) - MARGIN * (float(q["norm"][rows].max()) * float(c["norm"].max()) + 1)
    for queries, others in zip(q["levels"], c["levels"], strict=True):
        near = ~(queries[rows] @ others[columns].T < needed[:, None])  # bounds past the range of doubles rule nothing out
        kept_rows, kept_columns = near.any(1), near.any(0)
        if not kept_rows.any():
            return
        rows, columns, needed, near = rows[kept_rows], columns[kept_columns], needed[kept_rows], near[np.ix_(kept_rows, kept_columns)]
    if near.mean() < SPARSE:  # few single pairs are left
        a, b = np.nonzero(near)
        score = (q["v"][rows[a]] * c["v"][columns[b]]).sum(1)
        good = (score >= floors[rows[a]]) & (q["row"][rows[a]] != c["row"][columns[b]])
        a, b, score = rows[a[good]], columns[b[good]], score[good]
        best.add(a, score, c["known"][b], c["vec_id"][b])
        return
    scores = q["v"][rows] @ c["v"][columns].T
    _, own_rows, own_columns = np.intersect1d(q["row"][rows], c["row"][columns], return_indices=True)
    scores[own_rows, own_columns] = lowest
    many = np.flatnonzero((scores >= floors[rows][:, None]).sum(1) > best.k)
    if len(many):  # the block's own k-th score is a threshold too; of equal scores the first columns count
        part = scores[many]
        kth = np.sort(part, axis=1)[:, -best.k] if scores.dtype == object else np.partition(part, part.shape[1] - best.k, axis=1)[:, -best.k]
        floors[rows[many]] = np.maximum(floors[rows[many]], kth)
        equal = part == kth[:, None]
        room = best.k - (part > kth[:, None]).sum(1)
        part[equal & (np.cumsum(equal, axis=1) > room[:, None])] = lowest
        scores[many] = part
    a, b = np.nonzero((scores >= floors[rows][:, None]) & (scores > lowest))
    best.add(rows[a], scores[a, b], c["known"][columns[b]], c["vec_id"][columns[b]])


def _side(batch: pa.RecordBatch, width: int, kind) -> dict:
    ids, vectors = batch.column("vec_id"), _matrix(batch.column("v"), width)
    with np.errstate(over="ignore", invalid="ignore"):
        levels, norm = statistics(vectors), np.sqrt((vectors * vectors).sum(1))
    whole = np.array([[int(x) for x in row] for row in vectors.tolist()], object).reshape(vectors.shape) if kind is object else vectors.astype(kind)
    return {
        "row": batch.column("row").to_numpy(), "vec_id": ids.fill_null(0).to_numpy(), "known": ids.is_valid().to_numpy(zero_copy_only=False),
        "v": whole, "levels": levels, "norm": norm,
    }


def _picked(side: dict, rows) -> dict:
    return {name: [level[rows] for level in x] if name == "levels" else x[rows] for name, x in side.items()}


def _scan(candidates: DataFrame, chunk: pa.RecordBatch, floors: list, width: int, kind, k: int) -> DataFrame:
    """Each task's k best candidates of every query of a chunk, as far as they reach the floors.

    row, query_id, vec_id, score (null beyond 64 bits), wide (digits of the score where any may be beyond).
    """
    sent = candidates.sparkSession.sparkContext.broadcast((chunk, floors))

    def run(batches):
        queries, own = sent.value
        q, best = _side(queries, width, kind), _Best(np.array(own, dtype=kind), k)
        for batch in batches:
            c = _side(batch, width, kind)
            for start in range(0, len(c["row"]), CANDIDATE_BLOCK):
                block = _picked(c, slice(start, start + CANDIDATE_BLOCK))
                block = _picked(block, np.lexsort((block["vec_id"], ~block["known"])))
                for first in range(0, len(q["row"]), QUERY_BLOCK):
                    _block(best, np.arange(first, min(first + QUERY_BLOCK, len(q["row"]))), q, block, LOWEST[kind])
        best.settle()
        if best.rows is None:
            return
        query, score, known, vec_id = best.rows
        scores = [int(x) for x in score.tolist()]
        yield pa.RecordBatch.from_arrays([
            pa.array(q["row"][query]), pa.array(q["vec_id"][query]), pa.array(vec_id, mask=~known),
            pa.array([x if abs(x) < 1 << 63 else None for x in scores], pa.int64()),
            pa.array([str(x) if kind is object else None for x in scores], pa.string()),
        ], ["row", "query_id", "vec_id", "score", "wide"])

    return candidates.mapInArrow(run, "row long, query_id long, vec_id long, score long, wide string")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all tasks.  Scores with digits compare by sign, length and digits."""
    negative, size = F.startswith("wide", F.lit("-")), F.length("wide")
    wide = [negative, F.when(negative, size).otherwise(-size), F.when(negative, F.col("wide")), F.when(~negative, F.col("wide")).desc()]
    order = Window.partitionBy("row").orderBy(*wide, F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_scores(frame: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE,
               chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of greatest inner product for every row that fulfils `is_query`.

    The condition reads the column `vec_id`.
    """
    spark = frame.sparkSession
    vectors = materialise(whole_vectors(frame, id_column, vector, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    measured = vectors.agg(F.max(F.size("v")).alias("n"), F.max("top").alias("top")).first()
    if measured.n is None:
        return spark.createDataFrame([], OUT)
    width = max(1, -(-measured.n // SEGMENTS[-1])) * SEGMENTS[-1]
    most = width * int(measured.top) ** 2
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
    numbered, total = with_offset(vectors.where(is_query).select("row", "vec_id", "v"), ["row"])
    size = max(1, chunk_bytes // (8 * width))
    chunks = materialise(numbered.withColumn("chunk", (F.col("offset") / size).cast("long")).drop("offset"), "queries", "chunk")
    sample = vectors.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0)
    target = f"{run_folder(spark)}/scores-{uuid.uuid4().hex}"
    for number in range(-(-total // size)):
        chunk = chunks.where(F.col("chunk") == number).select("row", "vec_id", "v").toArrow().combine_chunks().to_batches()[0]
        kth = _ranked(_scan(sample, chunk, [LOWEST[kind]] * len(chunk), width, kind, k), k).where(F.col("rank") == k)
        known = {r.row: r.score if r.wide is None else int(r.wide) for r in kth.select("row", "score", "wide").collect()}
        floors = [known.get(row, LOWEST[kind]) for row in chunk.column("row").to_pylist()]
        _ranked(_scan(vectors, chunk, floors, width, kind, k), k).select("query_id", "rank", "vec_id", "score").write.parquet(f"{target}/chunk={number}")
    if not total:
        return spark.createDataFrame([], OUT)
    return spark.read.schema(OUT).parquet(target).select("query_id", "rank", "vec_id", "score")
