"""Vector code compression: product codes whose training and search use whole numbers only.

A component x becomes floor(scale * x) and a vector is cut into equal consecutive parts.  Each part position has a codebook, which
starts as the parts of the first vectors and is refined by rounds of assigning and averaging (floor of the mean).  Parts and entries
go through an integer Walsh-Hadamard transform after padding with zeros to a power of two, m.  The squared difference of two
transforms is exactly m times the squared distance, so it can be added up one coefficient after the other in sequency order (few sign
changes first, where most of a smooth part lies): an entry is out as soon as its sum passes the whole sum of a likely entry.  Entries
that only reach it stay, so ties go to the lower index.

A round is one read of the vectors.  A task keeps one sum for each entry and component; these meet in an aggregate whose size depends
on the codebooks alone, as do the codebooks on the driver and in the tasks.

Defined results: vectors that are null or hold null or non-finite components are dropped; so no rows give no rows.  Shorter vectors
count as filled with zeros up to the longest one, and that length is rounded up to whole parts.  First vectors go by id, null ids last,
ties by the vector; repeated rows count each.  Components of any finite size are exact (beyond 64 bits by Python's integers); an error
beyond 64 bits is null.  Extra columns are ignored unless kept.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
SAFE = 1 << 62
LIMB_BITS = 40


@cache
def sequency_order(size: int) -> np.ndarray:
    """Rows of the Walsh-Hadamard matrix of a power of two by their number of sign changes."""
    rows = np.ones((1, 1), np.int8)
    while len(rows) < size:
        rows = np.block([[rows, rows], [rows, -rows]])
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(1), kind="stable")


def walsh(parts: np.ndarray) -> np.ndarray:
    """Transform of the last axis, padded with zeros to a power of two; coefficients in sequency order."""
    width = parts.shape[-1]
    size = 1 << (width - 1).bit_length()
    out = np.zeros((*parts.shape[:-1], size), parts.dtype)
    out[..., :width] = parts
    step = 1
    while step < size:
        pairs = out.reshape(*parts.shape[:-1], -1, 2, step)
        left, right = pairs[..., 0, :], pairs[..., 1, :]
        out = np.stack((left + right, left - right), axis=-2).reshape(out.shape)
        step *= 2
    return out[..., sequency_order(size)]


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for each part, both given as transforms."""
    size = parts.shape[1]
    sums = parts[:, :1] - book[None, :, 0]
    sums = sums * sums
    likely = parts - book[sums.argmin(1)]
    bound = (likely * likely).sum(1)
    row, entry = np.nonzero(sums <= bound[:, None])
    total = sums[row, entry]
    for k in range(1, size):
        apart = parts[row, k] - book[entry, k]
        total = total + apart * apart
        alive = total <= bound[row]
        row, entry, total = row[alive], entry[alive], total[alive]
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    least = np.minimum.reduceat(total, starts)
    _, at = np.unique(row[total == least[row]], return_index=True)
    return entry[total == least[row]][at], least // size


def _floats(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values with NaN for null components, lengths with -1 for null vectors) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False), lengths


def _kept(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    ends = np.cumsum(np.maximum(lengths, 0))
    return (lengths >= 0) & (bad[ends] == bad[ends - np.maximum(lengths, 0)])


def whole_numbers(values: np.ndarray, scale: int, exact: bool) -> np.ndarray:
    """floor(scale * x): as 64-bit integers, or with `exact` as Python integers of any size."""
    if not exact:
        return np.floor(values * scale).astype(np.int64)
    return np.array([int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in values.tolist()] + [None], object)[:-1]


@dataclass(frozen=True)
class Codebooks:
    """entries: (part, entry, position) whole numbers; width: components of a part."""

    entries: np.ndarray
    width: int
    scale: int
    exact: bool

    def parts_of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(which rows are kept, their whole numbers as rows x parts x width)."""
        values, lengths = _floats(column)
        kept = _kept(values, lengths)
        sizes = np.maximum(lengths, 0)
        values, sizes = values[np.repeat(kept, sizes)], sizes[kept]
        out = np.zeros((len(sizes), len(self.entries) * self.width), object if self.exact else np.int64)
        place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(np.arange(len(sizes)), sizes), place] = whole_numbers(values, self.scale, self.exact)
        return kept, out.reshape(len(out), len(self.entries), self.width)

    def assign(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance), each rows x parts."""
        found = [nearest_entries(walsh(parts[:, p]), walsh(book)) for p, book in enumerate(self.entries)]
        return np.stack([index for index, _ in found], 1), np.stack([apart for _, apart in found], 1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.entries.ravel().tolist()).encode()).hexdigest()


def _limbs(value: int):
    """Pieces of a whole number that 64-bit sums can add up: all but the last are not negative."""
    k = 0
    while not -(1 << LIMB_BITS) <= value < 1 << LIMB_BITS:
        yield k, value & ((1 << LIMB_BITS) - 1)
        value >>= LIMB_BITS
        k += 1
    yield k, value


def _measures(frame: DataFrame, vector: str) -> tuple[int, float]:
    """(greatest length, greatest absolute component) of the kept vectors; length -1 without any."""

    def run(batches):
        for batch in batches:
            values, lengths = _floats(batch.column(0))
            kept = _kept(values, lengths)
            if kept.any():
                inside = values[np.repeat(kept, np.maximum(lengths, 0))]
                yield pa.RecordBatch.from_pydict({"n": [int(lengths[kept].max())], "top": [float(np.abs(inside).max(initial=0))]})

    found = frame.select(vector).mapInArrow(run, "n long, top double").agg(F.max("n").alias("n"), F.max("top").alias("top")).first()
    return (-1, 0.0) if found.n is None else (found.n, found.top)


def _first_vectors(frame: DataFrame, id_column: str, vector: str, count: int) -> list[list[float]]:
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = frame.select(F.col(id_column).alias("k"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & whole)
    return [row.v for row in rows.orderBy(F.col("k").asc_nulls_last(), "v").limit(count).collect()]


def _refined(frame: DataFrame, vector: str, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floor of the mean of its parts, unused entries stay."""
    n_parts, n_entries = books.entries.shape[:2]

    def run(batches):
        kind = books.entries.dtype
        sums, counts = np.zeros(books.entries.shape, kind), np.zeros((n_parts, n_entries), np.int64)
        for batch in batches:
            _, parts = books.parts_of(batch.column(0))
            if not len(parts):
                continue
            index, _ = books.assign(parts)
            for p in range(n_parts):
                np.add.at(sums[p], index[:, p], parts[:, p])
                counts[p] += np.bincount(index[:, p], minlength=n_entries)
        out = []
        for p, e in np.argwhere(counts > 0).tolist():
            for at, value in enumerate([int(counts[p, e]), *sums[p, e].tolist()]):
                out += [(p, e, at, limb, piece) for limb, piece in _limbs(int(value))]
        names = ("part", "entry", "at", "limb", "value")
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

    pieces = frame.select(vector).mapInArrow(run, "part int, entry int, at int, limb int, value long")
    totals: dict[tuple[int, int], list[int]] = {}
    for row in pieces.groupBy("part", "entry", "at", "limb").agg(F.sum("value").alias("value")).collect():
        totals.setdefault((row.part, row.entry), [0] * (books.width + 1))[row["at"]] += row.value << (LIMB_BITS * row.limb)
    entries = books.entries.copy()
    for (p, e), (count, *sums) in totals.items():
        entries[p, e] = [x // count for x in sums]
    return Codebooks(entries, books.width, books.scale, books.exact)


def train(frame: DataFrame, id_column: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of a table of vectors, None if no vector is kept."""
    length, top = _measures(frame, vector)
    if length < 0:
        return None
    width = max(1, -(-length // parts))
    padded = 1 << (width - 1).bit_length()
    exact = parts * width * padded * (2 * (scale * int(top + 1) + 1)) ** 2 >= SAFE
    empty = Codebooks(np.zeros((parts, 0, width), object if exact else np.int64), width, scale, exact)
    first = pa.array(_first_vectors(frame, id_column, vector, entries), pa.list_(pa.float64()))
    books = Codebooks(np.ascontiguousarray(empty.parts_of(first)[1].swapaxes(0, 1)), width, scale, exact)
    for _ in range(rounds):
        books = _refined(frame, vector, books)
    return books


def encode(frame: DataFrame, books: Codebooks, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (default vec_id), code string (two hex digits a part; more than 256 entries take more), error long."""
    keep = ["vec_id"] if keep is None else keep
    digits = max(2, len(f"{books.entries.shape[1] - 1:x}"))
    texts = np.array([f"{k:0{digits}x}" for k in range(books.entries.shape[1])], object)
    schema = T.StructType([*frame.select(*keep).schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        for batch in batches:
            kept, parts = books.parts_of(batch.column(len(keep)))
            if not len(parts):
                continue
            index, apart = books.assign(parts)
            codes = texts[index].sum(1)
            errors = [x if x < 1 << 63 else None for x in apart.sum(1).tolist()]
            rows = pa.array(np.flatnonzero(kept))
            columns = [batch.column(k).take(rows) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, pa.string()), pa.array(errors, pa.int64())], schema.names)

    return frame.select(*keep, F.col(vector).alias("_vector")).mapInArrow(run, schema)


def decode(codes: list[str], books: Codebooks) -> np.ndarray:
    """The whole-number vectors that codes stand for."""
    digits = max(2, len(f"{books.entries.shape[1] - 1:x}"))
    index = np.array([[int(code[k : k + digits], 16) for k in range(0, len(code), digits)] for code in codes])
    return books.entries[np.arange(len(books.entries)), index].reshape(len(codes), -1)
