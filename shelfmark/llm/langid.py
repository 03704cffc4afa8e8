"""Language identification: a bidirectional gated recurrent network over bytes.

Every byte of every text is labelled with language probabilities; a document gets their mean over its letter bytes.  A text runs
through the network in segments of equal length (the last one starts earlier so that it is full; bytes already counted are not
counted again), so time and memory follow the bytes, whatever the lengths.

Training uses a bounded sample: about `per_language` labelled documents a language, chosen by a hash of doc_id, and a few pieces
of each.  Languages are those of the labelled rows.

Defined results: null text or a text without any letter gives ``und`` with score 0; no labelled rows give ``und`` for all; repeated
rows are labelled alike; equal probabilities go to the first language in sorted order; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import byte_slices
from shelfmark.llm.recurrent import GRU, BiRNN

PER_LANGUAGE = 500
PIECES = 6
PIECE = 64
HIDDEN = 12
STEPS = 260
SEGMENT = 192
SLICE = 1 << 20
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True


def training_pieces(labelled: DataFrame, per_language: int = PER_LANGUAGE, pieces: int = PIECES) -> pd.DataFrame:
    """(lang, piece) of a hash-chosen sample whose size does not depend on the size of the table."""
    labelled = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {row.lang: row.n for row in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return pd.DataFrame({"lang": [], "piece": []})
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    limit = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))]), F.col("lang"))
    raw = F.col("text").cast("binary")
    start = lambda k: (F.greatest(F.octet_length("text") - PIECE, F.lit(0)) * (k / max(1, pieces - 1))).cast("int") + 1
    cut = F.array(*[F.substring(raw, start(k), F.lit(PIECE)) for k in range(pieces)])
    sample = labelled.where(place < limit).select("doc_id", "lang", F.explode(cut).alias("piece"))
    return sample.limit(4 * per_language * pieces * len(counts)).toPandas().sort_values(["doc_id", "piece"])[["lang", "piece"]]


def as_symbols(pieces: list[bytes], width: int) -> np.ndarray:
    joined = b"".join(x[:width].ljust(width, b" ") for x in pieces)
    return np.frombuffer(joined, np.uint8).reshape(len(pieces), width).T


def cross_entropy(model, scores, target):
    labels, weight = target
    e = np.exp(scores - scores.max(2, keepdims=True))
    p = e / e.sum(2, keepdims=True)
    total = max(1.0, float(weight.sum()))
    hit = np.take_along_axis(p, np.broadcast_to(labels[None, :, None], (*weight.shape, 1)), 2)[..., 0]
    d = p.copy()
    d[:, np.arange(len(labels)), labels] -= 1
    return float(-(np.log(hit + 1e-12) * weight).sum() / total), d * weight[..., None] / total, {}


def fit(sample: pd.DataFrame, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> tuple[list[str], BiRNN | None]:
    """Trains on every position of the pieces; languages are drawn evenly."""
    languages = sorted(sample["lang"].unique())
    if not languages:
        return [], None
    by = [as_symbols(sample.loc[sample["lang"] == k, "piece"].tolist(), PIECE) for k in languages]
    rng = np.random.default_rng(seed)

    def batches():
        each = max(1, 192 // len(languages))
        for _ in range(steps):
            x = np.concatenate([rows[:, rng.integers(0, rows.shape[1], each)] for rows in by], axis=1)
            yield x.astype(np.intp), (np.repeat(np.arange(len(languages)), each), IS_LETTER[x].astype(np.float32))

    model = BiRNN(GRU, 256, hidden, len(languages), seed)
    model.train(batches(), cross_entropy)
    return languages, model


def pooled(model: BiRNN, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Mean position probabilities over letters: (texts, languages)."""
    n_texts, n_out = len(offsets) - 1, len(model.p["bias"])
    lengths = np.diff(offsets)
    count = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(n_texts), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.minimum(nth * SEGMENT, np.maximum(lengths[owner] - SEGMENT, 0))
    inside = begin[None, :] + np.arange(SEGMENT)[:, None]
    counted = (inside >= nth * SEGMENT) & (inside < lengths[owner])
    place = np.minimum(offsets[owner] + inside, len(data) - 1)
    symbols = np.where(inside < lengths[owner], data[place], np.uint8(32)).astype(np.intp)
    counted &= IS_LETTER[symbols]
    scores = model.scores(symbols)
    sums = np.zeros((len(owner), n_out), np.float32)
    ones = np.ones((n_out, n_out), np.float32)
    for t in range(SEGMENT):
        p = np.exp(np.clip(scores[t], -30, 30))
        p /= p @ ones
        p *= counted[t][:, None]
        sums += p
    out = np.zeros((n_texts, n_out))
    np.add.at(out, owner, sums)
    letters = np.bincount(owner, counted.sum(0), n_texts)
    return out / np.maximum(letters, 1)[:, None]


def predict(frame: DataFrame, languages: list[str], model: BiRNN | None, keep: list[str]) -> DataFrame:
    """The kept columns, lang_pred, score for every row, from its whole text."""
    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = frame.select(*keep, has_letter.alias("_letter"), F.col("text").cast("binary").alias("_bytes"))
    schema = frame.select(*keep).schema.add("lang_pred", T.StringType()).add("score", T.DoubleType())

    def run(batches):
        for batch in batches:
            found, score = [], []
            for first, offsets, data in byte_slices(batch.column(len(keep) + 1), SLICE):
                rows_here = len(offsets) - 1
                letters = batch.column(len(keep)).slice(first, rows_here).to_numpy(zero_copy_only=False)
                p = pooled(model, offsets, data) if model is not None and len(data) else np.zeros((rows_here, 1))
                best = p.argmax(1)
                known = letters & (p.max(1) > 0)
                found += [languages[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
                score += [min(1.0, float(x)) if ok else 0.0 for x, ok in zip(p.max(1), known, strict=True)]
            columns = [*batch.columns[: len(keep)], pa.array(found, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def label_rows(documents: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, lang_pred and score of every row; learns from the rows that are not held out."""
    labelled = documents.where(~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    languages, model = fit(training_pieces(labelled))
    return predict(documents, languages, model, keep)


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    return label_rows(documents, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
