"""Nearest-prototype classification with abstention."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.functions import vocab as V
from shelfmark.operators.listed import listed_nearest

# Prototype vectors that a worker holds.  A larger prototype table becomes an inverted list, with the same result.
PROTOTYPE_BLOCK = 20_000
PRODUCT_CELLS = 4_000_000
CANDIDATES = "array<struct<category:string,score:double>>"
# The letters that full lower-casing turns into two or by their neighbours; here every letter has one lower form.
SINGLE_LOWER = {"\u0130": "i", "\u03a3": "\u03c3"}
WORDS_HELD = 100_000  # words whose place a batch remembers


def prototypes(index: DataFrame) -> DataFrame:
    """``(category, cat_ord, proto_id, text)`` from category names, descriptions, aliases and examples.

    Texts are normalised; a repeated text of a category (in any case) counts once, the first one stays.
    """
    texts = F.concat(
        F.array("category", "profile.description"),
        F.coalesce("profile.aliases", F.array().cast("array<string>")),
        F.coalesce("profile.positive_examples", F.array().cast("array<string>")),
    )
    listed = index.select("category", "cat_ord", F.posexplode(F.transform(texts, T.normalise)).alias("pos", "text"))
    return (
        listed.filter("text != ''")
        .groupBy("category", "cat_ord", F.lower("text").alias("_key"))
        .agg(F.min_by("text", "pos").alias("text"), F.min("pos").alias("proto_id"))
        .drop("_key")
    )


def missing_profiles(index: DataFrame, profiles: DataFrame) -> DataFrame:
    return index.join(profiles, "category", "left_anti").select("category")


def hashed_tokens(texts: list[str], dim: int = 256) -> np.ndarray:
    """``hashed_vector`` for texts in Python.  Any function list[str] -> matrix can take its place."""
    out = np.zeros((len(texts), dim))
    places: dict[str, int] = {}
    for row, text in enumerate(texts):
        for letter, small in SINGLE_LOWER.items():
            text = text.replace(letter, small)
        counts = [0] * dim
        for word, n in Counter(re.findall(r"[^\W_]+", text.lower())).items():
            place = places.get(word)
            if place is None:
                place = places[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim
            counts[place] += n
        out[row] = counts
        if len(places) > WORDS_HELD:
            places.clear()
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1.0, norms)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, not again in every inner function that reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hashed_vector(text: Column, dim: int = 256) -> Column:
    """Default encoder: L2-normalised counts of hashed words (letters and digits, lower case), by built-in functions only."""
    for letter, small in SINGLE_LOWER.items():
        text = F.replace(text, F.lit(letter), F.lit(small))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    digits = -(-(dim.bit_length() - 1) // 4) if dim & (dim - 1) == 0 else 8  # the last hex digits decide for a power of two
    start, size = 9 - max(digits, 1), max(digits, 1)
    places = F.sort_array(F.transform(words, lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), start, size), 16, 10).cast("long") % dim).cast("int")))

    def vector(present: Column, starts: Column, total: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, dim), F.array(total.cast("long") + 1))
        return _let(F.zip_with(starts, ends, lambda a, b: (b - a).cast("double")), lambda n: _let(
            F.sqrt(F.aggregate(n, F.lit(0.0), lambda x, y: x + y * y)), lambda norm: F.transform(
                F.sequence(F.lit(0), F.lit(dim - 1)),
                lambda k: F.coalesce(F.get(n, (F.array_position(present, k) - 1).cast("int")) / norm, F.lit(0.0)))))

    return _let(places, lambda s: _let(F.array_distinct(s), lambda present: _let(
        F.transform(present, lambda d: F.array_position(s, d)), lambda starts: vector(present, starts, F.size(s)))))


def model_prefix(model: str, role: str) -> str:
    """E5 models were trained with ``query: `` and ``passage: `` prefixes; other models read the plain text."""
    return f"{role}: " if "e5" in model.lower() else ""


def encoder_column(text: Column, encode: Callable[[list[str]], np.ndarray] = hashed_tokens, prefix: str = "", double: bool = False) -> Column:
    kind, number = ("array<double>", np.float64) if double else ("array<float>", np.float32)

    @F.pandas_udf(kind)
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            matrix = encode([prefix + t for t in batch]) if len(batch) else []
            yield pd.Series(list(np.asarray(matrix, dtype=number)), index=batch.index)

    return vectors(text)


def model_text(text: Column, max_chars: int | None = None) -> Column:
    """The normalised text a model reads: all of it, or its first ``max_chars`` characters for models that take no more."""
    whole = T.normalise(text)
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


def text_key(text: Column) -> Column:
    return F.sha1(text)


def _cache_key(sha1: Column) -> Column:
    """The hash, with a value for missing texts that a join can meet."""
    return F.coalesce(sha1, F.lit(""))


def encoding_todo(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct ``(text_sha1, text)`` of a ``text`` column that the cache of this model does not hold yet.

    A missing text has no hash and is encoded, once, as a text without words.
    """
    keyed = texts.select(_cache_key(text_key(F.col("text"))).alias("_key"), "text")
    distinct = keyed.groupBy("_key").agg(F.first("text").alias("text"))
    held = cache.filter(F.col("model") == model).select(_cache_key(F.col("text_sha1")).alias("_key"))
    return distinct.join(held, "_key", "left_anti").select(F.nullif("_key", F.lit("")).alias("text_sha1"), "text")


def encode_new(texts: DataFrame, cache: DataFrame, model: str, encode: Callable | None = None) -> DataFrame:
    """New cache rows ``(model, text_sha1, vec)``: every unseen text is encoded once, however many rows carry it.

    Without ``encode``, a function list[str] -> matrix, the default encoder makes the vectors.
    """
    todo = encoding_todo(texts, cache, model)
    text = F.coalesce("text", F.lit(""))
    vec = encoder_column(text, encode, model_prefix(model, "query")) if encode else hashed_vector(text)
    return todo.select(F.lit(model).alias("model"), "text_sha1", vec.alias("vec"))


def with_cached_vectors(rows: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    vectors = cache.filter(F.col("model") == model).select(_cache_key(F.col("text_sha1")).alias("_key"), "vec")
    keyed = rows.withColumn("text_sha1", text_key(F.col("text"))).withColumn("_key", _cache_key(F.col("text_sha1")))
    return keyed.join(vectors, "_key", "left").drop("_key")


def _score_block(vec: Column, owners: np.ndarray, categories: list[str], matrix: np.ndarray, top_k: int, digits: int | None, spark) -> Column:
    """Candidates by a prototype table that a worker can hold, best prototype per category.

    The product of a batch is made in pieces of at most ``PRODUCT_CELLS`` numbers (8 bytes each).
    """
    shared = spark.sparkContext.broadcast((owners, np.asarray(categories, dtype=object), matrix))

    @F.pandas_udf(CANDIDATES)
    def candidates(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        owner, names, protos = shared.value
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        piece = max(1, PRODUCT_CELLS // len(protos))
        for batch in batches:
            out = np.empty(len(batch), dtype=object)
            out[:] = [[] for _ in range(len(batch))]
            known = np.flatnonzero(batch.notna().to_numpy())
            for first in range(0, len(known), piece):
                rows = known[first : first + piece]
                queries = np.stack(batch.iloc[rows].to_numpy()).astype(np.float64)
                best = np.maximum.reduceat(queries @ protos.T, starts, axis=1)
                if digits is not None:
                    best = np.round(best, digits)
                order = np.argsort(-best, axis=1, kind="stable")[:, :top_k]
                for at, row, scores in zip(rows, order, best):
                    out[at] = [{"category": names[c], "score": float(scores[c])} for c in row]
            yield pd.Series(out, index=batch.index)

    return candidates(vec)


def nearest(rows: DataFrame, protos: DataFrame, vec: str = "vec", top_k: int = 3, digits: int | None = None,
            block: int = PROTOTYPE_BLOCK) -> DataFrame:
    """Adds ``candidates``: the ``top_k`` categories by best prototype, best first, ties by ``cat_ord``.

    ``protos`` is ``(category, cat_ord, vec)``.  Up to ``block`` prototypes go to the workers and the pass over the rows is part of the
    caller's plan, without a shuffle.  More are kept as an inverted list (``listed_nearest``), with the same result.  Vectors made by
    ``hashed_vector`` should be stored first (the cache, or ``materialise``): Spark does not take a Python function over higher-order
    functions in every plan.
    """
    ranked = protos.select("category", "cat_ord", F.col("vec").cast("array<double>").alias("vec"))
    total = ranked.count()
    if total > block:
        return listed_nearest(rows, ranked, total, vec, top_k, digits)
    if not total:
        return rows.withColumn("candidates", F.array().cast(CANDIDATES))
    part = ranked.toPandas().sort_values("cat_ord", kind="stable")
    names = part.drop_duplicates("cat_ord")["category"].tolist()
    matrix = np.stack(part["vec"].to_numpy()).astype(np.float64)
    return rows.withColumn("candidates", _score_block(F.col(vec), part["cat_ord"].to_numpy(), names, matrix, top_k, digits, rows.sparkSession))


def lead(candidates: Column) -> Column:
    """Best score minus second best; a missing second counts as 0."""
    return F.get(candidates, F.lit(0))["score"] - F.coalesce(F.get(candidates, F.lit(1))["score"], F.lit(0.0))


def decide(rows: DataFrame, dense: float = V.DENSE_THRESHOLD, margin: float = V.LEAD_THRESHOLD) -> DataFrame:
    """Adds ``topic``, ``score`` and ``nearest``.  Low confidence or a small lead means Unsorted, as does no candidate."""
    best = F.get("candidates", F.lit(0))
    sure = (best["score"] >= dense) & (lead(F.col("candidates")) >= margin)
    return rows.withColumns(
        {
            "topic": F.when(sure, best["category"]).otherwise(V.UNSORTED),
            "score": F.coalesce(best["score"], F.lit(0.0)),
            "nearest": F.coalesce(best["category"], F.lit(V.UNSORTED)),
        }
    )
