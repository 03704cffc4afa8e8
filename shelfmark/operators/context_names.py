"""Names built from context: the words of a file's content, name and folders, ranked by weight."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import names as N
from shelfmark.functions import vocab as V
from shelfmark.session import materialise

WORDS = "[a-z0-9]+"
STOPWORDS = frozenset(V.CONTEXT_STOPWORDS)
LIMIT = 5
WEIGHTS = {"content": 3, "context": 2, "ext": 1}


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), 0)


def _useful(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(V.CONTEXT_STOPWORDS))


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word))))


def _context() -> Column:
    higher = F.get("dirs", F.size("dirs") - 2)
    parent = F.get("dirs", F.size("dirs") - 1)
    return F.concat_ws(" ", F.col("stem"), parent, higher)


def _with_terms(files: DataFrame, k: int = LIMIT) -> DataFrame:
    """Adds ``terms`` from names and folders alone: short lists, ranked inside the row."""
    context, ext = _words(_context()), _words(F.col("ext"))

    def weighed(term: Column) -> Column:
        weight = (
            F.size(F.filter("_ctx", lambda x: x == term)) * WEIGHTS["context"]
            + F.size(F.filter("_ext", lambda x: x == term)) * WEIGHTS["ext"]
        )
        return F.struct((-weight).alias("w"), F.array_position("_all", term).alias("p"), term.alias("term"))

    return (
        files.withColumn("_ctx", context)
        .withColumn("_ext", ext)
        .withColumn("_all", F.filter(F.concat("_ctx", "_ext"), lambda t: (F.length(t) >= 3) & ~t.isin(V.CONTEXT_STOPWORDS)))
        .withColumn("_ranked", F.array_sort(F.transform(F.array_distinct("_all"), weighed)))
        .withColumn("terms", F.slice(F.col("_ranked.term"), 1, k))
        .drop("_ctx", "_ext", "_all", "_ranked")
    )


def best_terms(content: str, context: str, ext: str, k: int = LIMIT) -> list[str]:
    """The ``k`` heaviest terms of one file, from its texts in lower case: by weight, then first appearance."""
    weights: dict[str, int] = {}
    for text, weight in ((content, WEIGHTS["content"]), (context, WEIGHTS["context"]), (ext, WEIGHTS["ext"])):
        for word, n in Counter(re.findall(WORDS, text)).items():  # in order of first appearance, as is the sum
            weights[word] = weights.get(word, 0) + n * weight
    useful = ((word, w) for word, w in weights.items() if len(word) >= 3 and word not in STOPWORDS)
    return [word for word, _ in sorted(useful, key=lambda pair: -pair[1])[:k]]


def _terms_in_row(files: DataFrame, content: str, k: int) -> DataFrame:
    """``(path, terms)`` of files whose path no other row has: ranked where the text is read."""
    low = [F.lower(F.coalesce(text, F.lit(""))) for text in (F.col(content), _context(), F.col("ext"))]
    rows = files.select("path", *[text.alias(name) for name, text in zip(("c", "x", "e"), low, strict=True)])

    def run(batches):
        for batch in batches:
            texts = zip(*(batch.column(at) for at in (1, 2, 3)), strict=True)
            terms = [best_terms(c.as_py(), x.as_py(), e.as_py(), k) for c, x, e in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], names=["path", "terms"])

    return rows.mapInArrow(run, "path string, terms array<string>")


def ranked_terms(files: DataFrame, content: str, k: int = LIMIT) -> DataFrame:
    """``(path, terms)``: the ``k`` heaviest terms of each file by weight, then first appearance, then term.

    A file that is one row is ranked where its text is read, and only ``k`` terms leave the task.  Rows that share a path count
    together: their texts are cut into words where they are read, and counted there before words are shuffled.
    """
    shared = materialise(files.groupBy("path").count().where("count > 1").select("path"), "shared-paths")
    single = _terms_in_row(files.join(shared, "path", "left_anti"), content, k)
    return single.unionByName(_terms_of_shared(files.join(shared, "path", "left_semi"), content, k))


def _terms_of_shared(files: DataFrame, content: str, k: int) -> DataFrame:
    context, ext = _words(_context()), _words(F.col("ext"))
    said, around = F.size("_content"), F.size("_content") + F.size("_context")
    placed = (
        files.select("path", "dirs", "stem", "ext", content)
        .select("path", _words(F.col(content)).alias("_content"), context.alias("_context"), ext.alias("_ext"))
        .select("path", said.alias("_n"), around.alias("_m"), F.concat("_content", "_context", "_ext").alias("_all"))
    )
    weight = F.when(F.col("pos") < F.col("_n"), WEIGHTS["content"]).when(F.col("pos") < F.col("_m"), WEIGHTS["context"]).otherwise(
        WEIGHTS["ext"]
    )
    terms = (
        placed.select("path", "_n", "_m", F.posexplode("_all").alias("pos", "term"))
        .filter((F.length("term") >= 3) & ~F.col("term").isin(V.CONTEXT_STOPWORDS))
        .groupBy("path", "term")
        .agg(F.sum(weight).alias("w"), F.min("pos").alias("p"))
    )
    order = Window.partitionBy("path").orderBy(F.desc("w"), "p", "term")
    return (
        terms.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= k)
        .groupBy("path")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "term"))), lambda t: t["term"]).alias("terms"))
    )


def contextual_names(files: DataFrame, content: str | None = None, topic: str | None = None, score: str | None = None,
                     label: str | None = None, serial_as_suffix: bool = False) -> DataFrame:
    """Adds ``context_name`` to files with parts.

    ``topic`` and ``score`` name optional classifier columns; a confident topic leads the name.  ``label`` is an optional
    column with a context label, which takes precedence over the ranked terms.
    """
    parent = F.get("dirs", F.size("dirs") - 1)
    clean_stem = F.trim("stem")
    empty = F.array().cast("array<string>")
    lead = empty
    if topic:
        sure = (F.col(topic) != V.UNSORTED) & (F.col(score) >= V.TOPIC_SCORE)
        lead = F.when(F.coalesce(sure, F.lit(False)), _useful(_words(F.replace(F.col(topic), F.lit("_"), F.lit(" "))))).otherwise(empty)
    if content is None:
        named = _with_terms(files)
    else:
        named = files.join(ranked_terms(files, content), "path", "left")
    first = F.slice(F.array_distinct(F.concat(lead, F.coalesce("terms", empty))), 1, LIMIT)
    from_stem = F.slice(_useful(_words(F.col("stem"))), 1, LIMIT)
    from_parent = F.slice(_useful(_words(parent)), 1, LIMIT)
    selected = F.when(F.size(first) > 0, first).when(F.size(from_stem) > 0, from_stem).otherwise(from_parent)
    named = named.withColumn("_human", F.transform(selected, _capital)).withColumn("_serial", N.serial_prefix(clean_stem))
    serial = F.array("_serial")
    plain = F.when(F.col("_serial").isNotNull(), F.concat(serial, F.slice("_human", 1, 4))).otherwise(F.col("_human"))
    if label:
        words = F.transform(
            F.filter(F.regexp_extract_all(F.coalesce(F.col(label), F.lit("")), F.lit("[A-Za-z0-9]+"), 0),
                     lambda w: ~F.lower(w).isin(V.CONTEXT_STOPWORDS)), _capital)
        kept = F.filter(F.regexp_extract_all(clean_stem, F.lit("[A-Za-z0-9]+"), 0), lambda w: ~F.lower(w).isin(V.CONTEXT_STOPWORDS))
        silent = (clean_stem == "") | (F.col("ext").isin(V.IMAGE_EXT) & F.col("_serial").isNotNull()) | N.is_vague(clean_stem, F.col("ext"))
        base = F.when(silent, empty).otherwise(F.slice(F.transform(kept, _capital), 1, 3))
        named = named.withColumn("_label", words).withColumn("_own", base)
        rest = F.slice("_human", F.lit(1), F.greatest(F.lit(0), LIMIT - F.size("_label")))
        if serial_as_suffix:
            with_serial = F.concat(F.slice("_label", 1, 4), serial)
        else:
            with_serial = F.concat(F.slice("_label", 1, 2), serial, F.slice("_own", 1, 2))
        labelled = (
            F.when(F.col("_serial").isNotNull(), with_serial)
            .when(F.size("_own") > 0, F.concat("_label", "_own"))
            .otherwise(F.concat("_label", rest))
        )
        plain = F.when(F.coalesce(F.col(label), F.lit("")) != "", labelled).otherwise(plain)
    joined = F.substring(F.array_join(F.slice(plain, 1, LIMIT), "_"), 1, V.MAX_NAME)
    name = F.when(F.size("_human") > 0, F.regexp_replace(joined, "^_+|_+$", ""))
    return named.withColumn("context_name", name).select(*files.columns, "context_name")
