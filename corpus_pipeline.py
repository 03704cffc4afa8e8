"""The corpus pipeline: language ID, near-dedup, benchmark decontamination, mixing to target weights, sharding.

Every stage takes (spark, docs, sf_dir), works on all documents it is given and returns those it keeps; the next stage reads them
from Parquet.  The last stage adds the shard and the slot of each document.  Stages carry the columns of `documents` (extra columns
go along); an empty table passes through all of them.

* language: documents without a language (``und``: null or no letters) or with a score below ``MIN_SCORE`` go.
* near_dedup: of each class of near-duplicates the document with the smallest doc_id stays (null last); of repeated rows one stays.
* decontaminate: documents that contain a window of a benchmark item go.
* mix: documents whose fitted rate is below one half go (rates are rounded to 0 or 1, so nothing is repeated).
* shard: everything stays.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.llm.common import arrow_rows, materialise, table
from shelfmark.llm.decontaminate import contamination
from shelfmark.llm.hilbert import document_shards
from shelfmark.llm.langid import label_rows
from shelfmark.llm.mixing import mix
from shelfmark.llm.neardup import near_duplicates

MIN_SCORE = 0.4
MIN_RATE = 0.5
SHARDS = 24
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark, docs, sf_dir):
    arrow_rows(spark)
    labelled = label_rows(docs, docs.columns)
    return labelled.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def _without(docs, gone):
    """The rows of docs whose doc_id and text hash are not in `gone` (doc_id, text_hash)."""
    docs, gone = docs.withColumn("text_hash", F.xxhash64("text")).alias("d"), gone.distinct().alias("g")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.text_hash") == F.col("g.text_hash"))
    return docs.join(gone, same, "left_anti").drop("text_hash")


def near_dedup(spark, docs, sf_dir):
    arrow_rows(spark)
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    classes = near_duplicates(hashed, keep=["doc_id", "text_hash"])
    kept = _without(docs, classes.where("not first_row").select("doc_id", "text_hash"))
    return kept.dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def decontaminate(spark, docs, sf_dir):
    arrow_rows(spark)
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    found = contamination(hashed, table(spark, sf_dir, "benchmark"), keep=["doc_id", "text_hash"])
    return _without(docs, found.where("contaminated").select("doc_id", "text_hash"))


def mix_domains(spark, docs, sf_dir):
    arrow_rows(spark)
    return mix(docs, table(spark, sf_dir, "labels"), keep=docs.columns).where(F.col("rate") >= MIN_RATE).select(*docs.columns)


def shard(spark, docs, sf_dir):
    return document_shards(docs, SHARDS, docs.columns)


def _carrying(stage):
    """Hides the names of extra columns from a stage, so that none can clash; a column that the stage makes itself wins."""

    def run_stage(spark, docs, sf_dir):
        hidden = {name: f"extra_{k}" for k, name in enumerate(docs.columns) if name not in OWN}
        out = stage(spark, docs.withColumnsRenamed(hidden), sf_dir)
        made = [k for k, name in hidden.items() if k in out.columns]
        return out.drop(*[hidden[k] for k in made]).withColumnsRenamed({v: k for k, v in hidden.items() if k not in made})

    return run_stage


STAGES = [(name, _carrying(stage)) for name, stage in (
    ("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix_domains), ("shard", shard))]
# Learned models and hashed signatures have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
