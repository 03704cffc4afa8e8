"""Writers.  Typed results go to parquet; the two list formats other tools read go to delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import changes as C
from shelfmark.operators.classify import encode_new


def write_audit(evidence: DataFrame, path: str) -> None:
    evidence.write.mode("overwrite").parquet(path)


def theme_table(singles: DataFrame, phrases: DataFrame) -> DataFrame:
    return singles.unionByName(phrases)


def write_theme_evidence(singles: DataFrame, phrases: DataFrame, path: str) -> None:
    """Single terms before phrases, heaviest first: a range-partitioned sort, written by all tasks."""
    kind = F.when(F.col("token_type") == "single", 0).otherwise(1)
    theme_table(singles, phrases).orderBy(kind, F.desc("adjusted_weight"), "term").write.mode("overwrite").parquet(path)


def theme_lists(singles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``term: count`` by count and ``term<TAB>weight`` by weight, as lines."""
    counts = singles.orderBy(F.desc("raw_count"), "term").select(
        F.concat_ws(": ", "term", F.col("raw_count").cast("long").cast("string")).alias("line")
    )
    weights = singles.orderBy(F.desc("adjusted_weight"), "term").select(
        F.format_string("%s\t%.4f", "term", "adjusted_weight").alias("line")
    )
    return counts, weights


def write_theme_lists(singles: DataFrame, counts_path: str, weights_path: str) -> None:
    counts, weights = theme_lists(singles)
    counts.write.mode("overwrite").text(counts_path)
    weights.write.mode("overwrite").text(weights_path)


def append_cache(texts: DataFrame, cache: DataFrame, model: str, path: str, **options) -> None:
    """Encodes and appends only what the cache does not hold."""
    encode_new(texts, cache, model, **options).write.mode("append").partitionBy("model").parquet(path)


def export_events(events: DataFrame, exported: DataFrame, path: str) -> None:
    C.pending_export(events, exported).write.mode("append").json(path)


def write_plan(plan: DataFrame, path: str) -> None:
    plan.write.mode("overwrite").partitionBy("destination").parquet(path)
