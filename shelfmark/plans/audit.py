"""Mapping audit of a whole inventory: every file against the index, without votes, and a summary of how well it fits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions import vocab as V
from shelfmark.operators.ranking import ordinal
from shelfmark.session import materialise
from shelfmark.operators.classify import decide, model_text


def audit_text() -> Column:
    """Name and full path, the name included again, with separators as spaces."""
    return F.translate(F.concat_ws(" ", "stem", "path"), "\\/_-", "    ")


def mapping_audit(inventory: DataFrame, index: DataFrame, classify: Callable[[DataFrame], DataFrame],
                  dense: float = V.DENSE_THRESHOLD, margin: float = V.LEAD_THRESHOLD) -> DataFrame:
    """Per file: text, category, score and percentage, code, low-confidence flag."""
    rows = P.with_parts(inventory).withColumn("text", model_text(audit_text()))
    decided = decide(classify(rows), dense, margin)
    codes = index.select(F.col("category").alias("topic"), "code", F.coalesce("profile.description", "category").alias("profile_used"))
    low = F.when(F.col("score") < dense, "__YES__").otherwise("__NO__")
    return decided.join(codes, "topic", "left").select(
        "path", "stem", "ext", "text", "topic", "score",
        F.format_string("%.2f%%", F.col("score") * 100).alias("confidence_pct"),
        F.coalesce("code", F.lit("Unknown")).alias("code"),
        low.alias("low_confidence"),
        F.coalesce("profile_used", "topic").alias("profile_used"),
    )


def category_shares(audit: DataFrame, topic: str = "topic") -> DataFrame:
    """Files, share and overbroad flag per category."""
    counts = audit.groupBy(topic).agg(F.count(F.lit(1)).alias("files"))
    total = counts.agg(F.sum("files").alias("n")).scalar()
    return counts.select(
        topic, "files", F.round(F.col("files") / total, 4).alias("share"),
        (F.col("files") / total >= V.OVERBROAD_SHARE).alias("overbroad"),
    )


def covered_terms(terms: DataFrame, index: DataFrame, longest: int = V.PHRASE_WORDS) -> DataFrame:
    """``_term``: the terms (lower case, of at most ``longest`` words) that occur in the category names, written one after the other.

    The names are never put into one text.  A term can reach over ``longest`` names at most, so each name is looked at with those that
    follow it in order, and gives its stretches of the lengths that terms have; terms meet them in a join by value.
    """
    numbered = ordinal(index.select(F.lit(0).alias("_all"), "category").distinct(), ["_all"], ["category"], name="_at")
    reached = numbered.select("_at", F.lower("category").alias("_text"), F.length("category").alias("_own"))
    for step in range(1, longest):
        after = numbered.select((F.col("_at") - step).alias("_at"), F.lower("category").alias("_more"))
        reached = reached.join(after, "_at", "left").withColumn("_text", F.concat_ws(" ", "_text", "_more")).drop("_more")
    sizes = terms.agg(F.collect_set(F.length("_term")).alias("n")).scalar()  # as many as terms have different lengths
    at = reached.select("_text", F.explode(F.sequence(F.lit(1), F.col("_own") + 1)).alias("_from"), sizes.alias("_sizes"))
    cut = at.select("_text", "_from", F.explode("_sizes").alias("_size")).filter(F.col("_from") + F.col("_size") - 1 <= F.length("_text"))
    return cut.select(F.substring("_text", F.col("_from"), F.col("_size")).alias("_term")).distinct().join(terms.select("_term"), "_term", "left_semi")


def missing_terms(evidence: DataFrame, index: DataFrame, weight: float = V.MISSING_TERM_WEIGHT, k: int = 25) -> DataFrame:
    """The heaviest clean terms that no category name contains."""
    clean = evidence.filter((F.col("adjusted_weight") >= weight) & (F.size("noise_labels") == 0))
    clean = materialise(clean.withColumn("_term", F.lower("term")), "clean-terms")
    return (
        clean.join(covered_terms(clean, index), "_term", "left_anti").drop("_term")
        .orderBy(F.when(F.col("token_type") == "single", 0).otherwise(1), F.desc("adjusted_weight"), "term")
        .limit(k)
    )


def validation_summary(audit: DataFrame) -> DataFrame:
    """One row: files, unsorted and low-confidence ratios."""
    ratio = lambda cond: F.round(F.coalesce(F.avg(cond.cast("double")), F.lit(0.0)), 6)
    return audit.agg(
        F.count(F.lit(1)).alias("total_files"),
        ratio(F.col("topic") == V.UNSORTED).alias("unsorted_ratio"),
        ratio(F.col("low_confidence") == "__YES__").alias("low_confidence_ratio"),
    )


def validation_document(audit: DataFrame, missing: DataFrame) -> DataFrame:
    """One row: the summary, every category's share, the overbroad ones, and the terms (`missing_terms`) no category covers."""
    def largest_first(rows: DataFrame, measure: str, item: str, *columns: str) -> Column:
        listed = F.sort_array(F.collect_list(F.struct((-F.col(measure)).alias("_by"), item, *columns)))
        return rows.agg(F.transform(listed, lambda r: F.struct(*[r[c].alias(c) for c in (item, *columns)])).alias("l")).scalar()

    shares = category_shares(audit)  # one row a category of the index
    terms = missing.select("term", "token_type", "adjusted_weight", "sample_files")
    return validation_summary(audit).select(
        "*",
        largest_first(shares, "files", "topic", "files", "share").alias("top_categories"),
        largest_first(shares.filter("overbroad"), "files", "topic", "files", "share").alias("likely_overbroad_categories"),
        largest_first(terms, "adjusted_weight", "term", "token_type", "adjusted_weight", "sample_files").alias("likely_missing_categories"),
    )
