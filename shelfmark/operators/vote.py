"""The folder vote: rows a classifier refused follow the deepest folder that agrees on a category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions import vocab as V


def folder_counts(rows: DataFrame) -> DataFrame:
    """``(folder, near, ext, n)`` over every ancestor folder.

    Files are first counted by their own folder, so what is multiplied by the depth is folders, not files.
    """
    own = rows.groupBy("dir", "near", "ext").agg(F.count(F.lit(1)).alias("n"))
    return (
        own.withColumn("_dirs", P.dirs_of(F.col("dir")))
        .select("near", "ext", "n", F.inline(P.ancestors(F.col("_dirs"))))
        .groupBy("folder", "near", "ext")
        .agg(F.sum("n").alias("n"))
    )


def winners(counts: DataFrame, share: float = 0.8, min_files: int = 20) -> DataFrame:
    """``(folder, winner, agreeing, total)`` of the folders that may vote.  Equal counts go to the first name."""
    near = counts.groupBy("folder", "near").agg(F.sum("n").alias("n"))
    best = near.groupBy("folder").agg(
        F.sum("n").alias("total"), F.min_by("near", F.struct(-F.col("n"), F.col("near"))).alias("winner"), F.max("n").alias("agreeing")
    )
    return best.filter(
        (F.col("total") >= min_files) & (F.col("winner") != V.UNSORTED) & (F.col("agreeing") / F.col("total") >= share)
    )


def type_support(counts: DataFrame, won: DataFrame) -> DataFrame:
    """``(folder, ext, support)`` over the files that agree with the winner of a folder."""
    same = (counts["folder"] == won["folder"]) & (counts["near"] == won["winner"])
    return counts.join(won.select("folder", "winner"), same, "left_semi").select("folder", "ext", F.col("n").alias("support"))


def follow_table(rows: DataFrame, counts: DataFrame, won: DataFrame, type_check: bool = True) -> DataFrame:
    """``(dir, ext, follow, blocked)`` for folders and types with refused files: which category they follow, if any.

    Only the deepest voting folder is asked; when its type check says no, its parents are not tried.
    """
    refused = rows.filter((F.col("own") == V.UNSORTED) & ~F.col("held")).select("dir", "ext").distinct()
    deepest = (
        refused.withColumn("_dirs", P.dirs_of(F.col("dir")))
        .select("dir", "ext", F.inline(P.ancestors(F.col("_dirs"))))
        .join(won.select("folder", "winner", "agreeing"), "folder")
        .groupBy("dir", "ext")
        .agg(F.max_by(F.struct("folder", "winner", "agreeing"), "depth").alias("v"))
        .select("dir", "ext", "v.*")
    )
    if not type_check:
        return deepest.select("dir", "ext", F.col("winner").alias("follow"), F.lit(False).alias("blocked"))
    seen = deepest.join(type_support(counts, won), ["folder", "ext"], "left")
    # All agreeing files are in the support, so its total is the winning count.
    enough = F.coalesce("support", F.lit(0)) >= F.greatest(F.lit(2.0), F.col("agreeing") * 0.05)
    return seen.select("dir", "ext", F.when(enough, F.col("winner")).alias("follow"), (~enough).alias("blocked"))


def folder_vote(rows: DataFrame, share: float = 0.8, min_files: int = 20, type_check: bool = True) -> DataFrame:
    """Adds ``topic``, ``voted`` and ``blocked``.

    ``rows`` has ``dir``, ``ext``, ``own`` (category or Unsorted), ``near`` (closest category even when refused; Unsorted for
    held rows) and ``held``.  The final join has one row per (dir, ext) on its right side, so a folder holding a large part of
    all rows can be divided freely by the skew join.
    """
    counts = folder_counts(rows)
    won = winners(counts, share, min_files)
    table = follow_table(rows, counts, won, type_check)
    refused = (F.col("own") == V.UNSORTED) & ~F.col("held")
    return (
        rows.join(table, ["dir", "ext"], "left")
        .withColumn("voted", refused & F.col("follow").isNotNull())
        .withColumn("blocked", refused & F.coalesce("blocked", F.lit(False)))
        .withColumn("topic", F.when(F.col("voted"), F.col("follow")).otherwise(F.col("own")))
        .drop("follow")
    )
