"""Scoring of predictions against labelled truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import vocab as V


def _share(condition: Column) -> Column:
    return F.round(F.coalesce(F.avg(condition.cast("double")), F.lit(0.0)), 4)


def routing_metrics(scored: DataFrame) -> DataFrame:
    """One row from ``(expected, predicted)``: accuracy, abstention and misfile rates."""
    right, abstained = F.col("predicted") == F.col("expected"), F.col("predicted") == V.UNSORTED
    return scored.agg(
        F.count(F.lit(1)).alias("cases"),
        _share(right).alias("accuracy"),
        _share(abstained).alias("abstention_rate"),
        _share(~right & ~abstained).alias("misfile_rate"),
    )


def coarse_group(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in V.COARSE_GROUPS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, category), F.lit("other"))


def benchmark_metrics(scored: DataFrame) -> DataFrame:
    """One row from ``(expected, predicted, top2, expected_group)``; ``top2`` is an array of categories."""
    return scored.agg(
        _share(F.col("predicted") == F.col("expected")).alias("accuracy"),
        _share(F.col("predicted") == V.UNSORTED).alias("unsorted_ratio"),
        _share(F.array_contains("top2", F.col("expected"))).alias("top_2_recall"),
        _share(F.col("expected_group").eqNullSafe(coarse_group(F.col("predicted")))).alias("coarse_accuracy"),
    )


def confusion_pairs(scored: DataFrame, k: int = 10) -> DataFrame:
    wrong = scored.filter(F.col("predicted") != F.col("expected"))
    return (
        wrong.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "expected", "predicted").limit(k)
    )


def with_truth(assignments: DataFrame, truth: DataFrame, aliases: DataFrame) -> DataFrame:
    """Joins ``(path, bucket)`` to ``(path, expected, tag)`` and renames buckets by ``(bucket, alias)``."""
    return (
        assignments.join(truth, "path")
        .join(aliases, "bucket", "left")
        .withColumn("got", F.coalesce("alias", "bucket"))
        .drop("alias")
    )


def judge_score(judged: DataFrame) -> DataFrame:
    """Correct, wrong and missed per ``tag`` and for all, in one pass.  Rows the fixed rules should have taken are only counted."""
    ruled = F.col("expected").isin(V.RULE_BUCKETS)
    right = ~ruled & (F.col("got") == F.col("expected"))
    missed = ~ruled & (F.col("got") != F.col("expected")) & (F.col("got") == V.UNSORTED)
    return (
        judged.rollup("tag")
        .agg(
            F.grouping("tag").alias("_all"),
            F.count_if(~ruled).alias("n"),
            F.count_if(right).alias("correct"),
            F.count_if(~ruled & ~right & ~missed).alias("wrong"),
            F.count_if(missed).alias("missed"),
            F.count_if(~ruled & (F.col("got") == V.UNSORTED)).alias("unsorted"),
            F.count_if(ruled).alias("rule_failures"),
        )
        .withColumn("tag", F.when(F.col("_all") == 1, "all").otherwise(F.col("tag")))
        .drop("_all")
    )


def grid_search(scored: DataFrame) -> DataFrame:
    """Every threshold setting with its metrics and objective, from ``(expected, candidates, expected_group)``.

    Scores are computed once.  A decision depends on a row only through which thresholds its best score and its lead reach, so
    the rows are first counted by those two steps and the outcome; the settings are then applied to that small table.
    """
    best, lead = F.get("candidates", F.lit(0)), F.col("_lead")
    second = F.get("candidates", F.lit(1))
    steps = lambda value, grid: sum(((value >= t).cast("int") for t in grid), F.lit(0))
    top = F.coalesce(best["category"], F.lit(V.UNSORTED))
    cells = (
        scored.withColumn("_lead", best["score"] - F.coalesce(second["score"], F.lit(0.0)))
        .select(
            F.coalesce(steps(best["score"], V.GRID_DENSE), F.lit(0)).alias("dense_step"),
            F.coalesce(steps(lead, V.GRID_LEAD), F.lit(0)).alias("lead_step"),
            (top == F.col("expected")).alias("own_right"),
            (F.col("expected") == V.UNSORTED).alias("unsorted_right"),
            (top == V.UNSORTED).alias("own_unsorted"),
            F.coalesce(F.array_contains(F.slice(F.col("candidates.category"), 1, 2), F.col("expected")), F.lit(False)).alias("in_top2"),
        )
        .groupBy("dense_step", "lead_step", "own_right", "unsorted_right", "own_unsorted", "in_top2")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"), F.lit(d).alias("dense_threshold"), F.lit(m).alias("margin_threshold"),
                F.lit(o).alias("unsorted_override"), F.lit(di + 1).alias("dense_need"), F.lit(mi + 1).alias("lead_need"),
            )
            for i, (di, d, mi, m, o) in enumerate(
                (di, d, mi, m, o) for di, d in enumerate(V.GRID_DENSE) for mi, m in enumerate(V.GRID_LEAD) for o in V.GRID_OVERRIDE
            )
        ]
    )
    tried = cells.select("*", F.inline(grid))
    sure = (F.col("dense_step") >= F.col("dense_need")) & (F.col("lead_step") >= F.col("lead_need"))
    right = F.when(sure, F.col("own_right")).otherwise(F.col("unsorted_right"))
    idle = ~sure | F.col("own_unsorted")
    part = lambda cond: F.round(F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n"), 4)
    return (
        tried.groupBy("ord", "dense_threshold", "margin_threshold", "unsorted_override")
        .agg(part(right).alias("accuracy"), part(idle).alias("unsorted_ratio"), part(F.col("in_top2")).alias("top_2_recall"))
        .withColumn(
            "objective", F.round(F.col("accuracy") - F.col("unsorted_ratio") * 0.5 + F.col("top_2_recall") * 0.25, 6)
        )
    )


def best_setting(grid: DataFrame) -> DataFrame:
    """The first setting, in grid order, with the highest objective."""
    return grid.orderBy(F.desc("objective"), "ord").limit(1)
