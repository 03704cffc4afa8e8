"""From candidates to a plan: decide, hold, vote, place, and check the result against the 1-in-150 guard."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions import vocab as V
from shelfmark.operators.classify import decide
from shelfmark.operators.index import with_codes
from shelfmark.operators.rules import rule_destination, split_inventory, strip_scan_root
from shelfmark.operators.vote import folder_vote
from shelfmark.session import materialise

PLAN = ["path", "topic", "destination", "count", "rel"]


@dataclass(frozen=True)
class SortSettings:
    lead: float = V.LEAD_THRESHOLD
    vote: bool = True
    vote_share: float = 0.8
    min_files: int = 20
    no_info_rule: bool = True
    vote_type_check: bool = True

    def clamped(self) -> SortSettings:
        pulled = {name: min(max(getattr(self, name), low), high) for name, (low, high) in V.SETTING_LIMITS.items()}
        return replace(self, **{**pulled, "min_files": int(pulled["min_files"])})


def presets(first: dict | None = None, lead: float = V.LEAD_THRESHOLD) -> dict[str, SortSettings]:
    """``first`` is the strict pass, ``second`` the normal one."""
    second = SortSettings(lead=lead)
    return {"first": replace(second, **{**V.FIRST_PASS, **(first or {})}).clamped(), "second": second.clamped()}


def sort_files(routed: DataFrame, settings: SortSettings = SortSettings(), dense: float = V.DENSE_THRESHOLD) -> DataFrame:
    """Adds ``topic`` and ``how`` (model, vote, held or unsorted) to routed rows with parts and ``candidates``."""
    settings = settings.clamped()
    held = ~P.has_information(F.col("dirs"), F.col("stem")) if settings.no_info_rule else F.lit(False)
    decided = (
        decide(routed, dense, settings.lead)
        .withColumn("held", held)
        .withColumn("own", F.when(F.col("held"), V.UNSORTED).otherwise(F.col("topic")))
        .withColumn("near", F.when(F.col("held"), V.UNSORTED).otherwise(F.col("nearest")))
        .drop("topic", "nearest")
    )
    if settings.vote:
        # The vote reads the verdicts several times; they are written once, so no model runs twice.
        decided = materialise(decided, "verdicts")
        voted = folder_vote(decided, settings.vote_share, settings.min_files, settings.vote_type_check)
    else:
        voted = decided.withColumns({"topic": F.col("own"), "voted": F.lit(False), "blocked": F.lit(False)})
    how = (
        F.when(F.col("held"), "held")
        .when(F.col("own") != V.UNSORTED, "model")
        .when(F.col("topic") != V.UNSORTED, "vote")
        .otherwise("unsorted")
    )
    return voted.withColumn("how", how)


def sort_stats(sorted_rows: DataFrame) -> DataFrame:
    return sorted_rows.agg(
        F.count_if("voted").alias("voted"),
        F.count_if("held").alias("held_no_information"),
        F.count_if("blocked").alias("blocked_by_type"),
        F.count_if(F.col("topic") == V.UNSORTED).alias("unsorted"),
    )


def guard(rows: DataFrame, topic: str = "topic") -> DataFrame:
    """Pass when at most one routed row in 150 is unsorted."""
    return rows.agg(
        F.count(F.lit(1)).alias("needing"), F.count_if(F.col(topic) == V.UNSORTED).alias("unsorted")
    ).select(
        "needing", "unsorted", F.floor(F.col("needing") / V.GUARD_DIVISOR).alias("allowed"),
        (F.col("unsorted") <= F.floor(F.col("needing") / V.GUARD_DIVISOR)).alias("passed"),
    )


def split_once(inventory: DataFrame, seen: Observation | None = None) -> DataFrame:
    """The three-way split, written once by placement: every later step reads only its own part.

    ``seen`` gets the number of inventory rows (``source_rows``) while they are written.
    """
    if seen is not None:
        inventory = inventory.observe(seen, F.count(F.lit(1)).alias("source_rows"))
    split = split_inventory(P.with_parts(inventory))
    return materialise(split, "split", partition_by="placement")


def routed_texts(split: DataFrame, types: str | None = "ext") -> DataFrame:
    """Routed rows with the ``text`` a classifier reads.  The cheap rules run before any model."""
    text = P.plan_text(F.col("dirs"), F.col("stem"), F.col("ext"), types)
    return split.filter("placement = 'routed'").withColumn("text", text)


def organization_plan(inventory: DataFrame, index: DataFrame, classify: Callable[[DataFrame], DataFrame],
                      settings: SortSettings = SortSettings(), seen: Observation | None = None) -> DataFrame:
    """``(path, topic, destination, count, rel)``: units as one row, junk and routed files one row each.

    ``classify`` adds ``candidates`` to rows with ``text``.
    """
    split = split_once(inventory, seen)
    nothing = F.lit(None).cast("string")
    units = (
        split.filter("placement = 'unit'")
        .groupBy(F.col("unit").alias("path"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select("path", nothing.alias("topic"), F.lit(V.SOFTWARE_DIR).alias("destination"), "count",
                P.relative_parent(P.directories(P.components(F.col("path")))).alias("rel"))
    )
    junk = split.filter("placement = 'junk'").select(
        "path", nothing.alias("topic"), rule_destination().alias("destination"), F.lit(1).cast("long").alias("count"),
        P.relative_parent(F.col("dirs")).alias("rel"),
    )
    placed = with_codes(sort_files(classify(routed_texts(split)), settings), index).select(
        "path", "topic", "destination", F.lit(1).cast("long").alias("count"), nothing.alias("rel")
    )
    return units.unionByName(junk).unionByName(placed)


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("destination").agg(F.sum("count").alias("files"))


def conservation(inventory: DataFrame, plan: DataFrame) -> DataFrame:
    """Every inventory row must be in a given plan exactly once."""
    planned = plan.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).scalar()
    return inventory.agg(F.count(F.lit(1)).alias("source_rows")).select(
        "source_rows", planned.alias("planned_rows"), (F.col("source_rows") == planned).alias("conserved")
    )


def checked_plan(inventory: DataFrame, index: DataFrame, classify: Callable[[DataFrame], DataFrame],
                 settings: SortSettings = SortSettings()) -> tuple[DataFrame, dict]:
    """The written plan and its checks: ``source_rows``, ``planned_rows``, ``conserved``, ``needing``, ``unsorted``, ``allowed``, ``passed``.

    The rows are counted while the split and the plan are written, so no check reads or computes anything again.
    """
    seen, planned = Observation("source"), Observation("plan")
    plan = organization_plan(inventory, index, classify, settings, seen)
    placed = F.col("topic").isNotNull()
    counted = plan.observe(planned, F.coalesce(F.sum("count"), F.lit(0)).alias("planned_rows"), F.count_if(placed).alias("needing"),
                           F.count_if(placed & (F.col("topic") == V.UNSORTED)).alias("unsorted"))
    written = materialise(counted, "plan")
    checks = {**seen.get, **planned.get}
    allowed = checks["needing"] // V.GUARD_DIVISOR
    conserved = checks["source_rows"] == checks["planned_rows"]
    return written, {**checks, "conserved": conserved, "allowed": allowed, "passed": checks["unsorted"] <= allowed}


def loop_check(inventory: DataFrame, index: DataFrame, classify: Callable[[DataFrame], DataFrame],
               settings: SortSettings = SortSettings(), types: str | None = "ext") -> dict[str, DataFrame]:
    """The check from an inventory alone: ``assignments``, ``stats``, the guard's ``verdict`` and ``leftovers``."""
    split = split_once(strip_scan_root(inventory))
    sorted_rows = sort_files(classify(routed_texts(split, types)), settings)
    known = with_codes(sorted_rows, index)
    units = split.filter("placement = 'unit'").agg(F.count_distinct("unit").alias("n")).scalar()
    ruled = split.filter("placement = 'junk'").agg(F.count(F.lit(1)).alias("n")).scalar()
    verdict = guard(known).select("*", units.alias("units"), ruled.alias("junk"))
    how = F.when(F.col("how") == "held", "unsorted").otherwise(F.col("how"))
    return {
        "assignments": known.select("path", F.col("topic").alias("bucket"), how.alias("how")),
        "stats": sort_stats(sorted_rows),
        "verdict": verdict,
        "leftovers": known.filter(F.col("topic") == V.UNSORTED).select("path", "dirs", "dir", "base", "stem", "ext", "candidates"),
    }
