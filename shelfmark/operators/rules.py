"""Fixed rules applied before any classification: shared root removal and the three-way split of an inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions import vocab as V

NO_ROOT = "\\"


def strip_scan_root(inventory: DataFrame, path: str = "path") -> DataFrame:
    """Drops the leading folders shared by every path, never the name itself.

    The common prefix of all paths is the common prefix of the smallest and the largest one, so one partially aggregated pass
    is enough; the answer reaches the rows as a scalar subquery.
    """
    parts = P.components(F.col(path))
    ends = inventory.select(parts.alias("p")).agg(
        F.min("p").alias("lo"), F.max("p").alias("hi"), F.coalesce(F.min(F.size("p")), F.lit(0)).alias("shortest")
    )
    shared = F.filter(
        F.when(F.col("shortest") > 1, F.sequence(F.lit(1), F.col("shortest") - 1)).otherwise(F.array().cast("array<int>")),
        lambda n: F.slice("lo", F.lit(1), n) == F.slice("hi", F.lit(1), n),
    )
    common = ends.select(F.size(shared).alias("common")).scalar()
    return (
        inventory.withColumn("_common", common)
        .withColumn("_parts", parts)
        .withColumn(path, F.array_join(F.slice("_parts", F.col("_common") + 1, F.greatest(F.size("_parts"), F.lit(1))), "/"))
        .drop("_common", "_parts")
    )


def unit_folders(inventory: DataFrame) -> DataFrame:
    """``(dir, unit)`` for every folder inside a software unit; the shallowest registered unit root wins.

    Works on distinct folders, not files: the prefix join costs folders x depth rows however many files a folder holds.
    """
    folders = inventory.select("dir").distinct().withColumn("_dirs", P.dirs_of(F.col("dir")))
    depth = P.bundle_root_depth(F.col("_dirs"))
    # No filter on the depth: it would be pushed below the distinct and tested for every file.  NO_ROOT matches no folder.
    root = F.when(depth > 0, F.array_join(F.slice("_dirs", F.lit(1), depth), "/"))
    roots = folders.select(F.coalesce(root, F.lit(NO_ROOT)).alias("folder")).distinct()
    # A root is a prefix of the folder, so its depth says it all and the aggregate stays a hash aggregate on integers.
    shallowest = folders.select("dir", F.inline(P.ancestors(F.col("_dirs")))).join(roots, "folder").groupBy("dir").agg(
        F.min("depth").alias("_depth")
    )
    return shallowest.select(
        "dir", F.array_join(F.slice(P.dirs_of(F.col("dir")), F.lit(1), F.col("_depth")), "/").alias("unit")
    )


def split_inventory(inventory: DataFrame) -> DataFrame:
    """Adds ``unit``, ``junk`` and ``placement`` (unit, junk or routed) to an inventory with parts."""
    return (
        inventory.join(unit_folders(inventory), "dir", "left")
        .withColumn("junk", F.when(F.col("unit").isNull(), P.junk_tier(F.col("base"))))
        .withColumn(
            "placement", F.when(F.col("unit").isNotNull(), "unit").when(F.col("junk").isNotNull(), "junk").otherwise("routed")
        )
    )


def rule_destination() -> Column:
    """Destination folder of rows placed by rule; null for routed rows."""
    return (
        F.when(F.col("placement") == "unit", V.SOFTWARE_DIR)
        .when(F.col("junk") == "safe", V.SAFE_DIR)
        .when(F.col("junk") == "review", V.REVIEW_DIR)
    )
