"""Aggregated views of an inventory: type table, adaptive folder groups, leftovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions import vocab as V
from shelfmark.operators.ranking import ordinal
from shelfmark.session import materialise

BRANCHES = 30
MIN_BIG = 300
DEPTHS = (2, 3, 4, 5)


def type_label() -> Column:
    return F.when(F.col("ext") == "", "(none)").otherwise(F.col("ext"))


def folder_cells(routed: DataFrame) -> DataFrame:
    """Files per (deepest folder key, type): the table every folder view starts from, written once."""
    keys = [P.folder_key(F.col("dirs"), d).alias(f"k{d}") for d in DEPTHS]
    cells = routed.select(*keys, type_label().alias("type")).groupBy(*[f"k{d}" for d in DEPTHS], "type").agg(
        F.count(F.lit(1)).alias("files")
    )
    return materialise(cells, "folder-cells")


def splitting_folders(cells: DataFrame, min_big: int = MIN_BIG) -> dict[int, dict[str, int]]:
    """Per depth, the folders that are divided one level deeper and how many groups they yield.

    A folder is a candidate when it holds more than max(300, rows / 30) files, so fewer than 30 folders per depth can be: what
    reaches the driver is bounded by that.  Decided bottom-up: a candidate splits when its children yield more than one group.
    """
    total = cells.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
    big = max(min_big, total // BRANCHES)
    splits: dict[int, dict[str, int]] = {DEPTHS[-1]: {}}
    for depth in reversed(DEPTHS[:-1]):
        nodes = (
            cells.groupBy(F.col(f"k{depth}").alias("folder"))
            .agg(F.sum("files").alias("files"), F.count_distinct(f"k{depth + 1}").alias("children"))
            .filter(F.col("files") > big)
            .collect()
        )
        groups = {n["folder"]: n["children"] for n in nodes}
        for child, yielded in splits[depth + 1].items():
            parent = "\\".join(child.split("\\")[:depth])
            if parent in groups:  # a folder that splits is a candidate, and so is its parent
                groups[parent] += yielded - 1
        splits[depth] = {folder: n for folder, n in groups.items() if n > 1}
    return splits


def with_folder_group(keyed: DataFrame, splits: dict[int, dict[str, int]]) -> DataFrame:
    """Adds ``folder``: the first key, from depth 2 down, whose folder is not divided.  A narrow step, no join."""
    folder = F.col(f"k{DEPTHS[-1]}")
    for depth in reversed(DEPTHS[:-1]):
        key = F.col(f"k{depth}")
        folder = F.when(key.isin(list(splits[depth])), folder).otherwise(key) if splits[depth] else key
    return keyed.withColumn("folder", folder)


def folder_groups(routed: DataFrame, min_big: int = MIN_BIG) -> DataFrame:
    """``(folder, type, files)`` with folders grouped adaptively between two and five levels."""
    cells = folder_cells(routed)
    return with_folder_group(cells, splitting_folders(cells, min_big)).groupBy("folder", "type").agg(F.sum("files").alias("files"))


def top_joined(rows: DataFrame, group: str, item: str, count: str, k: int, name: str, sep: str = ";") -> DataFrame:
    """``item=count`` of the ``k`` largest items of each group, largest first, ties by item.

    The window filter becomes a per-task group limit before the shuffle, so a large group never travels whole.
    """
    order = Window.partitionBy(group).orderBy(F.desc(count), F.asc(item))
    top = rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)
    return top.groupBy(group).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("_rank", item, count))),
                lambda t: F.concat(t[item], F.lit("="), t[count].cast("string")),
            ),
            sep,
        ).alias(name)
    )


def folder_map(groups: DataFrame, limit: int = 250) -> DataFrame:
    """Largest folder groups with their three main types."""
    sizes = groups.groupBy("folder").agg(F.sum("files").alias("files")).orderBy(F.desc("files"), "folder").limit(limit)
    kept = groups.join(F.broadcast(sizes.select("folder")), "folder", "left_semi")
    return sizes.join(F.broadcast(top_joined(kept, "folder", "type", "files", 3, "top_types")), "folder")


def folder_samples(routed: DataFrame, limit: int = 250, samples: int = 5, min_big: int = MIN_BIG) -> DataFrame:
    """``(folder, sample_names)`` of the groups that ``folder_map`` lists: names spread evenly over each group's paths."""
    cells = folder_cells(routed)
    splits = splitting_folders(cells, min_big)
    groups = with_folder_group(cells, splits).groupBy("folder", "type").agg(F.sum("files").alias("files"))
    listed = F.broadcast(folder_map(groups, limit).select("folder"))
    keys = [P.folder_key(F.col("dirs"), d).alias(f"k{d}") for d in DEPTHS]
    rows = with_folder_group(routed.select("path", "base", *keys), splits).join(listed, "folder", "left_semi").select("folder", "path", "base")
    return _sample_names(spread_sample(rows, "folder", "path", samples))


def _sample_names(picked: DataFrame) -> DataFrame:
    return picked.groupBy("folder").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "base"))), lambda s: s["base"]), ";").alias("sample_names")
    )


def type_table(groups: DataFrame, limit: int = 40) -> DataFrame:
    """Largest types with the two folder groups that hold most of each."""
    sizes = groups.groupBy("type").agg(F.sum("files").alias("files")).orderBy(F.desc("files"), "type").limit(limit)
    kept = groups.join(F.broadcast(sizes.select("type")), "type", "left_semi")
    return sizes.join(F.broadcast(top_joined(kept, "type", "folder", "files", 2, "main_folders")), "type")


def overview(split: DataFrame, groups: DataFrame, max_folders: int = 250) -> DataFrame:
    """One row: how large the job is and what the fixed rules already place."""
    rules = split.agg(
        F.count(F.lit(1)).alias("files_total"),
        F.count_if(F.col("placement") == "unit").alias("unit_files"),
        F.count_if(F.col("placement") == "junk").alias("junk_files"),
        F.count_if(F.col("placement") == "routed").alias("needing"),
        F.count_distinct("unit").alias("units"),
    )
    sizes = groups.groupBy("folder").agg(F.sum("files").alias("files"))
    folders = sizes.agg(F.count(F.lit(1)).alias("n")).scalar()
    listed = (
        sizes.orderBy(F.desc("files"), "folder").limit(max_folders).agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n")).scalar()
    )
    return rules.select(
        "files_total", "units", "unit_files", "junk_files", "needing", folders.alias("folders"),
        F.floor(F.col("needing") / V.GUARD_DIVISOR).alias("unsorted_allowed"),
        F.least(folders, F.lit(max_folders)).alias("folders_listed"),
        (F.col("needing") - listed).alias("files_not_listed"),
        *[c.alias(n) for n, c in zip(("target_min", "target_max"), target_range(F.col("files_total")))],
    )


def target_range(files: Column) -> tuple[Column, Column]:
    """Reference number of buckets: ceil(sqrt(n)) up to half as many again."""
    low = F.ceil(F.sqrt(F.greatest(files, F.lit(1))))
    return low, F.greatest(low, F.floor(low * 1.5))


def spread_sample(rows: DataFrame, group: str, order: str, k: int, ranges: int | None = None) -> DataFrame:
    """``k`` rows of each group at even distances in the sort order; smaller groups whole.  ``slot`` is the sample number."""
    placed = ordinal(rows, [group], [order], name="_at", total="_of", ranges=ranges)
    slot = F.floor((F.col("_at") * k + F.col("_of") - 1) / F.col("_of"))  # the only i with floor(i * n / k) = position, if any
    return (
        placed.withColumn("slot", F.when(F.col("_of") <= k, F.col("_at")).otherwise(slot))
        .filter((F.col("_of") <= k) | ((F.floor(F.col("slot") * F.col("_of") / k) == F.col("_at")) & (F.col("slot") < k)))
        .drop("_at", "_of")
    )


def closest_summary(samples: DataFrame, group: str, top: int = 2) -> DataFrame:
    """Per group, the categories its samples came closest to: count and mean score, at most ``top``."""
    near = (
        samples.filter(F.size("candidates") > 0)
        .select(group, F.col("candidates")[0]["category"].alias("category"), F.col("candidates")[0]["score"].alias("score"))
        .groupBy(group, "category")
        .agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("score"), 3).alias("avg_score"))
    )
    order = Window.partitionBy(group).orderBy(F.desc("samples"), "category")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def leftover_groups(leftovers: DataFrame, max_groups: int = 150, samples: int = 5, ranges: int | None = None) -> DataFrame:
    """Unsorted files by two-level folder: size, three main types, spread samples, closest categories.

    ``leftovers`` has parts; ``candidates`` is optional.  ``closest`` has the mean score of each close category.  Only the rows of the listed groups are sampled.
    """
    keyed = leftovers.withColumn("folder", P.folder_key(F.col("dirs"))).withColumn("type", type_label())
    groups = keyed.groupBy("folder", "type").agg(F.count(F.lit(1)).alias("files"))
    sizes = groups.groupBy("folder").agg(F.sum("files").alias("files")).orderBy(F.desc("files"), "folder").limit(max_groups)
    listed = F.broadcast(sizes.select("folder"))
    types = top_joined(groups.join(listed, "folder", "left_semi"), "folder", "type", "files", 3, "top_types")
    columns = ["folder", "path", "base"] + (["candidates"] if "candidates" in leftovers.columns else [])
    picked = spread_sample(keyed.join(listed, "folder", "left_semi").select(*columns), "folder", "path", samples, ranges)
    names = _sample_names(picked)
    out = sizes.join(F.broadcast(types), "folder").join(F.broadcast(names), "folder")
    if "candidates" in leftovers.columns:
        ranked = F.array_sort(F.collect_list(F.struct("rank", "category", "samples", "avg_score")))
        closest = closest_summary(picked, "folder").groupBy("folder").agg(
            F.transform(ranked, lambda c: F.struct(c["category"].alias("category"), c["samples"].alias("samples"), c["avg_score"].alias("avg_score")))
            .alias("closest")
        )
        shown = F.array_join(F.transform("closest", lambda c: F.concat(c["category"], F.lit("="), c["samples"].cast("string"))), ";")
        closest = closest.select("folder", shown.alias("closest_buckets"), "closest")
        out = out.join(F.broadcast(closest), "folder", "left")
    return out
