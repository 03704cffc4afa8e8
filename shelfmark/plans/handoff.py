"""One-row JSON documents for whoever maintains the category index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import evidence as E
from shelfmark.operators import overview as O


def _list(frame: DataFrame, order: list[str]) -> Column:
    """A small frame as one array value, sorted by ``order``: top lists and the index."""
    def by_key(left: Column, right: Column) -> Column:
        return F.when(left["key"] < right["key"], -1).when(left["key"] > right["key"], 1).otherwise(0)

    kept = [c for c in frame.columns if c != "_order"]
    listed = F.collect_list(F.struct(F.struct(*order).alias("key"), F.struct(*kept).alias("row")))  # maps have no order of their own
    return frame.agg(F.transform(F.array_sort(listed, by_key), lambda r: r["row"]).alias("rows")).scalar()


def _ranked(frame: DataFrame, measure: str, item: str) -> Column:
    return _list(frame.withColumn("_order", -F.col(measure)), ["_order", item])


def round_one(inventory_split: DataFrame, evidence: DataFrame, note: str = "", terms: int = 120) -> DataFrame:
    """Top terms and phrases with samples, the overview, folder map with samples and type table.

    Bundled clusters have no bound, so they are a frame of their own (``bundle_roots``).
    """
    singles, phrases, _ = E.theme_evidence(evidence)
    kept = lambda top, rows: rows.join(F.broadcast(top.select("term")), "term", "left_semi")
    best, grams = E.top_terms(singles, terms), E.top_terms(phrases, terms)
    best = E.with_samples(best, kept(best, E.exploded_tokens(evidence, ["path", "base"])))
    grams = E.with_samples(grams, kept(grams, E.exploded_phrases(evidence, ["path", "base"])))
    routed = inventory_split.filter("placement = 'routed'")
    groups = O.folder_groups(routed)
    folders = O.folder_map(groups).join(O.folder_samples(routed), "folder", "left")
    return O.overview(inventory_split, groups).select(
        F.to_json(
            F.struct(
                F.struct("*").alias("drive_overview"),
                _ranked(best, "adjusted_weight", "term").alias("top_single_terms"),
                _ranked(grams, "adjusted_weight", "term").alias("top_phrases"),
                _ranked(folders, "files", "folder").alias("folder_map"),
                _ranked(O.type_table(groups), "files", "type").alias("file_type_table"),
                F.lit(note).alias("author_note"),
            )
        ).alias("handoff")
    )


def bundle_roots(evidence: DataFrame) -> DataFrame:
    """The clusters that look like unpacked software, one row each."""
    return E.theme_evidence(evidence)[2].filter("is_bundle")


def leftovers(verdict: DataFrame, index: DataFrame, groups: DataFrame) -> DataFrame:
    """The current index and the unsorted groups with the buckets they came closest to."""
    return verdict.select(
        F.to_json(
            F.struct(
                F.struct("*").alias("verdict"),
                _list(index, ["cat_ord"]).alias("current_index"),
                _ranked(groups, "files", "folder").alias("leftover_groups"),
            )
        ).alias("handoff")
    )
