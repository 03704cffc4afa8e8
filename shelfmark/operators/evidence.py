"""Weighted term and phrase evidence (a TF-IDF variant over paths, discounted for noise words and bundled software).

The row of a file is reduced to its distinct terms with per-source counts before anything is shuffled.  One aggregate by
(cluster, term) then carries everything that follows: term totals, file and cluster presence and the bundle test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions import text as T
from shelfmark.functions import vocab as V
from shelfmark.functions.text import NoiseTerms

SOURCES = list(V.SOURCE_WEIGHTS)
PHRASE_SOURCES = list(V.PHRASE_WEIGHTS)


def file_evidence(inventory: DataFrame, noise: NoiseTerms | None = None) -> DataFrame:
    """Token lists of each file by source, its candidate tokens and its cluster.  Needs the parts of a path."""
    noise = noise or NoiseTerms()
    higher = F.slice(F.col("dirs"), F.lit(1), F.greatest(F.size("dirs") - 1, F.lit(0)))
    packaged = noise.packaging + noise.format
    return (
        inventory.withColumn("filename_tokens", T.tokenise(F.col("stem")))
        .withColumn("parent_tokens", T.tokenise(F.try_element_at("dirs", F.lit(-1))))
        .withColumn("higher_path_tokens", T.tokenise(F.array_join(higher, "/")))
        .withColumn("_words", F.concat("filename_tokens", "parent_tokens", "higher_path_tokens"))
        .withColumn(
            "format_package_tokens",
            F.array_sort(
                F.array_distinct(F.concat(T.tokenise(F.col("ext")), F.filter("_words", lambda t: t.isin(packaged))))
            ),
        )
        .withColumn("candidate_tokens", F.array_sort(F.array_distinct(F.concat("_words", "format_package_tokens"))))
        .withColumn("cluster_root", T.cluster_root(F.col("dirs"), noise))
        .drop("_words")
    )


def raw_term_counts(evidence: DataFrame) -> DataFrame:
    return evidence.select(F.explode("candidate_tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("files"))


def _exploded(evidence: DataFrame, per_source: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per file and distinct term, with the number of occurrences in each source."""
    named = evidence.select("cluster_root", *keep, *[c.alias(f"_{s}") for s, c in per_source.items()])
    distinct = F.array_distinct(F.concat(*[F.col(f"_{s}") for s in per_source]))
    counted = F.transform(
        distinct, lambda t: F.struct(t.alias("term"), *[T.occurrences(F.col(f"_{s}"), t).alias(s) for s in per_source])
    )
    return named.select("cluster_root", *keep, F.inline(counted))


def exploded_tokens(evidence: DataFrame, keep: list[str] = ()) -> DataFrame:
    return _exploded(evidence, {s: F.col(f"{s}_tokens") for s in SOURCES}, list(keep))


def exploded_phrases(evidence: DataFrame, keep: list[str] = ()) -> DataFrame:
    around = evidence.withColumn("_around", F.concat("parent_tokens", "higher_path_tokens"))
    per_source = {"phrase_filename": T.phrases(F.col("filename_tokens")), "phrase_path": T.phrases(F.col("_around"))}
    return _exploded(around, per_source, list(keep))


def cluster_terms(exploded: DataFrame, sources: list[str]) -> DataFrame:
    """Totals per (cluster, term): files, occurrences by source, and source mentions (distinct file, source pairs)."""
    return exploded.groupBy("cluster_root", "term").agg(
        F.count(F.lit(1)).alias("files"),
        *[F.sum(s).alias(s) for s in sources],
        F.sum(sum(((F.col(s) > 0).cast("long") for s in sources), F.lit(0))).alias("refs"),
    )


def bundle_clusters(token_terms: DataFrame) -> DataFrame:
    """Per cluster: references, packaging references, ratio, and whether it looks like bundled software."""
    marked = F.when(F.col("term").isin(V.BUNDLE_MARKERS), F.col("refs")).otherwise(0)
    return (
        token_terms.groupBy("cluster_root")
        .agg(F.sum("refs").alias("refs"), F.sum(marked).alias("packaging_refs"))
        .withColumn("packaging_ratio", F.col("packaging_refs") / F.col("refs"))
        .withColumn("is_bundle", (F.col("refs") >= V.BUNDLE_MIN_REFS) & (F.col("packaging_ratio") >= V.BUNDLE_MIN_RATIO))
    )


def _weighted(terms: DataFrame, evidence: DataFrame, bundles: DataFrame, weights: dict[str, float], kind: str,
              noise: NoiseTerms) -> DataFrame:
    sources = list(weights)
    sizes = evidence.groupBy("cluster_root").agg(F.count(F.lit(1)).alias("n")).agg(
        F.struct(F.coalesce(F.sum("n"), F.lit(1)).alias("files"), F.greatest(F.count(F.lit(1)), F.lit(1)).alias("clusters"))
    ).scalar()
    files, clusters = F.col("_sizes.files"), F.col("_sizes.clusters")
    flagged = bundles.filter("is_bundle").select("cluster_root", F.lit(1).alias("bundle"))
    stats = (
        terms.join(flagged, "cluster_root", "left")
        .groupBy("term")
        .agg(
            F.sum("files").alias("file_presence"),
            F.count(F.lit(1)).alias("cluster_presence"),
            F.sum(F.coalesce("bundle", F.lit(0))).alias("_bundles"),
            *[F.sum(s).alias(s) for s in sources],
        )
    )
    mentions = sum((F.col(s) for s in sources), F.lit(0))
    share = F.col("_bundles") / F.col("cluster_presence")
    penalty = F.when(F.col("_bundles") > 0, F.lit(V.BUNDLE_PENALTY)).otherwise(F.lit(1.0))
    if kind == "single":
        high, named = F.col("higher_path") / F.col("_mentions"), F.col("filename") / F.col("_mentions")
        penalty = penalty * (
            F.when((share >= 0.6) & (high >= 0.6) & (named < 0.2), 0.28).when((share >= 0.6) & (high >= 0.4), 0.45).otherwise(1.0)
        )
        factor, labels = T.noise_factor(F.col("term"), noise), T.noise_labels(F.col("term"), noise)
    else:
        factor, labels = F.lit(1.0), F.array().cast("array<string>")
    mix = F.map_filter(
        F.create_map(*[x for s in sorted(sources) for x in (F.lit(s), F.col(s))]), lambda _, n: n > 0
    )
    return (
        stats.withColumn("_sizes", sizes)
        .withColumn("_mentions", mentions)
        .withColumn("_raw", sum((F.col(s) * w for s, w in weights.items()), F.lit(0.0)))
        .withColumn("_conc", 1 - F.col("cluster_presence") / (clusters + 1))
        .withColumn("_idf", F.log((files + 1) / (F.col("file_presence") + 1)) + 1)
        .withColumn("_penalty", penalty)
        .select(
            "term",
            F.lit(kind).alias("token_type"),
            F.round("_raw", 4).alias("raw_count"),
            "file_presence",
            "cluster_presence",
            F.round("_conc", 4).alias("concentration_score"),
            mix.alias("source_mix"),
            labels.alias("noise_labels"),
            F.round("_penalty", 4).alias("bundle_penalty"),
            F.round(F.col("_raw") * F.col("_idf") * (F.col("_conc") + 0.6) * factor * F.col("_penalty"), 4).alias("adjusted_weight"),
        )
    )


def theme_evidence(evidence: DataFrame, noise: NoiseTerms | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(single terms, phrases, clusters)`` without samples; see ``with_samples``."""
    noise = noise or NoiseTerms()
    terms = cluster_terms(exploded_tokens(evidence), SOURCES)
    bundles = bundle_clusters(terms)
    singles = _weighted(terms, evidence, bundles, V.SOURCE_WEIGHTS, "single", noise)
    grams = cluster_terms(exploded_phrases(evidence), PHRASE_SOURCES)
    return singles, _weighted(grams, evidence, bundles, V.PHRASE_WEIGHTS, "phrase", noise), bundles


def with_samples(terms: DataFrame, exploded: DataFrame, k: int = 3) -> DataFrame:
    """Adds the first ``k`` files (by path) of each term.  ``exploded`` keeps ``path`` and ``base``.

    The filter on the row number turns into a per-task limit ahead of the shuffle, so a term found in every file ships at most
    ``k`` rows per task.
    """
    order = Window.partitionBy("term").orderBy("path")
    first = (
        exploded.select("term", "path", "base")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= k)
        .groupBy("term")
        .agg(F.array_sort(F.collect_list(F.struct("path", "base"))).alias("_first"))
    )
    return (
        terms.join(first, "term", "left")
        .withColumn("sample_paths", F.col("_first.path"))
        .withColumn("sample_files", F.col("_first.base"))
        .drop("_first")
    )


def top_terms(terms: DataFrame, k: int = 120) -> DataFrame:
    return terms.orderBy(F.desc("adjusted_weight"), "term").limit(k)
