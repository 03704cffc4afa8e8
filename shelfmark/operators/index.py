"""The category index as a small dimension table: ``(category, cat_ord, code, profile)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions import vocab as V

PROFILE = "struct<description:string,aliases:array<string>,positive_examples:array<string>>"
INDEX = f"category string, cat_ord int, code string, profile {PROFILE}"


def index_frame(spark: SparkSession, categories: dict[str, str], profiles: dict[str, dict] | None = None) -> DataFrame:
    """An index from Python values.  The fallback bucket gets its default profile unless it has one."""
    profiles = {V.UNSORTED: V.UNSORTED_PROFILE, **(profiles or {})}
    rows = []
    for ord_, (category, code) in enumerate(categories.items()):
        p = profiles.get(category)
        rows.append((category, ord_, code, p and (p.get("description"), p.get("aliases", []), p.get("positive_examples", []))))
    return spark.createDataFrame(rows, INDEX)


def profiled(index: DataFrame) -> DataFrame:
    """Adds the default profile of the fallback bucket where the index has none."""
    d = V.UNSORTED_PROFILE
    default = F.struct(
        F.lit(d["description"]).alias("description"),
        F.array(*[F.lit(a) for a in d["aliases"]]).alias("aliases"),
        F.array(*[F.lit(a) for a in d["positive_examples"]]).alias("positive_examples"),
    ).cast(PROFILE)
    missing = F.col("profile").isNull() & (F.col("category") == V.UNSORTED)
    return index.withColumn("profile", F.when(missing, default).otherwise(F.col("profile")))


def with_codes(rows: DataFrame, index: DataFrame, topic: str = "topic") -> DataFrame:
    """Adds ``code`` and ``destination``; a topic the index does not hold becomes Unsorted."""
    fallback = index.filter(F.col("category") == V.UNSORTED).agg(F.coalesce(F.max("code"), F.lit(V.UNSORTED_CODE)).alias("c")).scalar()
    codes = index.select(F.col("category").alias(topic), "code")
    known = F.col("code").isNotNull()
    return (
        rows.join(codes, topic, "left")
        .withColumn(topic, F.when(known, F.col(topic)).otherwise(V.UNSORTED))
        .withColumn("code", F.when(known, F.col("code")).otherwise(fallback))
        .withColumn("destination", F.concat_ws("_", "code", P.sanitise_topic(F.col(topic))))
    )


def merge_indexes(base: DataFrame, source: DataFrame) -> DataFrame:
    """Source codes and profiles win, other entries stay; base order first, then new categories."""
    b, s = base.alias("b"), source.alias("s")
    shift = base.agg(F.coalesce(F.max("cat_ord") + 1, F.lit(0)).alias("n")).scalar()
    return b.join(s, F.col("b.category") == F.col("s.category"), "full_outer").select(
        F.coalesce("b.category", "s.category").alias("category"),
        F.coalesce(F.col("b.cat_ord"), F.col("s.cat_ord") + shift).alias("cat_ord"),
        F.coalesce("s.code", "b.code").alias("code"),
        F.coalesce("s.profile", "b.profile").alias("profile"),
    )


def merge_incubation(base: DataFrame, source: DataFrame) -> DataFrame:
    """``(topic, paths)`` lists united per topic, first occurrence kept."""
    joined = base.alias("b").join(source.alias("s"), F.col("b.topic") == F.col("s.topic"), "full_outer")
    none: Column = F.array().cast("array<string>")
    return joined.select(
        F.coalesce("b.topic", "s.topic").alias("topic"),
        F.array_union(F.coalesce("b.paths", none), F.coalesce("s.paths", none)).alias("paths"),
    )
