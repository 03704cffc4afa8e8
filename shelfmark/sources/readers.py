"""Readers for inventories, indexes, noise lists, labelled cases and truth tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import NoiseTerms
from shelfmark.operators.index import PROFILE, profiled

INVENTORY = "path string, name string, type string"
CASES = ("current_name string, parent_path string, extension string, text_excerpt string, expected_category string, "
         "expected_coarse_group string")
TRUTH = "path string, bucket string, tag string"


def read_inventory_csv(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Large files are split into tasks by lines.  Where names hold line breaks a record is not a line: ``line_breaks=True`` reads
    them, one task a file."""
    return spark.read.schema(INVENTORY).csv(path, header=True, multiLine=line_breaks, quote='"', escape='"')


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``(category, cat_ord, code, profile)``.  Profiles that are not objects, or of unknown categories, are ignored."""
    raw = spark.read.schema("categories map<string,string>, profiles map<string,string>").json(path, multiLine=True)
    entries = raw.select(F.posexplode("categories").alias("cat_ord", "category", "code"), "profiles")
    text = F.try_element_at("profiles", F.col("category"))
    profile = F.when(F.ltrim(text).startswith("{"), F.from_json(text, PROFILE))
    return profiled(entries.select("category", "cat_ord", "code", profile.alias("profile")))


def read_incubation(spark: SparkSession, path: str) -> DataFrame:
    """``(topic, paths)``: the files an index keeps aside for topics that have no category yet."""
    raw = spark.read.schema("incubation map<string,array<string>>").json(path, multiLine=True)
    return raw.select(F.explode("incubation").alias("topic", "paths"))


def read_noise(spark: SparkSession, path: str) -> NoiseTerms:
    """Noise configuration: four short lists, so they become literals of the plan.  Several files add up, in the order of their names."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").orderBy("file").collect()
    names = {"stopword": "global_stopwords", "path_scaffolding": "path_scaffolding_terms", "packaging": "packaging_terms",
             "format": "format_terms"}
    terms = NoiseTerms()
    for row in files:
        user = json.loads(row.value)
        terms = terms.merged(**{k: user[v] for k, v in names.items() if isinstance(user.get(v), list)})
    return terms


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases as JSON lines, with the text a classifier reads."""
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("current_name", "parent_path", "extension", "text_excerpt")]
    return spark.read.schema(CASES).json(path).withColumn("text", F.trim(F.concat_ws(" ", *parts)))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRUTH).csv(path, header=True, multiLine=True, quote='"', escape='"').withColumnRenamed("bucket", "expected")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return raw.select(F.explode("m").alias("bucket", "alias")).filter(~F.col("bucket").startswith("_"))


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def distinct_paths(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates(["path"])


