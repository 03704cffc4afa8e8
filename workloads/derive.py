"""Inputs derived from the given tables, written once in SQL that both Spark and DuckDB read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths as P

# documents -> a file listing: source / language / a themed folder / a name with an extension.
DOC_FOLDER = """CASE
 WHEN doc_id % 19 = 0 THEN concat('proj', CAST(doc_id % 3 AS STRING), '/.git/objects')
 WHEN doc_id % 19 = 1 THEN concat('app', CAST(doc_id % 2 AS STRING), '/venv/lib/site-packages/pkg')
 WHEN doc_id % 19 = 2 THEN 'web/node_modules/left-pad'
 WHEN doc_id % 19 = 3 THEN concat('proj', CAST(doc_id % 3 AS STRING), '/src')
 WHEN doc_id % 19 = 4 THEN '10.01_Tax'
 WHEN doc_id % 19 = 5 THEN 'Python312/Lib/site-packages'
 WHEN doc_id % 17 < 4 THEN 'Old Stuff'
 WHEN doc_id % 17 < 7 THEN concat('Study/Lecture Notes/Unit ', CAST(doc_id % 5 AS STRING))
 WHEN doc_id % 17 < 9 THEN concat('Music/Album_', CAST(doc_id % 7 AS STRING))
 WHEN doc_id % 17 < 11 THEN 'Users/Admin/Downloads/bin/lib/cache/resources'
 ELSE 'Tax-Returns/2021' END"""
DOC_NAME = """CASE
 WHEN doc_id % 13 = 0 THEN concat('IMG_', CAST(doc_id AS STRING))
 WHEN doc_id % 13 = 1 THEN concat('scan', CAST(doc_id AS STRING))
 WHEN doc_id % 13 = 2 THEN concat('Invoice ', CAST(doc_id AS STRING), ' final')
 WHEN doc_id % 13 = 3 THEN concat('Bank Statement_', CAST(doc_id % 28 + 1 AS STRING), '-01-2023')
 WHEN doc_id % 13 = 4 THEN concat('~$report ', CAST(doc_id AS STRING))
 WHEN doc_id % 13 = 5 THEN concat('Module ', CAST(doc_id % 9 AS STRING), ' soil mechanics notes')
 WHEN doc_id % 13 = 6 THEN concat('0', CAST(doc_id AS STRING))
 WHEN doc_id % 13 = 7 THEN concat('Annual Report rev ', CAST(doc_id % 6 AS STRING), ' (', CAST(doc_id % 4 AS STRING), ')')
 WHEN doc_id % 13 = 8 THEN concat('electricity bill copy ', CAST(doc_id AS STRING))
 WHEN doc_id % 13 = 9 THEN 'new document'
 WHEN doc_id % 13 = 10 THEN concat('GATE admit card__', CAST(2015 + doc_id % 9 AS STRING))
 WHEN doc_id % 13 = 11 THEN concat(lang, '_', source, '_', CAST(doc_id AS STRING))
 ELSE concat('Ver', CAST(doc_id % 12 AS STRING), '.', source, ' draft') END"""
DOC_EXT = """CASE doc_id % 12 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.mp3' WHEN 3 THEN '.MP4' WHEN 4 THEN '.jpg'
 WHEN 5 THEN '.txt' WHEN 6 THEN '.tmp' WHEN 7 THEN '.bak' WHEN 8 THEN '.py' WHEN 9 THEN '' WHEN 10 THEN '.csv' ELSE '.pdf' END"""
DOC_PATH = f"coalesce(concat(source, '/', lang, '/', {DOC_FOLDER}, '/', CAST(doc_id AS STRING), '_', {DOC_NAME}, {DOC_EXT}), '')"
# The same listing with names that repeat, for anything about equal names.
DOC_PLAIN_NAME = f"coalesce(concat({DOC_NAME}, {DOC_EXT}), '')"

# part -> file names of many kinds, for the rules about names.
_k = "CAST(p_partkey AS STRING)"
PART_NAME = f"""CASE p_partkey % 24
 WHEN 0 THEN concat('adhar card scan (', CAST(p_partkey % 5 AS STRING), ').pdf')
 WHEN 1 THEN concat('SBI bank statement ', CAST(p_partkey % 28 + 10 AS STRING), '-03-2021 scan.pdf')
 WHEN 2 THEN concat('lecture ', CAST(p_partkey % 9 AS STRING), ' flight dynamics notes.pdf')
 WHEN 3 THEN concat('revit floor plan level ', CAST(p_partkey % 4 AS STRING), '.dwg')
 WHEN 4 THEN concat('site photo ', {_k}, '.jpg')
 WHEN 5 THEN concat(replace(p_type, ' ', '_'), '.cfg')
 WHEN 6 THEN concat('Report on ', p_name, ' of ', p_brand, '.docx')
 WHEN 7 THEN concat('electricity bill UPCL', {_k}, '00 march 2022 draft.pdf')
 WHEN 8 THEN concat('song of ', p_name, ' part ', CAST(p_partkey % 3 AS STRING), '.mp3')
 WHEN 9 THEN concat('Annual_Report_', CAST(1990 + p_partkey % 30 AS STRING), '.pdf')
 WHEN 10 THEN concat('module ', CAST(p_partkey % 9 AS STRING), ' steel design book copy.pdf')
 WHEN 11 THEN concat('GATE admit card ', {_k}, '1234 rev ', CAST(p_partkey % 7 AS STRING), '.pdf')
 WHEN 12 THEN concat('new document ', {_k}, '.docx')
 WHEN 13 THEN concat(p_name, '__final.xlsx')
 WHEN 14 THEN concat('www.', p_brand, ' flv2mp3 ', p_name, '.mp4')
 WHEN 15 THEN concat('question paper Q', CAST(p_partkey % 4 AS STRING), ' ', p_brand, ' 2021-22.pdf')
 WHEN 16 THEN concat('plot design model ', p_brand, ' v', CAST(p_partkey % 12 AS STRING), '.rvt')
 WHEN 17 THEN concat(p_type, ' (', CAST(p_partkey % 6 AS STRING), ').txt')
 WHEN 18 THEN concat('Notes ', p_brand, '.pdf')
 WHEN 19 THEN concat('abc ', CAST(p_partkey % 99 AS STRING), ' ', p_type, ' analysis.csv')
 WHEN 20 THEN concat('migration certificate%20', p_brand, '%20', CAST(p_partkey % 12 + 1 AS STRING), '.pdf')
 WHEN 21 THEN concat('guide to ', p_name, ' with landmarks & maps.pdf')
 WHEN 22 THEN '.pdf'
 ELSE concat('itr form ', p_brand, ' ', {_k}, 'ABC9 copy (', CAST(p_partkey % 3 AS STRING), ').pdf') END"""

# documents -> a classifier's verdict, fixed by rule so that both engines agree: language as category, every third row sure.
SURE = "doc_id % 3 = 0"

# pages -> host and URL path components, query and fragment cut.
PAGE_PATH = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"

# events -> observations of files: one key per user, tens of k and event type; two scans (first and second half of the month).
EVENT_KEY = "concat(CAST(user_id AS STRING), '|', substring(lpad(regexp_extract(props, '([0-9]+)', 1), 3, '0'), 1, 2), '|', event_type)"
EVENT_DIR = "CAST(floor(value) AS BIGINT) % 3"
EVENT_PATH = f"concat('d', CAST({EVENT_DIR} AS STRING), '/', event_type, '.dat')"
EVENT_SIZE = "CAST(floor(value / 50.0) AS BIGINT)"
MIDDLE = "2024-01-16"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """The file listing of ``documents``; the text column is read only when asked for."""
    return table(spark, sf, "documents").selectExpr(f"{DOC_PATH} AS path", "doc_id", "lang", "source", *more)


def plain_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id", "lang", "source", f"{DOC_PLAIN_NAME} AS name")


def part_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr("p_partkey AS doc_id", "p_brand AS lang", "p_type AS source", f"{PART_NAME} AS name")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").selectExpr(f"{PAGE_PATH} AS path", "page_id")


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """Both file listings together, with parts."""
    return P.with_parts(documents(spark, sf).select("path").unionByName(pages(spark, sf).select("path")))


def observations(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").selectExpr(
        f"{EVENT_KEY} AS file_key", f"{EVENT_PATH} AS path", f"{EVENT_SIZE} AS size", "event_type",
        "CAST(ts AS timestamp) AS observed_at", f"{EVENT_KEY} AS file_id",
    )
    hashed = F.col("event_type").isin("view", "purchase")
    return rows.select(
        "file_key", F.lit("v1").alias("volume"), "file_id", F.lit("test").alias("identity_source"), "path",
        F.concat("event_type", F.lit(".dat")).alias("file_name"), F.lit(".dat").alias("extension"), "size",
        F.col("observed_at").alias("created"), F.date_trunc("day", "observed_at").alias("modified"), "observed_at",
        F.lit("drive").alias("scan_root"), F.sha1(F.concat_ws("|", "path", F.col("size").cast("string"))).alias("metadata_signature"),
        F.when(hashed, F.sha2(F.col("size").cast("string"), 256)).alias("sha256"), F.lit(None).cast("string").alias("hash_error"),
    )


# ---- the same inputs as DuckDB common table expressions -------------------------------------------------------------
def with_parts_sql(source: str, columns: str = "path") -> str:
    """CTE bodies ``inv`` (source), ``cut`` and ``parts``: dirs list, dir, base, stem, ext."""
    return f"""inv AS ({source}),
cut AS (SELECT *, list_filter(regexp_split_to_array(path, '[\\\\/]+'), lambda x: x <> '') AS p FROM inv),
cut2 AS (SELECT *, list_slice(p, 1, len(p) - 1) AS dirs, p[len(p)] AS base FROM cut),
cut3 AS (SELECT *, regexp_extract(base, '^\\.*[^.].*(\\.[^.]*)$', 1) AS ext0 FROM cut2),
parts AS (SELECT *, coalesce(array_to_string(dirs, '/'), '') AS dir, substring(base, 1, length(base) - length(ext0)) AS stem,
  lower(ext0) AS ext FROM cut3)"""


DOCS = f"SELECT {DOC_PATH} AS path, doc_id, lang, source FROM documents"
PAGES = f"SELECT {PAGE_PATH} AS path, page_id FROM pages"
LISTING = f"SELECT path FROM ({DOCS}) UNION ALL SELECT path FROM ({PAGES})"
PLAIN = f"SELECT doc_id, lang, source, {DOC_PLAIN_NAME} AS name FROM documents"
OBS = f"""SELECT {EVENT_KEY} AS file_key, {EVENT_PATH} AS path, {EVENT_SIZE} AS size, ts AS observed_at,
 date_trunc('day', ts) AS modified, event_type,
 CASE WHEN event_type IN ('view', 'purchase') THEN sha256(CAST({EVENT_SIZE} AS STRING)) END AS sha256 FROM events"""


def sql_list(words) -> str:
    return "(" + ", ".join("'" + str(w).replace("'", "''") + "'" for w in words) + ")"


def sql_array(words) -> str:
    return "[" + sql_list(words)[1:-1] + "]"
