"""Listing jobs: folders, file attributes, file text.

Folders are listed level by level.  Each level is spread over the cluster again and written to the shared folder before the
next one starts, so one very deep or very wide subtree does not stay on the task that found it, and a lost executor repeats at
most one level.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.operators.changes import file_key, metadata_signature
from shelfmark.session import checkpoint_root

BATCH = 10_000
ENTRY = "path string, is_dir boolean"


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list = []
    for batch in batches:
        for folder in batch["path"]:
            try:
                with os.scandir(folder) as entries:
                    for entry in entries:
                        rows.append((entry.path, entry.is_dir(follow_symlinks=False)))
                        if len(rows) >= BATCH:
                            yield pd.DataFrame(rows, columns=["path", "is_dir"])
                            rows = []
            except OSError:  # unreadable folders are skipped
                continue
    yield pd.DataFrame(rows, columns=["path", "is_dir"])


def walk(spark: SparkSession, roots: list[str], staging: str | None = None, recursive: bool = True) -> DataFrame:
    """Absolute ``path`` of every file below ``roots``."""
    staging = staging or os.path.join(checkpoint_root(spark), f"walk-{uuid.uuid4().hex}")
    level, frontier = 0, spark.createDataFrame([(r,) for r in roots], "path string")
    while True:
        target = f"{staging}/level={level}"
        width = spark.sparkContext.defaultParallelism
        frontier.repartition(width * 4 if level else width).mapInPandas(_list, ENTRY).write.mode("overwrite").parquet(target)
        found = spark.read.parquet(target).filter("is_dir")
        if not recursive or found.isEmpty():
            break
        level, frontier = level + 1, found.select("path")
    return spark.read.option("basePath", staging).parquet(staging).filter("NOT is_dir").select("path")


def scan_inventory(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``(path, name, type)`` of every file, hidden ones too; drive letter and leading separators are dropped."""
    files = walk(spark, roots).withColumn("path", F.regexp_replace("path", r"^(?:[A-Za-z]:)?[\\/]+", ""))
    return P.with_parts(files).select("path", F.col("stem").alias("name"), F.col("ext").alias("type"))


def scoped_inventory(spark: SparkSession, root: str, include_subfolders: bool = True) -> DataFrame:
    """Files of one folder by relative path, without hidden files, hidden folders and managed folders."""
    files = walk(spark, [root], recursive=include_subfolders)
    relative = files.withColumn("path", F.substring("path", F.lit(len(root.rstrip("/\\")) + 2), F.length("path")))
    parts = P.with_parts(relative)
    hidden = F.exists("dirs", lambda d: d.startswith(".") | P.is_managed(d)) | F.col("base").startswith(".")
    return parts.filter(~hidden).select("path", F.col("stem").alias("name"), F.col("ext").alias("type"))


OBSERVED = ("path string, size long, created timestamp, modified timestamp, volume string, file_id string, "
            "identity_source string, sha256 string, hash_error string")


def _observe(hash_content: bool):
    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        utc = lambda s: datetime.fromtimestamp(s, tz=timezone.utc).replace(tzinfo=None)
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    stat = os.stat(path)
                except OSError:
                    continue
                digest, error = _digest(path) if hash_content else (None, None)
                rows.append((path, stat.st_size, utc(stat.st_ctime), utc(stat.st_mtime), str(stat.st_dev), str(stat.st_ino),
                             "stat_inode", digest, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OBSERVED.split(", ")])

    return job


def _digest(path: str):
    try:
        with open(path, "rb") as handle:
            return hashlib.file_digest(handle, "sha256").hexdigest(), None
    except OSError as error:
        return None, str(error)


def observe(spark: SparkSession, files: DataFrame, scan_root: str, hash_content: bool = False) -> DataFrame:
    """One observation per path: attributes, identity and, on request, the content hash."""
    seen = files.select("path").mapInPandas(_observe(hash_content), OBSERVED)
    parts = P.with_parts(seen)
    return parts.select(
        file_key(F.col("volume"), F.col("file_id")).alias("file_key"), "volume", "file_id", "identity_source", "path",
        F.col("base").alias("file_name"), F.col("ext").alias("extension"), "size", "created", "modified",
        F.current_timestamp().alias("observed_at"), F.lit(scan_root).alias("scan_root"),
        metadata_signature(F.col("path"), F.col("size"), F.col("modified")).alias("metadata_signature"), "sha256", "hash_error",
    )


def extract_text(files: DataFrame, readers: dict[str, Callable[[str], str]] | None = None) -> DataFrame:
    """Adds ``text``: UTF-8 content of ``.txt`` files, the output of ``readers[ext]`` for other types, else empty."""
    readers = readers or {}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", text string"

    def read(path: str) -> str:
        ext = os.path.splitext(path)[1].lower()
        if ext in readers:
            return readers[ext](path)
        if ext != ".txt":
            return ""
        with open(path, "rb") as handle:
            return handle.read().decode("utf-8", "ignore")

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=[read(p) for p in batch["path"]])

    return files.mapInPandas(job, schema)
