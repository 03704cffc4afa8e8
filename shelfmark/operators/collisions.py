"""Collision-free names for a whole plan at once.

The rule: a wanted name that is taken, on disk or earlier in the same run, gets ``_1``, ``_2``... before its extension, the
first free number.  A table has no order, so the run is defined as: first claimants of distinct names (smallest path) keep
them, then the remaining requests follow in path order.  In that order the outcome has a closed form.  Names outside the run
and first claims are all known up front, so the n-th remaining request of a name gets its n-th free number, and the position of
that request in the merged order of requests and blocked numbers *is* the number.  No family of names has to meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths as P
from shelfmark.functions import vocab as V
from shelfmark.operators.ranking import ordinal
from shelfmark.session import materialise

KEYS = ["folder", "_stem", "_ext"]


def _split(name) -> list:
    low = F.lower(name)
    return [F.coalesce(P.stem_of(low), F.lit("")).alias("_stem"), F.coalesce(P.extension(low), F.lit("")).alias("_ext")]


def collision_plan(requests: DataFrame, existing: DataFrame, ranges: int | None = None) -> DataFrame:
    """Adds ``final_name`` to requests ``(path, folder, base, ext)``; ``existing`` is ``(folder, name)``.

    Paths are unique.  Comparison ignores case.  Long names are cut before anything is compared.
    """
    cut = F.when(F.length("base") > V.MAX_NAME, F.trim(F.substring("base", 1, V.MAX_NAME))).otherwise(F.col("base"))
    wanted = requests.withColumn("_name", F.concat(cut, F.col("ext")))
    # Read several times below, so the requests with their keys are written once.
    wanted = materialise(wanted.select("*", *_split(F.col("_name"))), "wanted-names")
    disk = existing.select("folder", *_split(F.col("name"))).distinct().withColumn("_disk", F.lit(True))
    names = wanted.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.min("path").alias("_first"))
    contended = (
        names.join(disk, KEYS, "left")
        .withColumn("_disk", F.coalesce("_disk", F.lit(False)))
        .filter((F.col("_n") > 1) | F.col("_disk"))
        .select(*KEYS, F.when(~F.col("_disk"), F.col("_first")).alias("_keeper"))
    )
    # Rows of uncontended names are done; only the others are numbered, and the rows themselves go along with the numbering.
    known = wanted.join(contended.withColumn("_contended", F.lit(True)), KEYS, "left")
    extra = F.coalesce("_contended", F.lit(False)) & ~F.col("path").eqNullSafe(F.col("_keeper"))
    known = known.withColumn("_extra", extra)
    extras = known.filter("_extra").select("path", *KEYS, F.struct(*wanted.columns).alias("_row"))
    # Numbers of a contended name that are already in use: name_7 is on disk or is itself requested.
    used = names.select(*KEYS).unionByName(disk.select(*KEYS)).distinct()
    number = r"(?s)^(.*)_([1-9]\d{0,17})$"
    blocked = (
        used.select(
            "folder",
            F.regexp_extract("_stem", number, 1).alias("_stem"),
            "_ext",
            F.regexp_extract("_stem", number, 2).try_cast("long").alias("k"),
        )
        .filter("k IS NOT NULL")
        .join(contended.select(*KEYS), KEYS, "left_semi")
    )
    queue = ordinal(extras, KEYS, ["path"], name="pos", ranges=ranges).select(*KEYS, "pos", F.lit(1).alias("kind"), "path", "_row")
    gaps = ordinal(blocked, KEYS, ["k"], name="_i", ranges=ranges).select(
        *KEYS, (F.col("k") - F.col("_i") - 1).alias("pos"), F.lit(0).alias("kind"), F.col("k").cast("string").alias("path"),
        F.lit(None).cast(extras.schema["_row"].dataType).alias("_row"),
    )
    merged = ordinal(queue.unionByName(gaps), KEYS, ["pos", "kind", "path"], name="_at", ranges=ranges)
    shown = F.col("_name")
    numbered = F.concat(P.stem_of(shown), F.lit("_"), F.col("_number").cast("string"), P.extension(shown))
    moved = merged.filter("kind = 1").select("_row.*", (F.col("_at") + 1).alias("_number"))
    kept = known.filter("NOT _extra").select(*requests.columns, shown.alias("final_name"))
    return kept.unionByName(moved.select(*requests.columns, numbered.alias("final_name")))
