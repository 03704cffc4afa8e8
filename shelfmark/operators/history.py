"""Change events and state over any number of scans in one pass.

``snapshot_diff`` compares one scan with the state before it.  Here all scans of a root are numbered and compared at once: what a key
was seen as is reduced to one row a scan, and a window over these rows (at most one a scan, so no key is large) finds the runs of
scans in which the key was present.  A row next to its predecessor is a comparison; a gap behind a row means missing in the scan after
it and restored when it ends.  Scans in which a key stays away cost nothing.  The known hash runs along with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators import changes as C

COMPARED = ["path", "size", "modified", "metadata_signature"]


def with_scan(observations: DataFrame, edges: list[Column], at: str = "observed_at") -> DataFrame:
    """Numbers scans by the edges between them: a row belongs to as many scans as edges are not after it."""
    passed = [F.when(F.col(at) >= edge, 1).otherwise(0) for edge in edges]
    return observations.withColumn("scan", sum(passed, F.lit(0)).cast("int"))


def sightings(observations: DataFrame, scan: str = "scan") -> DataFrame:
    """One row per key and scan: the latest observation, with the last hash known in that scan."""
    return C.latest_observation(observations, ["file_key", scan])


def scan_rows(observations: DataFrame, scans: DataFrame) -> DataFrame:
    """Every sighting beside the one before it (``p_`` columns) and the number of the next.

    ``scans`` is ``(scan, scanned_at)``, numbered without gaps; observations carry ``scan``.  Scan 0 is the initial load.
    """
    order = Window.partitionBy("file_key").orderBy("scan")
    upto, first = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = sightings(observations).withColumns({
        "own_sha": F.col("sha256"), "sha256": F.last("sha256", ignorenulls=True).over(upto),
        "original_path": F.first("path").over(first), "first_seen_at": F.first("observed_at").over(first),
        "next_scan": F.lead("scan").over(order), "p_scan": F.lag("scan").over(order),
        **{f"p_{c}": F.lag(c).over(order) for c in COMPARED},
    })
    seen = seen.withColumn("p_sha256", F.lag("sha256").over(order))
    own = C.hash_status(F.col("sha256"), F.col("hash_error") if "hash_error" in observations.columns else None)
    last = scans.agg(F.max("scan").alias("last_scan"))
    return seen.withColumn("content_identity_status", own).crossJoin(F.broadcast(last))  # one row


def _flags(stage: str) -> dict[str, Column]:
    differs = {c: ~F.col(f"p_{c}").eqNullSafe(F.col(c)) for c in COMPARED}
    known = F.col("p_scan").isNotNull()
    away = known & (F.col("p_scan") < F.col("scan") - 1)
    hint = differs["path"] | differs["size"] | differs["modified"] | away
    rehashed = F.coalesce(F.col("own_sha") != F.col("p_sha256"), F.lit(False))
    first_hash = F.col("own_sha").isNotNull() & F.col("p_sha256").isNull() & F.lit(stage == "hash") & hint
    return {
        "is_new": ~known,
        "is_missing": F.lit(False),
        "path_changed": known & differs["path"],
        "content_changed": (known & (differs["size"] | rehashed | first_hash)) | (~known & F.col("own_sha").isNotNull()),
        "active_state_changed": ~known | away,
        "metadata_changed": known & (differs["modified"] | differs["metadata_signature"]),
    }


def _lost_status(stage: str) -> Column:
    unhashed = F.col("sha256").isNull() & F.lit(stage == "hash")
    return F.when(unhashed, "deleted_before_hash").otherwise(F.col("content_identity_status"))


def _left() -> Column:
    """The key is not seen in the scan after this row."""
    return (F.col("scan") < F.col("last_scan")) & (F.col("next_scan").isNull() | (F.col("next_scan") > F.col("scan") + 1))


def history_events(rows: DataFrame, scans: DataFrame, stage: str = "metadata") -> DataFrame:
    """All change events of ``scan_rows``, as ``change_events`` gives them scan by scan, with the number of their ``scan``."""
    flagged = rows.where("scan > 0").withColumns(_flags(stage)).withColumn("event_type", C.event_type()).where("event_type IS NOT NULL")
    changed = flagged.select(
        "scan", "event_type", "path_changed", "content_changed", "active_state_changed", "file_key", "original_path", F.col("p_path").alias("previous_path"),
        *C.SEEN, "sha256", F.col("p_sha256").alias("previous_sha256"), F.lit(True).alias("is_active"), "content_identity_status")
    lost = rows.where(_left()).select(
        (F.col("scan") + 1).alias("scan"), F.lit("missing_file").alias("event_type"), F.lit(False).alias("path_changed"),
        F.lit(False).alias("content_changed"), F.lit(True).alias("active_state_changed"), "file_key", "original_path",
        F.col("path").alias("previous_path"), *C.SEEN, "sha256", F.col("sha256").alias("previous_sha256"), F.lit(False).alias("is_active"),
        _lost_status(stage).alias("content_identity_status"))
    dated = changed.unionByName(lost).join(scans.select("scan", F.col("scanned_at").alias("observed_at")), "scan")
    return dated.withColumn("stage", F.lit(stage)).select("scan", *C.EVENT)


def history_state(rows: DataFrame, scans: DataFrame, stage: str = "metadata") -> DataFrame:
    """The state that all scans leave, as ``next_state`` gives it after the last one."""
    last = rows.where("next_scan IS NULL").withColumn("_gone", F.col("scan") < F.col("last_scan"))
    after = scans.select((F.col("scan") - 1).alias("scan"), F.col("scanned_at").alias("_missed_at"))
    ended = last.join(after, "scan", "left")
    return ended.select(
        "file_key", *C.SEEN, "original_path", "first_seen_at",
        F.when(F.col("_gone"), F.col("_missed_at")).otherwise(F.col("observed_at")).alias("last_seen_at"), (~F.col("_gone")).alias("is_active"), "sha256",
        F.when(F.col("_gone"), _lost_status(stage)).otherwise(F.col("content_identity_status")).alias("content_identity_status"))
