"""Change tracking between inventory snapshots.

``current`` holds one row per file key; ``observed`` is one scan of one root.  A single full outer join by key yields every
flag; events, next state and counters are projections of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import materialise

# What a scan knows about a file, besides its key.
SEEN = ["volume", "file_id", "identity_source", "path", "file_name", "extension", "size", "created", "modified",
        "metadata_signature", "scan_root"]
STATE = ["file_key", *SEEN, "original_path", "first_seen_at", "last_seen_at", "is_active", "sha256", "content_identity_status"]
MASTER = [c for c in STATE if c not in ("sha256", "content_identity_status")]
EVENT = ["observed_at", "stage", "event_type", "path_changed", "content_changed", "active_state_changed", "file_key",
         "original_path", "previous_path", *SEEN, "sha256", "previous_sha256", "is_active", "content_identity_status"]
HASH_LIMIT = 8 * 1024 * 1024


def file_key(volume: Column, file_id: Column) -> Column:
    return F.sha1(F.concat_ws("|", volume, file_id))


def metadata_signature(path: Column, size: Column, modified: Column) -> Column:
    return F.sha1(F.concat_ws("|", path, size.cast("string"), modified.cast("string")))


def hash_status(sha256: Column, error: Column | None = None) -> Column:
    failed = F.lit(False) if error is None else error.isNotNull()
    return F.when(sha256.isNotNull(), "hashed").when(failed, "hash_error").otherwise("not_hashed_yet")


def latest_observation(observations: DataFrame, key: str | list[str] = "file_key", at: str = "observed_at") -> DataFrame:
    """One row per key.  An aggregate, not a window: a key with very many observations is reduced before the shuffle.

    A latest row without a hash takes the last one that an earlier row has.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in observations.columns if c not in keys]
    ranked = F.struct(F.col(at), *[F.col(c).alias(f"{c}_") if c == at else F.col(c) for c in rest])
    known = {}
    if "sha256" in rest:
        known["_sha"] = F.max_by("sha256", F.when(F.col("sha256").isNotNull(), ranked))
    # The greatest row itself, not a second copy of it by rank: the aggregate sorts its rows, so their width counts.
    last = observations.groupBy(*keys).agg(F.max(ranked).alias("_last"), *[c.alias(n) for n, c in known.items()])
    values = [F.coalesce("_last.sha256", "_sha").alias(c) if c == "sha256" else F.col(f"_last.{c}") for c in rest]
    return last.select(*keys, *values)


def initial_load(observed: DataFrame) -> DataFrame:
    """First state of an empty master: everything is loaded and no event is written."""
    return _as_state(observed)


def _as_state(observed: DataFrame) -> DataFrame:
    error = F.col("hash_error") if "hash_error" in observed.columns else None
    return (
        observed.withColumn("original_path", F.col("path"))
        .withColumn("first_seen_at", F.col("observed_at"))
        .withColumn("last_seen_at", F.col("observed_at"))
        .withColumn("is_active", F.lit(True))
        .withColumn("content_identity_status", hash_status(F.col("sha256"), error))
        .select(*STATE)
    )


def changed_hint() -> Column:
    """Cheap signs that a file's content may have changed, from the ``_p``/``_o`` columns of a diff."""
    return (
        ~F.col("p_path").eqNullSafe(F.col("o_path"))
        | ~F.col("p_size").eqNullSafe(F.col("o_size"))
        | ~F.col("p_modified").eqNullSafe(F.col("o_modified"))
        | ~F.col("p_is_active")
    )


def hash_todo(current: DataFrame, observed: DataFrame, scan_root: str, limit: int = HASH_LIMIT) -> DataFrame:
    """Observed files whose content has to be read: new, changed, or never hashed and small enough."""
    joined = _pair(current.filter(F.col("scan_root") == scan_root), observed, "left_obs")
    small = (F.col("p_content_identity_status") != "hashed") & (F.col("p_size") <= limit)
    return joined.filter(F.col("p_file_key").isNull() | changed_hint() | small).select("file_key", F.col("o_path").alias("path"))


def _pair(current: DataFrame, observed: DataFrame, how: str) -> DataFrame:
    prev = current.select(*[F.col(c).alias(f"p_{c}") for c in current.columns])
    now = observed.select(*[F.col(c).alias(f"o_{c}") for c in observed.columns])
    joined = prev.join(now, F.col("p_file_key") == F.col("o_file_key"), {"left_obs": "right"}.get(how, how))
    return joined.withColumn("file_key", F.coalesce("o_file_key", "p_file_key"))


def snapshot_diff(current: DataFrame, observed: DataFrame, scan_root: str, observed_at: Column, stage: str = "metadata") -> DataFrame:
    """Full outer join of state and scan with change flags and ``event_type`` (null where nothing happened).

    A key known under another root counts as new here, and its first path and date are kept.
    """
    joined = _pair(current, _as_state(observed), "full_outer")
    # Read from the joined row, not as a constant, so the optimizer cannot drop the outer rows.
    known = F.coalesce(F.col("p_scan_root") == scan_root, F.lit(False))
    seen = F.col("o_file_key").isNotNull()
    both = known & seen
    new = seen & ~known
    gone = known & ~seen & F.col("p_is_active")
    sized = ~F.col("p_size").eqNullSafe(F.col("o_size"))
    rehashed = F.coalesce(F.col("o_sha256") != F.col("p_sha256"), F.lit(False))
    first_hash = F.col("o_sha256").isNotNull() & F.col("p_sha256").isNull() & F.lit(stage == "hash") & changed_hint()
    flags = {
        "is_new": new,
        "is_missing": gone,
        "path_changed": both & ~F.col("p_path").eqNullSafe(F.col("o_path")),
        "content_changed": (both & (sized | rehashed | first_hash)) | (new & F.col("o_sha256").isNotNull()),
        "active_state_changed": new | gone | (both & ~F.col("p_is_active")),
        "metadata_changed": both
        & (~F.col("p_modified").eqNullSafe(F.col("o_modified"))
           | ~F.col("p_metadata_signature").eqNullSafe(F.col("o_metadata_signature"))),
    }
    return (
        joined.withColumn("seen", seen)
        .withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})
        .withColumn("event_type", event_type())
        .withColumn("observed_at", observed_at)
        .withColumn("stage", F.lit(stage))
    )


def event_type() -> Column:
    path, content, active = F.col("path_changed"), F.col("content_changed"), F.col("active_state_changed")
    return (
        F.when(F.col("is_new"), "new_file")
        .when(F.col("is_missing"), "missing_file")
        .when(active, "restored_file")
        .when(path & content, "path_and_content_changed")
        .when(path, "path_changed")
        .when(content, "content_changed")
        .when(F.col("metadata_changed"), "metadata_refreshed")
    )


def _next(name: str) -> Column:
    return F.when(F.col("seen"), F.col(f"o_{name}")).otherwise(F.col(f"p_{name}"))


def _lost_unhashed() -> Column:
    return F.col("is_missing") & F.col("p_sha256").isNull() & (F.col("stage") == "hash")


def _next_sha() -> Column:
    return F.coalesce("o_sha256", "p_sha256")


def _next_status() -> Column:
    kept = F.col("seen") & ~F.col("is_new") & F.col("o_sha256").isNull() & F.col("p_sha256").isNotNull()
    return (
        F.when(_lost_unhashed(), "deleted_before_hash")
        .when(kept, F.col("p_content_identity_status"))
        .otherwise(_next("content_identity_status"))
    )


def change_events(diff: DataFrame) -> DataFrame:
    shown_sha = F.when(F.col("is_new"), F.col("o_sha256")).otherwise(_next_sha())
    known = ~F.col("is_new")
    return diff.filter("event_type IS NOT NULL").select(
        "observed_at", "stage", "event_type", "path_changed", "content_changed", "active_state_changed", "file_key",
        F.when(known, F.col("p_original_path")).otherwise(F.col("o_path")).alias("original_path"),
        F.when(known, F.col("p_path")).alias("previous_path"),
        *[_next(c).alias(c) for c in SEEN],
        shown_sha.alias("sha256"),
        F.when(known, F.col("p_sha256")).alias("previous_sha256"),
        F.col("seen").alias("is_active"),
        F.when(F.col("is_new"), F.col("o_content_identity_status")).otherwise(_next_status()).alias("content_identity_status"),
    )


def next_state(diff: DataFrame) -> DataFrame:
    """The state after the scan.  Rows of other roots and files already missing are carried over."""
    return diff.select(
        "file_key",
        *[_next(c).alias(c) for c in SEEN],
        F.coalesce("p_original_path", "o_original_path").alias("original_path"),
        F.coalesce("p_first_seen_at", "o_first_seen_at").alias("first_seen_at"),
        F.when(F.col("seen"), F.col("o_last_seen_at")).when(F.col("is_missing"), F.col("observed_at")).otherwise(
            F.col("p_last_seen_at")).alias("last_seen_at"),
        F.when(F.col("seen"), True).when(F.col("is_missing"), False).otherwise(F.col("p_is_active")).alias("is_active"),
        _next_sha().alias("sha256"),
        _next_status().alias("content_identity_status"),
    )


def master_additions(diff: DataFrame, master: DataFrame) -> DataFrame:
    """First sighting of keys the master does not hold: insert or ignore."""
    new = diff.filter("is_new").select(*[F.col(f"o_{c}").alias(c) for c in MASTER])
    return new.join(master.select("file_key"), "file_key", "left_anti")


def first_per_key(rows: DataFrame, key: str = "file_key", at: str = "first_seen_at") -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("_f")).select(key, "_f.*")


def counters(diff: DataFrame) -> DataFrame:
    moved = lambda c: F.count_if(F.col(c) & ~F.col("is_new") & ~F.col("is_missing"))
    return diff.agg(
        F.count_if("seen").alias("files_seen"),
        F.count_if("is_new").alias("new_files"),
        moved("path_changed").alias("path_changed"),
        moved("content_changed").alias("content_changed"),
        F.count_if("is_missing").alias("missing_files"),
        moved("active_state_changed").alias("restored_files"),
    )


def verify_state(master: DataFrame, current: DataFrame, events: DataFrame, exported: DataFrame) -> DataFrame:
    """One row of counts about the health of the tables.  ``events`` and ``exported`` have an ``event_id``.

    Each side is read once: the tables are put under each other with marks and counted by key.
    """
    def side(frame: DataFrame, key: str, **marks: Column) -> DataFrame:
        names = ("in_master", "in_current", "inactive", "lost") if key == "file_key" else ("in_events", "in_exported")
        return frame.select(key, *[marks.get(n, F.lit(False)).cast("int").alias(n) for n in names])

    lost = F.coalesce(F.col("content_identity_status") == "deleted_before_hash", F.lit(False))
    files = side(master, "file_key", in_master=F.lit(True)).unionByName(
        side(current, "file_key", in_current=F.lit(True), inactive=~F.col("is_active"), lost=lost))
    files = files.groupBy("file_key").agg(*[F.sum(c).alias(c) for c in files.columns[1:]])
    log = side(events, "event_id", in_events=F.lit(True)).unionByName(side(exported, "event_id", in_exported=F.lit(True)))
    log = log.groupBy("event_id").agg(F.sum("in_events").alias("in_events"), F.sum("in_exported").alias("in_exported"))

    def total(name: str, where: Column | None = None) -> Column:
        return F.coalesce(F.sum(F.col(name) if where is None else F.when(where, F.col(name))), F.lit(0))

    return files.agg(
        total("in_current").alias("current_rows"),
        total("inactive").alias("inactive_rows"),
        total("lost").alias("deleted_before_hash_rows"),
        total("in_master").alias("master_rows"),
        F.count_if(F.col("in_master") > 1).alias("duplicate_master_file_keys"),
        total("in_current", F.col("in_master") == 0).alias("current_rows_missing_master_anchor"),
    ).crossJoin(log.agg(  # one row each
        total("in_events", F.col("in_exported") == 0).alias("pending_exports"),
        total("in_exported").alias("tracker_rows"),
    ))


def pending_export(events: DataFrame, exported: DataFrame) -> DataFrame:
    """Events not yet in the log.  Writing these and nothing else makes a repeated export harmless."""
    return events.join(exported.select("event_id"), "event_id", "left_anti")


def with_event_id(events: DataFrame) -> DataFrame:
    """``event_id`` from what an event is: the same event gets the same id however often it is made."""
    return events.withColumn("event_id", F.sha1(F.concat_ws("|", "file_key", F.unix_micros(F.col("observed_at").cast("timestamp")).cast("string"), "event_type")))


def snapshot_run(master: DataFrame, current: DataFrame, exported: DataFrame, observed: DataFrame, scan_root: str, observed_at: Column,
                 stage: str = "metadata") -> dict[str, DataFrame]:
    """One scan from observations and tables to what has to be written: ``state``, ``master`` (rows to add), ``events`` and ``export``.

    An empty master makes it the initial load: everything becomes state, no event is written.  ``export`` holds the events that
    ``exported`` (``event_id``) lacks, so a run that is repeated exports nothing twice.
    """
    observed = latest_observation(observed)
    if not master.take(1):
        state = materialise(initial_load(observed), "state")
        nothing = materialise(with_event_id(change_events(snapshot_diff(state, observed, scan_root, observed_at, stage)).filter(F.lit(False))), "events")
        return {"state": state, "master": state.select(*MASTER), "events": nothing, "export": nothing}
    diff = materialise(snapshot_diff(current, observed, scan_root, observed_at, stage), "diff")
    events = materialise(with_event_id(change_events(diff)), "events")
    return {"state": next_state(diff), "master": master_additions(diff, master), "events": events, "export": pending_export(events, exported)}
