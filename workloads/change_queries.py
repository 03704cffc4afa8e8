"""Queries over snapshots: two scans of the same drive, the first and the second half of the events table."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from shelfmark.operators import changes as C
from shelfmark.operators import history as H
from shelfmark.operators import kept as K
from shelfmark.session import ROCKSDB, materialise, run_folder
from shelfmark.streaming.scans import read_log, read_state, track_scans
from shelfmark.streaming.tracker import append_events, start_state, track_changes, tracked_state
from workloads import derive as D

AT = "2024-02-01"
EDGES = ("2024-01-11", "2024-01-21")


def _scan(spark, sf, half):
    seen = D.observations(spark, sf)
    early = F.col("observed_at") < F.lit(D.MIDDLE).cast("timestamp")
    return C.latest_observation(seen.filter(early if half == 0 else ~early))


def _current(spark, sf):
    """State after the first scan; keys of sign-ups were already missing then."""
    state = C.initial_load(_scan(spark, sf, 0))
    return state.withColumn("is_active", ~F.col("file_key").endswith("|signup"))


def _diff(spark, sf, stage="hash"):
    return C.snapshot_diff(_current(spark, sf), _scan(spark, sf, 1), "drive", F.lit(AT).cast("timestamp"), stage)


def latest_observation(spark, sf):
    return C.latest_observation(D.observations(spark, sf)).select("file_key", "path", "size", "observed_at")


def identity_keys(spark, sf):
    rows = D.observations(spark, sf)
    return rows.groupBy(C.file_key(F.col("volume"), F.col("file_id")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def snapshot_diff(spark, sf):
    return C.change_events(_diff(spark, sf)).select(
        "file_key", "event_type", "path_changed", "content_changed", "active_state_changed", "previous_path", "path", "size", "sha256",
        "previous_sha256", "is_active", "content_identity_status")


def metadata_diff(spark, sf):
    return C.change_events(_diff(spark, sf, "metadata")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def event_counts(spark, sf):
    return C.counters(_diff(spark, sf))


def current_state(spark, sf):
    return C.next_state(_diff(spark, sf)).select("file_key", "path", "size", "original_path", "first_seen_at", "last_seen_at", "is_active", "sha256",
                                                 "content_identity_status")


def master_additions(spark, sf):
    master = _current(spark, sf).select(*C.MASTER)
    return C.master_additions(_diff(spark, sf), master).select("file_key", "original_path", "first_seen_at")


def first_sighting(spark, sf):
    rows = D.observations(spark, sf).select("file_key", F.col("observed_at").alias("first_seen_at"), "path")
    return C.first_per_key(rows)


def hash_todo(spark, sf):
    return C.hash_todo(_current(spark, sf), _scan(spark, sf, 1), "drive", limit=1)


def _tables(spark, sf):
    """The diff of the two scans, written once, and its events with their ids."""
    diff = materialise(_diff(spark, sf), "diff")
    return diff, C.with_event_id(C.change_events(diff))


def pending_export(spark, sf):
    events = _tables(spark, sf)[1]
    return C.pending_export(events, events.filter("event_type = 'new_file'")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def verify_state(spark, sf):
    diff, events = _tables(spark, sf)
    exported = events.filter("event_type = 'new_file'").select("event_id")
    master = diff.filter("p_file_key IS NOT NULL").select(F.col("p_file_key").alias("file_key"))
    return C.verify_state(master, C.next_state(diff), events, exported)


def three_scans(spark, sf):
    """Three scans in a row through the whole run: initial load, two updates, the export log appended each time and the last run
    repeated; the log of all events with the state that is left."""
    seen = D.observations(spark, sf)
    at, edges = F.col("observed_at"), [F.lit(x).cast("timestamp") for x in EDGES]
    parts = [seen.filter(at < edges[0]), seen.filter((at >= edges[0]) & (at < edges[1])), seen.filter(at >= edges[1])]
    state = master = C.initial_load(C.latest_observation(seen.limit(0)))
    log = None
    for part, day in zip([*parts, parts[-1]], ("2024-01-11", "2024-01-21", "2024-02-01", "2024-02-01")):
        exported = log.select("event_id") if log is not None else spark.createDataFrame([], "event_id string")
        run = C.snapshot_run(master.select(*C.MASTER), state, exported, part, "drive", F.lit(day).cast("timestamp"), "hash")
        new = materialise(run["export"], "export")
        log = new if log is None else log.unionByName(new)
        master = materialise(master.select(*C.MASTER).unionByName(run["master"].select(*C.MASTER)), "master")
        state = materialise(run["state"], "state")
    return log.groupBy("file_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("observed_at", "event_type"))), lambda e: e["event_type"]), ">").alias("events"),
    ).join(state.select("file_key", "path", "is_active", "first_seen_at"), "file_key", "right")


def _all_scans(spark, sf, edges, days):
    """Observations numbered by scan, and when each scan was taken."""
    scans = spark.createDataFrame(list(enumerate(days)), "scan int, day string").select("scan", F.col("day").cast("timestamp").alias("scanned_at"))
    seen = H.with_scan(D.observations(spark, sf), [F.lit(x).cast("timestamp") for x in edges])
    return materialise(H.scan_rows(seen, scans), "scan-rows"), scans


def scan_history(spark, sf):
    """The three scans of ``three_scans`` in one pass: every event of a key in order, and the state that is left."""
    rows, scans = _all_scans(spark, sf, EDGES, ("2024-01-11", "2024-01-21", "2024-02-01"))
    events = H.history_events(rows, scans, "hash")
    chains = events.groupBy("file_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("scan", "event_type"))), lambda e: e["event_type"]), ">").alias("events"))
    return chains.join(H.history_state(rows, scans, "hash").select("file_key", "path", "is_active", "first_seen_at"), "file_key", "right")


DAYS = [f"2024-01-{day:02d}" for day in range(2, 32)]


def daily_history(spark, sf):
    """One scan a day over the whole events table: every change event."""
    rows, scans = _all_scans(spark, sf, DAYS, [*DAYS, "2024-02-01"])
    return H.history_events(rows, scans, "hash").select(
        "scan", "observed_at", "event_type", "path_changed", "content_changed", "active_state_changed", "file_key", "original_path", "previous_path",
        "path", "size", "sha256", "previous_sha256", "is_active", "content_identity_status")


def daily_state(spark, sf):
    """The state after a scan a day."""
    rows, scans = _all_scans(spark, sf, DAYS, [*DAYS, "2024-02-01"])
    return H.history_state(rows, scans, "hash").select("file_key", "path", "size", "original_path", "first_seen_at", "last_seen_at", "is_active", "sha256",
                                                       "content_identity_status")


def _kept(spark, sf):
    """The second scan against state and master tables in buckets."""
    state = K.keep(_current(spark, sf), "state", 8)
    master = K.keep(_current(spark, sf).select(*C.MASTER), "master", 8)
    later = D.observations(spark, sf).filter(F.col("observed_at") >= F.lit(D.MIDDLE).cast("timestamp"))
    return K.update(state, master, later, "drive", F.lit(AT).cast("timestamp"), "hash", 8)


def kept_events(spark, sf):
    return _kept(spark, sf)["events"].select(
        "file_key", "event_type", "path_changed", "content_changed", "active_state_changed", "previous_path", "path", "size", "sha256",
        "previous_sha256", "is_active", "content_identity_status")


def kept_state(spark, sf):
    return _kept(spark, sf)["state"].select("file_key", "path", "size", "original_path", "first_seen_at", "last_seen_at", "is_active", "sha256",
                                            "content_identity_status")


def kept_master(spark, sf):
    return _kept(spark, sf)["master"].select("file_key", "original_path", "first_seen_at")


def stream_changes(spark, sf):
    """The whole events table, raw, as three scans, one micro-batch each, through the stateful tracker."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    root = os.path.join(run_folder(spark), f"stream-{uuid.uuid4().hex}")
    seen = D.observations(spark, sf).select("file_key", "path", "size", "sha256", "observed_at")
    edges = [F.lit(x).cast("timestamp") for x in EDGES]
    at = F.col("observed_at")
    for part in (seen.filter(at < edges[0]), seen.filter((at >= edges[0]) & (at < edges[1])), seen.filter(at >= edges[1])):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(seen.schema).parquet(f"{root}/in")
        append_events(track_changes(stream), f"{root}/out", f"{root}/cp").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("file_key", "event_type", "path_changed", "content_changed", "previous_path", "path", "size",
                                                    "observed_at")


def _continued(spark, sf):
    """A stream that starts from the state of the first scan and gets the second and third, the first once more among the third.

    Returns its events and its checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    root = os.path.join(run_folder(spark), f"continued-{uuid.uuid4().hex}")
    full, at = D.observations(spark, sf), F.col("observed_at")
    edges = [F.lit(x).cast("timestamp") for x in EDGES]
    start = materialise(start_state(C.initial_load(C.latest_observation(full.filter(at < edges[0])))), "start")
    seen = full.select("file_key", "path", "size", "sha256", "observed_at")
    for part in (seen.filter((at >= edges[0]) & (at < edges[1])), seen.filter((at >= edges[1]) | (at < edges[0]))):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(seen.schema).parquet(f"{root}/in")
        append_events(track_changes(stream, start=start), f"{root}/out", f"{root}/cp").awaitTermination()
    return spark.read.parquet(f"{root}/out"), f"{root}/cp"


def stream_continued(spark, sf):
    """Events of a stream that continues from a batch state, with the rows that came late."""
    return _continued(spark, sf)[0].select("file_key", "event_type", "path_changed", "content_changed", "previous_path", "path", "size", "late")


def stream_state(spark, sf):
    """The state of that stream, read back from its state store."""
    return tracked_state(spark, _continued(spark, sf)[1])


def stream_scans(spark, sf):
    """All events in three scans through the stream of scans: every event of a key in order, and the state that is left."""
    root = os.path.join(run_folder(spark), f"scans-{uuid.uuid4().hex}")
    seen = D.observations(spark, sf)
    at, edges = F.col("observed_at"), [F.lit(x).cast("timestamp") for x in EDGES]
    for part in (seen.filter(at < edges[0]), seen.filter((at >= edges[0]) & (at < edges[1])), seen.filter(at >= edges[1])):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(seen.schema).parquet(f"{root}/in")
        track_scans(stream, f"{root}/out", "drive", "hash").awaitTermination()
    log = read_log(spark, f"{root}/out", "events", 3)
    chains = log.groupBy("file_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("observed_at", "event_type"))), lambda e: e["event_type"]), ">").alias("events"))
    state = read_state(spark, f"{root}/out", 3).select("file_key", "path", "is_active", "first_seen_at")
    return chains.join(state, "file_key", "right")


QUERIES = {f.__name__: f for f in (latest_observation, identity_keys, snapshot_diff, metadata_diff, event_counts, current_state, master_additions,
                                   first_sighting, hash_todo, pending_export, verify_state, three_scans, scan_history, daily_history, daily_state, kept_events, kept_state, kept_master,
                                   stream_changes, stream_continued, stream_state, stream_scans)}

HALVES = f"""obs AS ({D.OBS}),
a AS (SELECT *, file_key NOT LIKE '%|signup' AS act FROM obs WHERE observed_at < TIMESTAMP '{D.MIDDLE}'
  QUALIFY row_number() OVER (PARTITION BY file_key ORDER BY observed_at DESC) = 1),
b AS (SELECT * FROM obs WHERE observed_at >= TIMESTAMP '{D.MIDDLE}' QUALIFY row_number() OVER (PARTITION BY file_key ORDER BY observed_at DESC) = 1)"""


def _diff_sql(stage: str) -> str:
    first = "b.sha256 IS NOT NULL AND a.sha256 IS NULL AND (a.path <> b.path OR a.size <> b.size OR a.modified <> b.modified OR NOT act)"
    return f"""{HALVES}, d0 AS (SELECT coalesce(b.file_key, a.file_key) AS file_key, a.file_key IS NULL AS is_new, b.file_key IS NULL AND act AS is_missing,
  b.file_key IS NOT NULL AS seen, a.path AS pp, b.path AS op, a.size AS ps, b.size AS os, a.sha256 AS psha, b.sha256 AS osha, act,
  a.observed_at AS pat, b.observed_at AS oat,
  coalesce(a.path <> b.path, false) AS path_changed,
  CASE WHEN a.file_key IS NULL THEN b.sha256 IS NOT NULL WHEN b.file_key IS NULL THEN false
   ELSE a.size <> b.size OR coalesce(a.sha256 <> b.sha256, false) OR ({first if stage == 'hash' else 'false'}) END AS content_changed,
  a.file_key IS NULL OR (b.file_key IS NULL AND act) OR (b.file_key IS NOT NULL AND NOT act) AS active_state_changed,
  coalesce(a.modified <> b.modified OR a.path <> b.path OR a.size <> b.size, false) AS metadata_changed FROM a FULL JOIN b ON a.file_key = b.file_key),
d AS (SELECT *, CASE WHEN is_new THEN 'new_file' WHEN is_missing THEN 'missing_file' WHEN active_state_changed THEN 'restored_file'
  WHEN path_changed AND content_changed THEN 'path_and_content_changed' WHEN path_changed THEN 'path_changed' WHEN content_changed THEN 'content_changed'
  WHEN metadata_changed THEN 'metadata_refreshed' END AS event_type, coalesce(osha, psha) AS sha256,
  CASE WHEN is_missing AND psha IS NULL AND '{stage}' = 'hash' THEN 'deleted_before_hash' WHEN coalesce(osha, psha) IS NOT NULL THEN 'hashed'
   ELSE 'not_hashed_yet' END AS status FROM d0)"""


def _step(scan: str, old: str, diff: str, new: str) -> str:
    """CTEs of one update: the differences of a scan and the state after it."""
    return f"""{diff} AS (SELECT *, CASE WHEN is_new THEN 'new_file' WHEN is_missing THEN 'missing_file' WHEN back THEN 'restored_file'
  WHEN pc AND cc THEN 'path_and_content_changed' WHEN pc THEN 'path_changed' WHEN cc THEN 'content_changed' WHEN mc THEN 'metadata_refreshed' END AS event_type
 FROM (SELECT coalesce(b.file_key, a.file_key) AS file_key, a.file_key IS NULL AS is_new, b.file_key IS NULL AND a.act AS is_missing,
   coalesce(b.file_key IS NOT NULL AND NOT a.act, false) AS back, coalesce(a.path <> b.path, false) AS pc, coalesce(a.size <> b.size, false)
   OR coalesce(a.sha256 <> b.sha256, false) OR coalesce(b.sha256 IS NOT NULL AND a.sha256 IS NULL AND (a.path <> b.path OR a.size <> b.size OR a.modified <> b.modified
   OR NOT a.act), false) AS cc, coalesce(a.modified <> b.modified OR a.path <> b.path OR a.size <> b.size, false) AS mc,
   coalesce(b.path, a.path) AS path, coalesce(b.size, a.size) AS size, coalesce(b.modified, a.modified) AS modified, coalesce(b.sha256, a.sha256) AS sha256,
   b.file_key IS NOT NULL AS act, coalesce(a.first_seen, b.observed_at) AS first_seen FROM {old} a FULL JOIN {scan} b ON a.file_key = b.file_key)),
{new} AS (SELECT file_key, path, size, modified, sha256, act, first_seen FROM {diff})"""


DIFF = _diff_sql("hash")
PERIODS = f"""WITH obs AS ({D.OBS}), p AS (SELECT *, CASE WHEN observed_at < TIMESTAMP '2024-01-11' THEN 0 WHEN observed_at < TIMESTAMP '2024-01-21' THEN 1
  ELSE 2 END AS scan FROM obs),
l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY file_key, scan ORDER BY observed_at DESC) = 1),
g AS (SELECT *, lag(path) OVER w AS pp, lag(size) OVER w AS ps FROM l WINDOW w AS (PARTITION BY file_key ORDER BY scan)),
e AS (SELECT *, coalesce(pp <> path, false) AS path_changed, CASE WHEN pp IS NULL THEN sha256 IS NOT NULL ELSE ps <> size END AS content_changed FROM g)
SELECT file_key, CASE WHEN pp IS NULL THEN 'new_file' WHEN path_changed AND content_changed THEN 'path_and_content_changed'
 WHEN path_changed THEN 'path_changed' ELSE 'content_changed' END AS event_type, path_changed, content_changed, pp AS previous_path, path,
 size::DOUBLE AS size, observed_at FROM e WHERE pp IS NULL OR path_changed OR content_changed"""

ORACLES = {
    "latest_observation": f"""SELECT file_key, path, size, observed_at FROM ({D.OBS}) QUALIFY row_number() OVER (PARTITION BY file_key ORDER BY observed_at DESC) = 1""",
    "identity_keys": f"SELECT sha1(concat('v1|', {D.EVENT_KEY})) AS key, count(*) AS n FROM events GROUP BY 1",
    "snapshot_diff": f"""WITH {DIFF} SELECT file_key, event_type, path_changed, content_changed, active_state_changed, pp AS previous_path,
 coalesce(op, pp) AS path, coalesce(os, ps) AS size, sha256, psha AS previous_sha256, seen AS is_active, status AS content_identity_status
 FROM d WHERE event_type IS NOT NULL""",
    "metadata_diff": f"WITH {_diff_sql('metadata')} SELECT event_type, count(*) AS n FROM d WHERE event_type IS NOT NULL GROUP BY event_type",
    "event_counts": f"""WITH {DIFF} SELECT count(*) FILTER (seen) AS files_seen, count(*) FILTER (is_new) AS new_files,
 count(*) FILTER (path_changed AND NOT is_new) AS path_changed, count(*) FILTER (content_changed AND NOT is_new) AS content_changed,
 count(*) FILTER (is_missing) AS missing_files, count(*) FILTER (active_state_changed AND NOT is_new AND NOT is_missing) AS restored_files FROM d""",
    "current_state": f"""WITH {DIFF} SELECT file_key, coalesce(op, pp) AS path, coalesce(os, ps) AS size, coalesce(pp, op) AS original_path,
 coalesce(pat, oat) AS first_seen_at, CASE WHEN seen THEN oat WHEN is_missing THEN TIMESTAMP '2024-02-01' ELSE pat END AS last_seen_at,
 CASE WHEN seen THEN true WHEN is_missing THEN false ELSE act END AS is_active, sha256, status AS content_identity_status FROM d""",
    "master_additions": f"WITH {DIFF} SELECT file_key, op AS original_path, oat AS first_seen_at FROM d WHERE is_new",
    "first_sighting": f"""SELECT file_key, observed_at AS first_seen_at, path FROM ({D.OBS}) QUALIFY row_number() OVER (PARTITION BY file_key ORDER BY observed_at) = 1""",
    "hash_todo": f"""WITH {HALVES} SELECT b.file_key, b.path FROM b LEFT JOIN a ON a.file_key = b.file_key WHERE a.file_key IS NULL OR a.path <> b.path
 OR a.size <> b.size OR a.modified <> b.modified OR NOT act OR (a.sha256 IS NULL AND a.size <= 1)""",
    "pending_export": f"""WITH {DIFF} SELECT event_type, count(*) AS n FROM d WHERE event_type IS NOT NULL AND event_type <> 'new_file' GROUP BY event_type""",
    "verify_state": f"""WITH {DIFF} SELECT count(*) AS current_rows, count(*) FILTER (NOT seen) AS inactive_rows,
 count(*) FILTER (status = 'deleted_before_hash') AS deleted_before_hash_rows, count(*) FILTER (NOT is_new) AS master_rows, 0 AS duplicate_master_file_keys,
 count(*) FILTER (is_new) AS current_rows_missing_master_anchor, count(*) FILTER (event_type <> 'new_file') AS pending_exports,
 count(*) FILTER (is_new) AS tracker_rows FROM d""",
    "stream_changes": PERIODS,
    "three_scans": f"""WITH obs AS ({D.OBS}), s1 AS (SELECT * FROM obs WHERE observed_at < TIMESTAMP '2024-01-11'
  QUALIFY row_number() OVER (PARTITION BY file_key ORDER BY observed_at DESC) = 1),
 s2 AS (SELECT * FROM obs WHERE observed_at >= TIMESTAMP '2024-01-11' AND observed_at < TIMESTAMP '2024-01-21'
  QUALIFY row_number() OVER (PARTITION BY file_key ORDER BY observed_at DESC) = 1),
 s3 AS (SELECT * FROM obs WHERE observed_at >= TIMESTAMP '2024-01-21' QUALIFY row_number() OVER (PARTITION BY file_key ORDER BY observed_at DESC) = 1),
 c1 AS (SELECT file_key, path, size, modified, sha256, true AS act, observed_at AS first_seen FROM s1), {_step('s2', 'c1', 'd2', 'c2')}, {_step('s3', 'c2', 'd3', 'c3')},
 ev AS (SELECT file_key, 1 AS n, event_type FROM d2 WHERE event_type IS NOT NULL UNION ALL SELECT file_key, 2, event_type FROM d3 WHERE event_type IS NOT NULL
),
 lg AS (SELECT file_key, string_agg(event_type, '>' ORDER BY n) AS events FROM ev GROUP BY file_key)
 SELECT file_key, events, path, act AS is_active, first_seen AS first_seen_at FROM c3 LEFT JOIN lg USING (file_key)""",
}
ORACLES["stream_scans"] = ORACLES["three_scans"]
ORACLES |= {"kept_events": ORACLES["snapshot_diff"], "kept_state": ORACLES["current_state"], "kept_master": ORACLES["master_additions"]}
ORACLES["scan_history"] = ORACLES["three_scans"]
# Every key on every day of the month: present rows carried forward, one row a day, compared with the day before.
DAILY = f"""WITH obs AS ({D.OBS}), day AS (SELECT *, greatest(0, date_diff('day', DATE '2024-01-01', CAST(observed_at AS DATE))) AS scan FROM obs),
 seen AS (SELECT * FROM day QUALIFY row_number() OVER (PARTITION BY file_key, scan ORDER BY observed_at DESC) = 1),
 keys AS (SELECT file_key, min(scan) AS born, arg_min(path, scan) AS original_path, arg_min(observed_at, scan) AS first_seen_at FROM seen GROUP BY file_key),
 grid AS (SELECT k.*, s.scan FROM keys k, (SELECT unnest(range(0, 31)) AS scan) s WHERE s.scan >= k.born),
 full0 AS (SELECT g.file_key, g.born, g.original_path, g.first_seen_at, g.scan, seen.scan IS NOT NULL AS here, seen.path, seen.size, seen.modified, seen.observed_at,
   seen.sha256 FROM grid g LEFT JOIN seen ON seen.file_key = g.file_key AND seen.scan = g.scan),
 carried AS (SELECT * REPLACE (last_value(path IGNORE NULLS) OVER w AS path, last_value(size IGNORE NULLS) OVER w AS size,
   last_value(modified IGNORE NULLS) OVER w AS modified), sha256 AS own, last_value(sha256 IGNORE NULLS) OVER w AS sha FROM full0
   WINDOW w AS (PARTITION BY file_key ORDER BY scan ROWS UNBOUNDED PRECEDING)),
 pair AS (SELECT *, lag(here) OVER w AS was, lag(path) OVER w AS pp, lag(size) OVER w AS ps, lag(modified) OVER w AS pm, lag(sha) OVER w AS psha
   FROM carried WINDOW w AS (PARTITION BY file_key ORDER BY scan)),
 flag AS (SELECT *, was IS NULL AS is_new, was AND NOT here AS is_missing, coalesce(here AND path <> pp, false) AS path_changed,
   CASE WHEN was IS NULL THEN own IS NOT NULL WHEN NOT here THEN false ELSE size <> ps OR coalesce(own <> psha, false)
     OR (own IS NOT NULL AND psha IS NULL AND (path <> pp OR size <> ps OR modified <> pm OR NOT was)) END AS content_changed,
   was IS NULL OR was <> here AS active_state_changed, coalesce(here AND (modified <> pm OR path <> pp OR size <> ps), false) AS metadata_changed,
   CASE WHEN sha IS NOT NULL THEN 'hashed' WHEN here THEN 'not_hashed_yet' ELSE 'deleted_before_hash' END AS status FROM pair)"""
ORACLES["daily_history"] = f"""{DAILY} SELECT scan::INTEGER AS scan, CAST(TIMESTAMP '2024-01-02' + to_days(scan::INTEGER) AS TIMESTAMP) AS observed_at,
 CASE WHEN is_new THEN 'new_file' WHEN is_missing THEN 'missing_file' WHEN active_state_changed THEN 'restored_file'
  WHEN path_changed AND content_changed THEN 'path_and_content_changed' WHEN path_changed THEN 'path_changed' WHEN content_changed THEN 'content_changed'
  WHEN metadata_changed THEN 'metadata_refreshed' END AS event_type, path_changed, content_changed, active_state_changed, file_key, original_path,
 pp AS previous_path, path, size, sha AS sha256, psha AS previous_sha256, here AS is_active, status AS content_identity_status
 FROM flag WHERE scan > 0 AND event_type IS NOT NULL"""
ORACLES["daily_state"] = f"""{DAILY}, ended AS (SELECT file_key, max(scan) FILTER (here) AS last_scan, arg_max(observed_at, scan) FILTER (here) AS seen_at
  FROM flag GROUP BY file_key)
 SELECT file_key, path, size, original_path, first_seen_at, CASE WHEN here THEN seen_at ELSE CAST(TIMESTAMP '2024-01-02' + to_days((last_scan + 1)::INTEGER) AS TIMESTAMP) END
  AS last_seen_at, here AS is_active, sha AS sha256, status AS content_identity_status FROM flag JOIN ended USING (file_key) WHERE scan = 30"""
_PERIODS = PERIODS[: PERIODS.index("SELECT file_key, CASE WHEN pp IS NULL")]
ORACLES["stream_continued"] = f"""{_PERIODS} SELECT file_key, CASE WHEN pp IS NULL THEN 'new_file' WHEN path_changed AND content_changed THEN
 'path_and_content_changed' WHEN path_changed THEN 'path_changed' ELSE 'content_changed' END AS event_type, path_changed, content_changed,
 pp AS previous_path, path, size::DOUBLE AS size, 0::BIGINT AS late FROM e WHERE scan > 0 AND (pp IS NULL OR path_changed OR content_changed)
UNION ALL SELECT p.file_key, 'late_rows', false, false, k.path, k.path, k.size::DOUBLE, count(*) FROM p JOIN (
  SELECT * FROM l WHERE scan < 2 QUALIFY row_number() OVER (PARTITION BY file_key ORDER BY scan DESC) = 1) k ON k.file_key = p.file_key
 WHERE p.scan = 0 AND p.observed_at < k.observed_at GROUP BY ALL"""
ORACLES["stream_state"] = f"""{_PERIODS} SELECT file_key, path, size::DOUBLE AS size, sha256, true AS is_active, observed_at AS last_seen_at FROM (
  SELECT *, last_value(sha256 IGNORE NULLS) OVER (PARTITION BY file_key ORDER BY scan) AS s FROM l)
 QUALIFY row_number() OVER (PARTITION BY file_key ORDER BY scan DESC) = 1"""
