import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import changes as C
from shelfmark.streaming.scans import read_log, read_state, track_scans
from shelfmark.streaming.tracker import append_events, start_state, track_changes, tracked_state

SCHEMA = "file_key string, path string, size double, sha256 string, observed_at timestamp"
T0 = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, scans, **options):
    for i, rows in enumerate(scans):
        data = [(k, p, s, None, T0 + dt.timedelta(days=i, minutes=m)) for k, p, s, m in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/scan={i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    append_events(track_changes(stream, **options), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


SCANS = [
    [("a", "d/a", 1.0, 0), ("b", "d/b", 1.0, 0), ("c", "d/c", 1.0, 0), ("c", "d/old", 9.0, -5)],
    [("a", "d/a", 1.0, 0), ("b", "e/b", 1.0, 0), ("c", "d/c", 2.0, 1), ("c", "d/c", 1.5, 0), ("n", "n", 1.0, 0)],
    [("a", "z/a", 4.0, 0), ("n", "n", 1.0, 0)],
]


def test_stream_equals_batch(spark, tmp_path):
    got = {(r["file_key"], r["observed_at"].day, r["event_type"]) for r in run(spark, tmp_path, SCANS).collect()}
    want = set()
    state = None
    for i, rows in enumerate(SCANS):
        seen = spark.createDataFrame([(k, p, s, T0 + dt.timedelta(days=i, minutes=m)) for k, p, s, m in rows],
                                     "file_key string, path string, size double, observed_at timestamp")
        null = lambda t: F.lit(None).cast(t)
        full = C.latest_observation(seen).select(
            "*", *[null("string").alias(c) for c in ("volume", "file_id", "identity_source", "file_name", "extension", "metadata_signature", "sha256", "hash_error")],
            null("timestamp").alias("created"), null("timestamp").alias("modified"), F.lit("r").alias("scan_root"))
        if state is None:
            want |= {(r["file_key"], i + 1, "new_file") for r in full.collect()}  # a stream has no initial load: first sightings are events
            state = C.initial_load(full)
        else:
            diff = C.snapshot_diff(state, full, "r", F.lit(T0 + dt.timedelta(days=i)))
            want |= {(r["file_key"], i + 1, r["event_type"]) for r in C.change_events(diff).filter("event_type != 'missing_file'").collect()}
            state = C.next_state(diff)
    assert got == want and len(got) == 7


def test_a_time_to_live_needs_a_lateness(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    with pytest.raises(ValueError):
        track_changes(stream, ttl_seconds=10)


def test_missing_and_restored_with_time_to_live(spark, tmp_path):
    scans = [[("a", "a", 1.0, 0), ("b", "b", 1.0, 0)], [("a", "a", 1.0, 0)], [("a", "a", 1.0, 0)], [("a", "a", 1.0, 0)], [("a", "a", 1.0, 0), ("b", "b", 1.0, 0)]]
    rows = run(spark, tmp_path, scans, ttl_seconds=36 * 3600, lateness="0 seconds").orderBy("observed_at").collect()
    assert [r["event_type"] for r in rows if r["file_key"] == "b"] == ["new_file", "missing_file", "restored_file"]
    assert [r["event_type"] for r in rows if r["file_key"] == "a"] == ["new_file"]


def test_scans_equal_the_batch_run_and_may_repeat(spark, tmp_path):
    """Missing and restored files, and a batch that runs twice: the tables are the same as after one run."""
    names = ("volume", "file_id", "identity_source", "file_name", "extension", "metadata_signature", "sha256", "hash_error")
    null = [F.lit(None).cast("string").alias(c) for c in names] + [F.lit(None).cast("timestamp").alias(c) for c in ("created", "modified")]
    scans = [[("a", "x/a", 1), ("b", "x/b", 1)], [("a", "y/a", 1)], [("a", "y/a", 2), ("b", "x/b", 1), ("c", "x/c", 1)]]
    for day, rows in enumerate(scans):
        frame = spark.createDataFrame([(k, p, s, T0 + dt.timedelta(days=day)) for k, p, s in rows for _ in range(2)], "file_key string, path string, size long, observed_at timestamp")
        frame = frame.select("*", *null, F.lit("r").alias("scan_root"))
        frame.write.mode("append").parquet(f"{tmp_path}/in")
        track_scans(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", "r").awaitTermination()
    log = read_log(spark, f"{tmp_path}/out", "events", 3)
    got = sorted((r["file_key"], r["observed_at"].day, r["event_type"]) for r in log.collect())
    assert got == [("a", 2, "path_changed"), ("a", 3, "content_changed"), ("b", 2, "missing_file"), ("b", 3, "restored_file"), ("c", 3, "new_file")]
    assert log.select("event_id").distinct().count() == 5 and read_log(spark, f"{tmp_path}/out", "master", 3).count() == 3
    state = {r["file_key"]: (r["path"], r["is_active"], r["first_seen_at"].day) for r in read_state(spark, f"{tmp_path}/out", 3).collect()}
    assert state == {"a": ("y/a", True, 1), "b": ("x/b", True, 1), "c": ("x/c", True, 3)}
    again = C.snapshot_run(read_log(spark, f"{tmp_path}/out", "master", 2), read_state(spark, f"{tmp_path}/out", 2), log.select("event_id"),
                           frame, "r", F.lit(T0 + dt.timedelta(days=2)))
    assert again["events"].count() == 3 and again["export"].count() == 0


def test_stream_continues_from_a_state_and_counts_late_rows(spark, tmp_path):
    start = spark.createDataFrame([("a", "d/a", 1.0, "h", True, T0), ("b", "d/b", 1.0, None, False, T0), ("q", "d/q", 1.0, None, True, T0)],
                                  "file_key string, path string, size double, sha256 string, is_active boolean, last_seen_at timestamp")
    scans = [[("a", "e/a", 1.0, 5), ("a", "x", 7.0, -3), ("b", "d/b", 1.0, 1), ("n", "n", 1.0, 0)], [("n", "n", 2.0, -1441), ("a", "x", 7.0, -2000), ("a", "y", 7.0, -1999)]]
    got = sorted((r["file_key"], r["event_type"], r["late"]) for r in run(spark, tmp_path, scans, start=start_state(start)).collect())
    assert got == [("a", "late_rows", 1), ("a", "late_rows", 2), ("a", "path_changed", 0), ("b", "restored_file", 0), ("n", "late_rows", 1), ("n", "new_file", 0)]
    state = {r["file_key"]: (r["path"], r["size"], r["sha256"], r["is_active"]) for r in tracked_state(spark, f"{tmp_path}/cp").collect()}
    assert state == {"a": ("e/a", 1.0, "h", True), "b": ("d/b", 1.0, None, True), "n": ("n", 1.0, None, True), "q": ("d/q", 1.0, None, True)}


def test_state_is_kept_by_slot(spark, tmp_path):
    """Many keys, few slots: as many state rows as slots; keys of one slot keep their own times to live."""
    first = [(f"k{i}", f"d/{i}", float(i), i) for i in range(300)]
    scans = [first, [("k7", "e/7", 7.0, 0)], [(f"k{i}", f"d/{i}", float(i), 0) for i in range(8, 300)]]
    got = run(spark, tmp_path, scans, ttl_seconds=36 * 3600, lateness="0 seconds", slots=4).collect()
    assert sum(r["event_type"] == "new_file" for r in got) == 300
    assert [(r["file_key"], r["path"], r["previous_path"]) for r in got if r["event_type"] == "path_changed"] == [("k7", "e/7", "d/7")]
    missing = {r["file_key"]: r["observed_at"] for r in got if r["event_type"] == "missing_file"}
    assert missing == {f"k{i}": T0 + dt.timedelta(minutes=i, hours=36) for i in range(7)}
    assert spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/cp").count() == 4
    state = {r["file_key"]: (r["path"], r["is_active"]) for r in tracked_state(spark, f"{tmp_path}/cp").collect()}
    assert len(state) == 300 and state["k7"] == ("e/7", True) and state["k3"] == ("d/3", False) and state["k9"] == ("d/9", True)
