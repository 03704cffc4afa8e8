import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import changes as C
from shelfmark.operators.collisions import collision_plan
from shelfmark.operators.journal import undo_plan

T0 = dt.datetime(2024, 1, 1)
OBS = ("file_key string, volume string, file_id string, identity_source string, path string, file_name string, extension string, "
       "size long, created timestamp, modified timestamp, observed_at timestamp, scan_root string, metadata_signature string, "
       "sha256 string, hash_error string")


def scan(spark, rows, day, root="r"):
    """rows: (key, path, size, modified day, sha256)"""
    at = T0 + dt.timedelta(days=day)
    data = [(k, "v", k, "test", p, p.split("/")[-1], ".x", s, T0, T0 + dt.timedelta(days=m), at, root, f"{p}|{s}|{m}", sha, None)
            for k, p, s, m, sha in rows]
    return spark.createDataFrame(data, OBS)


def step(spark, current, rows, day, stage="metadata", root="r"):
    return C.snapshot_diff(current, scan(spark, rows, day, root), root, F.lit(T0 + dt.timedelta(days=day)), stage)


def test_every_event_type(spark):
    current = C.initial_load(scan(spark, [(k, f"d/{k}", 1, 0, None) for k in "abcdefg"], 0))
    rows = [("a", "d/a", 1, 0, None), ("b", "e/b", 1, 0, None), ("c", "d/c", 2, 0, None), ("d", "e/d", 2, 0, None), ("e", "d/e", 1, 3, None),
            ("n", "d/n", 1, 0, None), ("g", "d/g", 1, 0, None)]
    diff = step(spark, current, rows, 1).persist()
    got = {r["file_key"]: r["event_type"] for r in C.change_events(diff).collect()}
    assert got == {"b": "path_changed", "c": "content_changed", "d": "path_and_content_changed", "e": "metadata_refreshed",
                   "n": "new_file", "f": "missing_file"}
    assert C.counters(diff).first().asDict() == {"files_seen": 7, "new_files": 1, "path_changed": 2, "content_changed": 2,
                                                 "missing_files": 1, "restored_files": 0}
    state = C.next_state(diff)
    by_key = {r["file_key"]: r for r in state.collect()}
    assert by_key["b"]["original_path"] == "d/b" and by_key["b"]["path"] == "e/b" and by_key["b"]["first_seen_at"] == T0
    assert not by_key["f"]["is_active"] and by_key["f"]["last_seen_at"] == T0 + dt.timedelta(days=1)
    later = step(spark, state, [("f", "d/f", 1, 0, None)], 2)
    got = {r["file_key"]: r["event_type"] for r in C.change_events(later).collect()}
    assert got.pop("f") == "restored_file" and set(got.values()) == {"missing_file"} and "n" in got


def test_inactive_rows_emit_nothing_again(spark):
    current = C.initial_load(scan(spark, [("a", "a", 1, 0, None), ("b", "b", 1, 0, None)], 0))
    state = C.next_state(step(spark, current, [("a", "a", 1, 0, None)], 1))
    assert C.change_events(step(spark, state, [("a", "a", 1, 0, None)], 2)).count() == 0


def test_hashes_are_carried_and_compared(spark):
    current = C.initial_load(scan(spark, [("a", "a", 1, 0, "h1"), ("b", "b", 1, 0, None), ("c", "c", 1, 0, None)], 0))
    diff = step(spark, current, [("a", "a", 1, 0, None), ("b", "b", 1, 2, "h2")], 1, "hash")
    events = {r["file_key"]: r for r in C.change_events(diff).collect()}
    assert set(events) == {"b", "c"}
    assert events["b"]["event_type"] == "content_changed" and events["b"]["previous_sha256"] is None
    assert events["c"]["content_identity_status"] == "deleted_before_hash"
    state = {r["file_key"]: (r["sha256"], r["content_identity_status"]) for r in C.next_state(diff).collect()}
    assert state == {"a": ("h1", "hashed"), "b": ("h2", "hashed"), "c": (None, "deleted_before_hash")}
    rehash = step(spark, C.next_state(diff), [("a", "a", 1, 0, "h9"), ("b", "b", 1, 2, "h2")], 2, "hash")
    assert {r["file_key"]: r["event_type"] for r in C.change_events(rehash).collect()} == {"a": "content_changed"}


def test_hash_policy(spark):
    current = C.initial_load(scan(spark, [("a", "a", 1, 0, "h"), ("b", "b", 1, 0, None), ("big", "big", 9 << 20, 0, None)], 0))
    seen = scan(spark, [("a", "a", 1, 0, None), ("b", "b", 1, 0, None), ("big", "big", 9 << 20, 0, None), ("n", "n", 1, 0, None)], 1)
    assert sorted(r["file_key"] for r in C.hash_todo(current, seen, "r").collect()) == ["b", "n"]


def test_other_roots_are_left_alone(spark):
    current = C.initial_load(scan(spark, [("a", "a", 1, 0, "h"), ("b", "b", 1, 0, None)], 0, "other"))
    diff = step(spark, current, [("a", "z/a", 1, 0, None)], 1, root="r")
    assert [(r["file_key"], r["event_type"]) for r in C.change_events(diff).collect()] == [("a", "new_file")]
    state = {r["file_key"]: r for r in C.next_state(diff).collect()}
    assert (state["a"]["original_path"], state["a"]["scan_root"], state["a"]["sha256"]) == ("a", "r", "h")
    assert state["b"]["is_active"] and state["b"]["scan_root"] == "other"


def test_master_and_verification(spark):
    current = C.initial_load(scan(spark, [("a", "a", 1, 0, None)], 0))
    master = current.select(*C.MASTER)
    diff = step(spark, current, [("a", "a", 1, 0, None), ("n", "n", 1, 0, None)], 1)
    added = C.master_additions(diff, master)
    assert [r["file_key"] for r in added.collect()] == ["n"]
    events = C.change_events(diff).withColumn("event_id", F.monotonically_increasing_id())
    none = events.limit(0)
    row = C.verify_state(master, C.next_state(diff), events, none).first()
    assert (row["master_rows"], row["current_rows"], row["current_rows_missing_master_anchor"], row["pending_exports"]) == (1, 2, 1, 1)
    assert C.verify_state(master.unionByName(added), C.next_state(diff), events, events).first()["pending_exports"] == 0


def test_latest_observation_is_last_by_time(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "q")], "file_key string, observed_at int, path string")
    assert {r["file_key"]: r["path"] for r in C.latest_observation(df).collect()} == {"a": "z", "b": "q"}


def sequential(requests, existing):
    """The naming rule applied one request after the other, in the order the operator documents."""
    import os
    taken = {(f, n.lower()) for f, n in existing}
    rows = sorted(requests)
    first, rest = {}, []
    for path, folder, base, ext in rows:
        name = (base if len(base) <= 170 else base[:170].strip()) + ext
        key = (folder, name.lower())
        if key not in first and key not in taken:
            first[key] = path
            rest.insert(0, (0, path, folder, name))
        else:
            rest.append((1, path, folder, name))
    out = {}
    for _, path, folder, name in sorted(rest):
        stem, ext = os.path.splitext(name)
        candidate, n = name, 0
        while (folder, candidate.lower()) in taken:
            n += 1
            candidate = f"{stem}_{n}{ext}"
        taken.add((folder, candidate.lower()))
        out[path] = candidate
    return out


@pytest.mark.parametrize("seed,ranges", [(1, None), (2, 3), (3, 40)])
def test_collisions_match_the_sequential_rule(spark, seed, ranges):
    rng = random.Random(seed)
    base = lambda: rng.choice(["a", "A", "a_1", "a_2", "a_1_1", "b", "b_007", "x.y", "a_3", "n" * 180])
    requests = [(f"p/{i:03d}", rng.choice(["f", "f", "f", "g"]), base(), rng.choice([".txt", ".txt", ".TXT", ""])) for i in range(120)]
    existing = list({(rng.choice("fg"), base() + rng.choice([".txt", ""])) for _ in range(8)})
    got = collision_plan(spark.createDataFrame(requests, "path string, folder string, base string, ext string"),
                         spark.createDataFrame(existing, "folder string, name string"), ranges)
    assert {r["path"]: r["final_name"] for r in got.collect()} == sequential(requests, existing)


def test_undo_plan(spark):
    journal = spark.createDataFrame([(1, None, "a", "b"), (2, None, "c", "d"), (3, None, "e", "f")], "seq long, ts timestamp, old string, new string")
    existing = spark.createDataFrame([("b",), ("d",), ("c",)], "path string")
    assert {r["seq"]: r["status"] for r in undo_plan(journal, existing).collect()} == {1: "would_restore", 2: "skipped_occupied", 3: "skipped_missing"}
