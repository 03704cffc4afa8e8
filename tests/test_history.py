import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import changes as C
from shelfmark.operators import history as H

T0 = dt.datetime(2024, 3, 1)
OBS = ("file_key string, volume string, file_id string, identity_source string, path string, file_name string, extension string, "
       "size long, created timestamp, modified timestamp, observed_at timestamp, scan_root string, metadata_signature string, "
       "sha256 string, hash_error string, scan int")


def observation(key, scan, minute, path, size, day, sha, error=None):
    return (key, "v", key, "test", path, path, ".x", size, T0, T0 + dt.timedelta(days=day), T0 + dt.timedelta(days=scan, minutes=minute), "r",
            f"{path}|{size}|{day}", sha, error, scan)


def random_rows(seed, scans, keys=60):
    rng, rows = random.Random(seed), []
    for key in range(keys):
        path, size, day, sha = f"p{key}", 1, 0, rng.choice([None, f"h{key}"])
        for scan in range(scans):
            if rng.random() < 0.35:
                continue  # not seen
            for minute in sorted(rng.sample(range(60), rng.randrange(1, 3))):
                kind = rng.random()
                path = f"p{key}.{scan}" if kind < 0.2 else path
                size = size + 1 if 0.1 < kind < 0.3 else size
                day = scan if kind < 0.4 else day
                sha = rng.choice([None, f"h{key}.{scan}", sha, sha])
                rows.append(observation(f"k{key}", scan, minute, path, size, day, sha, rng.choice([None, None, "locked"]) if sha is None else None))
    return rows


@pytest.mark.parametrize(("seed", "scans", "stage"), [(1, 6, "hash"), (2, 5, "metadata"), (3, 1, "hash")])
def test_equal_to_one_scan_after_the_other(spark, seed, scans, stage):
    rows = spark.createDataFrame(random_rows(seed, scans), OBS).repartition(3)
    taken = spark.createDataFrame([(i, T0 + dt.timedelta(days=i, hours=5)) for i in range(scans)], "scan int, scanned_at timestamp")
    numbered = H.scan_rows(rows, taken)
    got = sorted(map(tuple, H.history_events(numbered, taken, stage).collect()), key=str)
    state, wanted = None, []
    for scan in range(scans):
        seen = C.latest_observation(rows.where(F.col("scan") == scan).drop("scan"))
        if state is None:
            state = C.initial_load(seen)
            continue
        diff = C.snapshot_diff(state, seen, "r", F.lit(T0 + dt.timedelta(days=scan, hours=5)), stage)
        wanted += [(scan, *r) for r in C.change_events(diff).collect()]
        state = spark.createDataFrame(C.next_state(diff).collect(), C.next_state(diff).schema)
    assert got == sorted(wanted, key=str)
    left = H.history_state(numbered, taken, stage).select(*C.STATE).collect()
    assert sorted(map(tuple, left), key=str) == sorted(map(tuple, state.select(*C.STATE).collect()), key=str)


def test_a_hash_seen_earlier_in_a_scan_stays(spark):
    rows = [observation("a", 0, 1, "p", 1, 0, "early"), observation("a", 0, 2, "p", 1, 0, None), observation("a", 1, 1, "p", 1, 0, None),
            observation("b", 0, 1, "q", 1, 0, None)]
    frame = spark.createDataFrame(rows, OBS)
    assert {r["file_key"]: r["sha256"] for r in C.latest_observation(frame.where("scan = 0").drop("scan")).collect()} == {"a": "early", "b": None}
    taken = spark.createDataFrame([(0, T0), (1, T0)], "scan int, scanned_at timestamp")
    state = {r["file_key"]: (r["sha256"], r["content_identity_status"]) for r in H.history_state(H.scan_rows(frame, taken), taken, "hash").collect()}
    assert state == {"a": ("early", "hashed"), "b": (None, "deleted_before_hash")}


def test_scans_are_numbered_by_edges(spark):
    frame = spark.createDataFrame([(i, T0 + dt.timedelta(days=i)) for i in range(5)], "i int, observed_at timestamp")
    edges = [F.lit(T0 + dt.timedelta(days=d)) for d in (1, 3)]
    assert [r["scan"] for r in H.with_scan(frame, edges).orderBy("i").collect()] == [0, 1, 1, 2, 2]
