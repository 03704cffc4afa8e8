from pyspark.sql import functions as F

from shelfmark.operators import changes as C
from shelfmark.operators import kept as K
from tests.test_history import OBS, T0, observation


def test_only_the_scan_is_shuffled(spark):
    first = spark.createDataFrame([observation(f"k{i}", 0, 1, f"p{i}", i, 0, None) for i in range(200)], OBS).drop("scan")
    later = spark.createDataFrame([observation(f"k{i}", 1, 1, f"p{i % 7}", i, 0, None) for i in range(50, 260)], OBS).drop("scan")
    plain = C.initial_load(C.latest_observation(first))
    state, master = K.keep(plain, "state", 4), K.keep(plain.select(*C.MASTER), "master", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert K.moved_sides(C.snapshot_diff(plain, later, "r", F.lit(T0))) > K.moved_sides(C.snapshot_diff(state, later, "r", F.lit(T0))) == 1
        out = K.update(state, master, later, "r", F.lit(T0), buckets=4)
        assert len(out["state"].inputFiles()) == 4  # one file a bucket, without dealing the state again
        assert K.moved_sides(C.snapshot_diff(out["state"], later, "r", F.lit(T0))) == 1
        assert K.moved_sides(out["master"]) <= 1  # the additions move, the master does not
        wanted = C.snapshot_diff(plain, later, "r", F.lit(T0))
        assert sorted(map(str, out["state"].select(*C.STATE).collect())) == sorted(map(str, C.next_state(wanted).select(*C.STATE).collect()))
        assert sorted(map(str, out["events"].drop("event_id").collect())) == sorted(map(str, C.change_events(wanted).collect()))
        assert {r["file_key"] for r in out["master"].collect()} == {f"k{i}" for i in range(200, 260)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
