"""Continuous change tracking.

Observations arrive as a stream; each micro-batch counts as one scan.  Keys are dealt over a fixed number of slots by their hash.  A
slot is one row of state, an array of its keys: what a call of the Python worker and a trip to the state store cost is paid per slot,
not per key.  A micro-batch is reduced to the latest observation of a key while its rows are read, so a key with very many rows costs
time, not memory.  A task holds one slot at a time and a slot is written whole, so slots should have some hundreds or thousands of keys.
With a time to live, a key not seen for that long (event time) is reported missing; seen again, it is restored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "keys array<struct<file_key: string, path: string, size: double, sha256: string, is_active: boolean, seen_us: bigint>>"
SLOTS = 1 << 14
COLUMNS = itemgetter(*(1 + k for k in range(5)))  # of a row behind its slot
EVENTS = ("file_key string, observed_us long, event_type string, path_changed boolean, content_changed boolean, "
          "active_state_changed boolean, previous_path string, path string, size double, late long")
Event = Row(*[field.split()[0] for field in EVENTS.split(", ")])


class ChangeProcessor(StatefulProcessor):
    """The keys of a slot with one state row; one read and at most one write of it per slot and micro-batch."""

    def __init__(self, ttl_seconds: int | None = None):
        self.ttl_ms = None if ttl_seconds is None else ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)

    def _known(self) -> dict:
        held = self.last.get()
        return {} if held is None else {row[0]: tuple(row)[1:] for row in held[0]}

    def _keep(self, known: dict) -> None:
        self.last.update(([(key, *row) for key, row in known.items()],))
        if self.ttl_ms is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = [row[4] // 1000 + self.ttl_ms for row in known.values() if row[3]]
        if ends:
            self.handle.registerTimer(min(ends))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._keep({row["file_key"]: tuple(row[c] for c in ("path", "size", "sha256", "is_active", "seen_us")) for row in initialState["keys"]})

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, newest, late = self._known(), {}, {}
        for name, micros, path, size, sha in map(COLUMNS, rows):
            previous = known.get(name)
            if previous is not None and micros < previous[4]:
                late[name] = late.get(name, 0) + 1  # older than what is known
                continue
            row = (micros, path, size, sha or "")
            best = newest.get(name)
            if best is None or row > best:
                newest[name] = row
        for name, count in late.items():
            path, size, _, _, micros = known[name]
            yield Event(name, micros, "late_rows", False, False, False, path, path, size, count)
        for name, (micros, path, size, sha) in newest.items():
            previous = known.get(name)
            event = _event(previous, path, size, sha or None)
            known[name] = (path, size, sha or (previous[2] if previous is not None else None), True, micros)
            if event:
                yield Event(name, micros, *event, previous[0] if previous is not None else None, path, size, 0)
        if newest:
            self._keep(known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The timer of a slot is that of its first key to end; others that have ended by now are not left to the next micro-batch."""
        known, now = self._known(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        for name, (path, size, sha, active, micros) in list(known.items()):
            end = micros // 1000 + self.ttl_ms
            if active and end <= now:
                known[name] = (path, size, sha, False, micros)
                yield Event(name, end * 1000, "missing_file", False, False, True, path, path, size, 0)
        self._keep(known)

    def close(self) -> None:
        pass


def _event(previous, path: str, size: float, sha: str | None):
    if previous is None:
        return "new_file", False, sha is not None, True
    moved = previous[0] != path
    changed = previous[1] != size or (sha is not None and previous[2] is not None and sha != previous[2])
    if not previous[3]:
        return "restored_file", moved, changed, True
    if moved and changed:
        return "path_and_content_changed", True, True, False
    if moved:
        return "path_changed", True, False, False
    return ("content_changed", False, True, False) if changed else None


def start_state(state: DataFrame) -> DataFrame:
    """The tracker's rows of a batch state (``initial_load``, ``next_state``)."""
    return state.select("file_key", "path", F.col("size").cast("double").alias("size"), "sha256", "is_active",
                        F.unix_micros(F.col("last_seen_at").cast("timestamp")).alias("seen_us"))


def tracked_state(spark, checkpoint: str) -> DataFrame:
    """``file_key, path, size, sha256, is_active, last_seen_at``: the state of a stopped stream, read from its checkpoint."""
    held = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    return held.select(F.explode("value.keys").alias("row")).select(
        "row.file_key", "row.path", "row.size", "row.sha256", "row.is_active", F.timestamp_micros("row.seen_us").alias("last_seen_at"))


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("file_key"), F.lit(slots)).cast("int").alias("slot")


def track_changes(observations: DataFrame, ttl_seconds: int | None = None, lateness: str | None = None, start: DataFrame | None = None,
                  slots: int = SLOTS) -> DataFrame:
    """Change events of a stream with ``file_key, path, size, sha256, observed_at``.

    ``start`` (see ``start_state``) is what the stream knows before its first row; its keys are no new files.  Rows older than what is
    known of their key change nothing and come out as one ``late_rows`` event a key and micro-batch, with their number in ``late``.

    With a time to live, ``lateness`` must say how far behind the newest row a row may come; Spark leaves out later ones.

    ``slots`` stays with a checkpoint: about one for every thousand keys that the state is expected to reach.

    The state store must be RocksDB (``shelfmark.session.ROCKSDB``), which keeps state off the heap.
    """
    typed = observations.select(
        F.col("file_key").cast("string").alias("file_key"), "path", F.col("size").cast("double").alias("size"),
        F.col("sha256").cast("string").alias("sha256"), F.col("observed_at").cast("timestamp").alias("observed_at"),
    )
    mode = "None"
    if ttl_seconds is not None:
        if lateness is None:
            raise ValueError("a time to live needs an explicit lateness")
        typed, mode = typed.withWatermark("observed_at", lateness), "EventTime"
    # Behind the slot in the order of COLUMNS; the time itself stays for the watermark.
    keyed = typed.select(_slot(slots), "file_key", F.unix_micros("observed_at").alias("observed_us"), "path", "size", "sha256", "observed_at")
    if start is not None:
        row = F.struct("file_key", "path", F.col("size").cast("double").alias("size"), "sha256", "is_active", "seen_us")
        start = start.groupBy(_slot(slots)).agg(F.collect_list(row).alias("keys")).groupBy("slot")
    events = keyed.groupBy("slot").transformWithState(
        ChangeProcessor(ttl_seconds), outputStructType=EVENTS, outputMode="Append", timeMode=mode, initialState=start,
    )
    return events.withColumn("observed_at", F.timestamp_micros("observed_us")).drop("observed_us")


def append_events(events: DataFrame, path: str, checkpoint: str):
    """Exactly-once event log: file sink with its own checkpoint, all available input, then stop."""
    return (
        events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
