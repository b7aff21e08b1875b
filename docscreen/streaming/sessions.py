"""Camera sessions in event time: blinks, liveness and the capture loop of each session, one state machine for all three.

Frames wait in the session's state, ordered by time, until the watermark says that nothing earlier is to come; then they
are folded in order, so any order of arrival within the delay gives what the batch queries give. Event-time timers
do the rest: they fold what waits, end a capture loop whose time is up though no frame comes any more, and
close a session that has been idle. Nothing depends on the clock of the machine.

Rows come out as events (``EVENT``):
  blink    ts of the frame at which the eyes open after enough closed frames
  live     ts of the first of them: the frame that is taken
  capture  how the capture loop ended (key, cancelled, auto, timeout), whether a picture was taken, and the frames looked at
  late     ts of a frame that came when later ones had been folded; it changes nothing
  closed   once a session is idle: whether and when a blink was seen, its frames, and the number of blinks in n

A session that goes on after it was closed is a new one. Frames without a time are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.face import CLOSED, LEAST_RUN, STABLE_FRAMES, TIMEOUT_S
from ..sources.packaging import ship
from ..sources.shared import shared_path

FRAME = "session_id long, ts timestamp, ear double, has_face boolean, key string"
EVENT = "session_id long, kind string, ts timestamp, frame long, ended_by string, captured boolean, n long"
#: A session is closed so long after its last frame.
IDLE_S = 3600.0


@dataclass
class Session:
    """What is known of a session; times in microseconds."""

    run: int = 0
    frames: int = 0
    start: int | None = None
    last: int | None = None
    blinks: int = 0
    first_blink: int | None = None
    ended: str | None = None


#: A frame in the state: ``unnamed`` if its session is null, NaN for no ear, the place of its key in KEYS.
FRAMES = np.dtype([("session", "<i8"), ("unnamed", "?"), ("ts", "<i8"), ("ear", "<f8"), ("has_face", "?"), ("key", "u1")])
KEYS = (None, " ", "q")
#: Sessions share the state of a bucket, as each call for a key costs milliseconds in Python; frames of a task that are packed at once.
BUCKETS, PACKED = 256, 200_000
#: A table's stream has twice the keys and two partitions of the state for each core, as few keys are dealt unevenly (43 of 256 to one of 8
#: partitions, where 32 are its share); more partitions for more than so many frames in each.
TABLE_BUCKETS, PARTITION_FRAMES = 512, 5_000_000


@dataclass(frozen=True)
class Rules:
    closed: float = CLOSED
    least: int = LEAST_RUN
    timeout: float = TIMEOUT_S
    stable: int = STABLE_FRAMES
    idle: float = IDLE_S

    @cached_property
    def timeout_micros(self) -> int:
        return round(self.timeout * 1_000_000)

    @cached_property
    def idle_micros(self) -> int:
        return round(self.idle * 1_000_000)

    def deadline(self, s: Session) -> int:
        return s.start + self.timeout_micros

    def idle_at(self, s: Session) -> int:
        return s.last + self.idle_micros

    def fold(self, s: Session, frame: tuple) -> Iterator[tuple]:
        """Take one frame (ts, ear, has_face, key) into the session; events as (kind, ts, frame, ended_by, captured, n)."""
        ts, ear, has_face, key = frame
        s.start, s.last = ts if s.start is None else s.start, ts
        if s.ended is None:
            # Time first, then keys, then the counter.
            if ts > self.deadline(s):
                yield self._end(s, "timeout", self.deadline(s))
            else:
                s.frames += 1
                if how := {" ": "key", "q": "cancelled"}.get(key, "auto" if s.frames > self.stable else None):
                    yield self._end(s, how, ts)
        if not has_face:
            return
        if ear is not None and ear < self.closed:
            s.run += 1
            return
        if ear is not None and s.run >= self.least:
            s.blinks += 1
            yield "blink", ts, None, None, None, None
            if s.first_blink is None:
                s.first_blink = ts
                yield "live", ts, None, None, True, None
        s.run = 0

    def _end(self, s: Session, how: str, ts: int | None) -> tuple:
        s.ended = how
        return "capture", ts, s.frames, how, how in ("key", "auto"), None

    def passed(self, s: Session, now: int) -> Iterator[tuple]:
        """What the watermark's arrival at ``now`` brings about, once all earlier frames are folded."""
        if s.ended is None and now > self.deadline(s):
            yield self._end(s, "timeout", self.deadline(s))


class Sessions(StatefulProcessor):
    """The sessions of a bucket; what is known of them is a text of JSON, frames that wait are bytes of FRAMES."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getValueState("sessions", "packed string")
        self.waiting = handle.getListState("waiting", "packed binary")
        self.folded: set[tuple] = set()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = _frames(p for t in rows for p in t.packed)
        known = self._known()
        late = _late(new, known)
        kept = new[~late]
        if len(kept):
            self.waiting.appendList([(kept.tobytes(),)])
            self._timer(int(kept["ts"].min()))  # one that is due already fires in this batch
        if late.any():
            yield self._out([(i, "late", ts, None, None, None, None) for i, ts in zip(_ids(new[late]), new["ts"][late].tolist())])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if key in self.folded:  # all that this watermark brings about was done by the bucket's first timer
            return
        self.folded.add(key)
        now, known, events = timerValues.getCurrentWatermarkInMs() * 1000, self._known(), []
        waiting = _frames(p for (p,) in self.waiting.get()) if self.waiting.exists() else np.empty(0, FRAMES)
        due, left = waiting[waiting["ts"] < now], waiting[waiting["ts"] >= now]
        due, held = due[np.lexsort((due["ts"], due["session"], due["unnamed"]))], set(_ids(left))
        new, idle = np.ones(len(due), bool), self.rules.idle_micros
        new[1:] = (due["session"][1:] != due["session"][:-1]) | (due["unnamed"][1:] != due["unnamed"][:-1])
        first, columns = np.flatnonzero(new), [due[c].tolist() for c in ("ts", "ear", "has_face", "key")]
        for i, a, e in zip(_ids(due[first]), first.tolist(), [*first[1:].tolist(), len(due)]):
            s = known.get(i)
            for ts, ear, has_face, pressed in zip(*(c[a:e] for c in columns)):
                # A pause that is long enough closes the session before its next frame.
                if s is not None and ts > s.last + idle:
                    self._close(i, s, events)
                    s = None
                if s is None:
                    s = known[i] = Session()
                for event in self.rules.fold(s, (ts, None if ear != ear else ear, has_face, KEYS[pressed])):
                    events.append((i, *event))
        for i, s in list(known.items()):
            events += [(i, *e) for e in self.rules.passed(s, now)]
            if now > self.rules.idle_at(s) and i not in held:
                self._close(i, s, events)
                del known[i]
        if len(due):
            self.waiting.clear()
            if len(left):
                self.waiting.put([(left.tobytes(),)])
        if known:
            self.sessions.update((json.dumps([(i, *vars(s).values()) for i, s in known.items()]),))
        else:
            self.sessions.clear()
        # The next frame of a session that has frames waiting closes it, if need be.
        times = [int(left["ts"].min())] if len(left) else []
        times += [self.rules.deadline(s) for s in known.values() if s.ended is None] + [self.rules.idle_at(s) for i, s in known.items() if i not in held]
        if times:
            self._timer(min(times))
        if events:
            yield self._out(events)

    def _close(self, i: int | None, s: Session, events: list) -> None:
        events += [(i, *e) for e in self.rules.passed(s, self.rules.idle_at(s) + 1)]
        if s.ended is None:
            events.append((i, *self.rules._end(s, "stream_end", None)))
        events.append((i, "closed", s.first_blink, s.frames, s.ended, s.first_blink is not None, s.blinks))

    def _known(self) -> dict[int | None, Session]:
        return {i: Session(*s) for i, *s in json.loads(self.sessions.get()[0])} if self.sessions.exists() else {}

    def _timer(self, micros: int) -> None:
        self.handle.registerTimer(micros // 1000)

    def _out(self, events: list) -> pd.DataFrame:
        columns = dict(zip(("session_id", "kind", "ts", "frame", "ended_by", "captured", "n"), zip(*events)))
        whole = {k: pd.array(columns[k], dtype="Int64") for k in ("session_id", "ts", "frame", "n")}
        return pd.DataFrame({
            "session_id": whole["session_id"], "kind": pd.Series(columns["kind"], dtype=object), "ts": pd.to_datetime(whole["ts"], unit="us"), "frame": whole["frame"],
            "ended_by": pd.Series(columns["ended_by"], dtype=object), "captured": pd.array(columns["captured"], dtype="boolean"), "n": whole["n"],
        })

    def close(self) -> None:
        pass


def _frames(packed: Iterator[bytes]) -> np.ndarray:
    return np.concatenate([np.empty(0, FRAMES), *(np.frombuffer(p, FRAMES) for p in packed)])


def _ids(frames: np.ndarray) -> list[int | None]:
    return [None if unnamed else i for i, unnamed in zip(frames["session"].tolist(), frames["unnamed"].tolist())]


def _late(frames: np.ndarray, known: dict[int | None, Session]) -> np.ndarray:
    """Which frames come when later ones of their session have been folded."""
    late = np.zeros(len(frames), bool)
    last = np.array(sorted((i, s.last) for i, s in known.items() if i is not None), np.int64).reshape(-1, 2)
    if len(last):
        at = np.minimum(np.searchsorted(last[:, 0], frames["session"]), len(last) - 1)
        late = ~frames["unnamed"] & (last[at, 0] == frames["session"]) & (last[at, 1] > frames["ts"])
    if None in known:
        late |= frames["unnamed"] & (known[None].last > frames["ts"])
    return late


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames with their bucket as one row for each bucket and PACKED frames of a task."""

    def flush() -> pa.RecordBatch:
        frames, buckets = np.concatenate([f for f, _ in held]), np.concatenate([b for _, b in held])
        order = np.argsort(buckets, kind="stable")
        found, starts = np.unique(buckets[order], return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([f.tobytes() for f in np.split(frames[order], starts[1:])], pa.binary())], ["bucket", "packed"])

    held: list[tuple] = []
    for b in batches:
        f, (session, ts, ear, has_face, key) = np.empty(b.num_rows, FRAMES), (b.column(c) for c in ("session_id", "ts", "ear", "has_face", "key"))
        f["session"], f["unnamed"] = pc.fill_null(session, 0).to_numpy(zero_copy_only=False), pc.is_null(session).to_numpy(zero_copy_only=False)
        f["ts"], f["ear"] = ts.cast(pa.int64()).to_numpy(zero_copy_only=False), pc.fill_null(ear, float("nan")).to_numpy(zero_copy_only=False)
        f["has_face"], f["key"] = pc.fill_null(has_face, False).to_numpy(zero_copy_only=False), 0
        for k, pressed in enumerate(KEYS[1:], 1):
            f["key"][pc.fill_null(pc.equal(key, pressed), False).to_numpy(zero_copy_only=False)] = k
        held.append((f, b.column("bucket").to_numpy(zero_copy_only=False)))
        if sum(len(f) for f, _ in held) >= PACKED:
            yield flush()
            held = []
    if held:
        yield flush()


def session_events(frames: DataFrame, delay: str = "10 seconds", rules: Rules = Rules(), buckets: int = BUCKETS) -> DataFrame:
    """Events of a stream of frames (session_id, ts, ear, has_face, key).

    delay: how far behind the latest frame of all sessions a frame may come. Frames that are later still are folded too if
    their session has not got past them, else they are events of kind late. Needs the RocksDB state store.
    buckets: keys of the state, over which sessions are dealt by a hash; a checkpoint needs the number it was begun with.
    Each of spark.sql.shuffle.partitions, as set when the query first starts, costs a commit of its state store in each batch: few are best.
    """
    spark = frames.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # The watermark is that of a copy: Spark would drop rows behind it unseen, and here they are to be counted.
    timed = frames.where("ts is not null").withColumn("seen_at", F.col("ts")).withWatermark("seen_at", delay).select("session_id", "ts", "ear", "has_face", "key")
    # A bucket is never null: pandas makes floats of whole numbers beside a null, and all keys of such a batch would share one state.
    packed = timed.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")).mapInArrow(_pack, "bucket int, packed binary")
    return packed.groupBy("bucket").transformWithStateInPandas(Sessions(rules), EVENT, "Append", "EventTime")


def _partitions(most: int, cores: int, frames: int, buckets: int) -> int:
    """Of the state of a table's stream: what a batch pays for each doesn't depend on what it holds, so two for each core unless there are many frames."""
    return min(most, buckets, max(2 * cores, -(-frames // PARTITION_FRAMES)))


def run_table(spark: SparkSession, frames: DataFrame, delay: str = "10 seconds", rules: Rules = Rules(), batches: int = 6) -> DataFrame:
    """Run a table of frames through the stream to its end; the sink's rows.

    Frames arrive by the column ``arrival`` (below ``batches``) if there is one, else at once. A last frame of a session of its own (null),
    far ahead of all others, brings the watermark past them.
    """
    base = shared_path(spark, "sessions")
    if "arrival" not in frames.columns:
        frames = frames.withColumn("arrival", F.lit(0))
    kept = frames.select("session_id", "ts", "ear", "has_face", "key", "arrival")
    # Files are taken in order of their time, as many for a micro-batch as one arrival has at most.
    files = max(1, kept.rdd.getNumPartitions())
    for k in range(batches):
        kept.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(f"{base}/in")
    ahead = F.expr(f"INTERVAL {delay}") + F.make_dt_interval(secs=F.lit(2 * rules.idle + rules.timeout + 1))
    written = spark.read.schema(FRAME).parquet(f"{base}/in")
    partitions = _partitions(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, written.count(), TABLE_BUCKETS)
    end = written.agg((F.max("ts") + ahead).alias("ts")).select(F.lit(None).cast("long").alias("session_id"), "ts", F.lit(None).cast("double").alias("ear"), F.lit(False).alias("has_face"), F.lit(None).cast("string").alias("key"))
    end.where("ts is not null").coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    writer = session_events(stream, delay, rules, TABLE_BUCKETS).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)  # a query keeps what is set when it starts
    try:
        query = writer.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    query.awaitTermination()
    return spark.read.schema(EVENT).parquet(f"{base}/out").where("session_id is not null")
