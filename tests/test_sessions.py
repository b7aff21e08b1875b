"""Camera sessions in event time: the state machine against the batch queries, and the stream with late frames and timers."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from docscreen.operators import face
from docscreen.sources import shared
from docscreen.streaming.sessions import EVENT, FRAME, FRAMES, PARTITION_FRAMES, Rules, Session, Sessions, _late, _pack, _partitions, run_table, session_events

T0 = datetime(2024, 5, 1, tzinfo=timezone.utc)
RULES = Rules(timeout=15.0, stable=20, idle=60.0)


def frames_of(session, n, seed, gap=0.5):
    r, t, out = random.Random(seed), 0.0, []
    for _ in range(n):
        t += gap * r.random() * 2
        out.append((session, T0 + timedelta(seconds=round(t, 3)), r.choice([0.1, 0.2, 0.22, 0.3]), r.random() > 0.1, r.choice([None] * 80 + [" ", "q"])))
    return out


def folded(frames):
    s, events = Session(), []
    for _, ts, ear, has_face, key in frames:
        events += RULES.fold(s, (round(ts.timestamp() * 1e6), ear, has_face, key))
    return s, events


def test_fold_equals_batch(spark):
    rows = [f for k in range(40) for f in frames_of(k, 2 + 3 * max(0, k - 8), k, 0.5 + k % 3)]
    df = spark.createDataFrame(rows, FRAME)
    blinks = {(r.session_id, r.ts) for r in face.blinks(df).collect()}
    ends = {r.session_id: (r.ended_by, r.captured, r.frame) for r in face.auto_capture(df, RULES.timeout, RULES.stable).collect()}
    seen, kinds = set(), set()
    for k in range(40):
        mine = [f for f in rows if f[0] == k]
        s, events = folded(mine)
        at = {round(f[1].timestamp() * 1e6): f[1].replace(tzinfo=None) for f in mine}
        seen |= {(k, at[e[1]]) for e in events if e[0] == "blink"}
        assert sum(e[0] == "live" for e in events) == (s.blinks > 0)
        end = next((e for e in events if e[0] == "capture"), None)
        # The batch query counts the frame that came too late; the loop hasn't looked at it.
        got = ("stream_end", False, None) if end is None else (end[3], end[4], end[2] + (end[3] == "timeout"))
        assert got == ends[k], k
        kinds.add(got[0])
    assert seen == blinks and kinds == {"stream_end", "timeout", "key", "cancelled", "auto"}


def at(s, ear=0.3, key=None, session=1, has_face=True):
    return session, T0 + timedelta(seconds=s), ear, has_face, key


def test_stream_with_late_frames_and_timers(spark, tmp_path):
    """Each list is a micro-batch; the delay is ten seconds."""
    batches = [
        [at(1, 0.1), at(3), at(0)],
        [at(2, 0.1), at(30, session=2)],  # in time: the watermark was 0, so the run of 1 and 2 is whole
        [at(25, session=2)],  # folds session 1 up to 20
        [at(1.5, 0.1), at(45, session=2)],  # late for session 1, which has got to 3
        [at(500, session=3)],  # ends what waits in 2; closes 1 and 2
        [at(600, None, session=2, key="q"), at(1000, session=3)],  # 2 begins anew
        [(None, T0 + timedelta(seconds=5000), None, False, None)],
    ]
    query = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, FRAME).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k in (3, len(batches) - 1):  # stopped in between, and started again from its checkpoint
            stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            query = session_events(stream, "10 seconds", RULES).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    events = [(r.session_id, r.kind, None if r.ts is None else (r.ts - T0.replace(tzinfo=None)).total_seconds(), r.frame, r.ended_by, r.captured, r.n) for r in spark.read.schema(EVENT).parquet(f"{tmp_path}/out").collect()]
    want = [
        (1, "blink", 3.0, None, None, None, None), (1, "live", 3.0, None, None, True, None), (1, "late", 1.5, None, None, None, None),
        (1, "capture", 15.0, 4, "timeout", False, None), (1, "closed", 3.0, 4, "timeout", True, 1),
        (2, "capture", 40.0, 2, "timeout", False, None), (2, "closed", None, 2, "timeout", False, 0), (2, "capture", 600.0, 1, "cancelled", False, None), (2, "closed", None, 1, "cancelled", False, 0),
        (3, "capture", 515.0, 1, "timeout", False, None), (3, "closed", None, 1, "timeout", False, 0), (3, "capture", 1015.0, 1, "timeout", False, None), (3, "closed", None, 1, "timeout", False, 0),
    ]
    assert sorted(map(str, events)) == sorted(map(str, want))


def test_table_out_of_order_equals_batch(spark):
    rows = [f for k in range(6) for f in frames_of(k, 40, 100 + k)]
    r = random.Random(1)
    df = spark.createDataFrame([(*f, min(2, int((f[1] - T0).total_seconds() // 15) + r.randrange(2))) for f in rows], f"{FRAME}, arrival int")
    events = run_table(spark, df, "40 seconds", RULES, 3)
    assert {(e.session_id, e.ts) for e in events.where("kind = 'blink'").collect()} == {tuple(b) for b in face.blinks(df).collect()}
    assert {(e.session_id, e.captured, e.ts) for e in events.where("kind = 'closed'").collect()} == {tuple(x) for x in face.liveness(df).collect()}
    assert run_table(spark, df.limit(0), "1 second", RULES, 1).count() == 0


def test_a_null_session_among_others_keeps_states_apart(spark):
    """The last, null session comes in one batch with the frames, and in one partition with all sessions."""
    rows = [f for k in range(30) for f in frames_of(k + k % 2 * 2**53, 40, 200 + k)]
    df = spark.createDataFrame(rows, FRAME).coalesce(1).union(spark.createDataFrame([], FRAME)).withColumn("arrival", F.lit(0))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        events = run_table(spark, df, "1 day", RULES, 1)
        got = {(e.session_id, e.captured, e.ts) for e in events.where("kind = 'closed'").collect()}, {(e.session_id, e.ts) for e in events.where("kind = 'blink'").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert got == ({tuple(x) for x in face.liveness(df).collect()}, {tuple(b) for b in face.blinks(df).collect()})


class Calls:
    """Stands for a state and its handle, and counts what is asked of them."""

    def __init__(self):
        self.n, self.values = Counter(), []

    def getValueState(self, *_):
        return Calls()

    getListState = getValueState

    def registerTimer(self, _):
        self.n["timer"] += 1

    def exists(self):
        self.n["exists"] += 1
        return bool(self.values)

    def get(self):
        self.n["get"] += 1
        return self.values

    def appendList(self, rows):
        self.n["append"] += 1
        self.values += rows

    def put(self, rows):
        self.n["put"] += 1
        self.values = list(rows)

    def update(self, row):
        self.n["update"] += 1
        self.values = row

    def clear(self):
        self.n["clear"] += 1
        self.values = []

    def getCurrentWatermarkInMs(self):
        return self.now


def test_sessions_of_a_bucket_share_their_calls():
    """Each call goes to the JVM and back; their number doesn't grow with the sessions, of which one is null."""
    mine = {k: list({f[1]: f for f in frames_of(k, 12, 300 + (k or 0))}.values()) for k in [None, *range(2**53, 2**53 + 200)]}  # no ties, as they come in any order
    rows = [f for frames in mine.values() for f in frames]
    random.Random(5).shuffle(rows)
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.timestamp("us", "UTC"), pa.float64(), pa.bool_(), pa.string()))]
    batch = pa.RecordBatch.from_arrays([*columns, pa.array([0] * len(rows), pa.int32())], ["session_id", "ts", "ear", "has_face", "key", "bucket"])
    packed = [b.to_pandas() for b in _pack(iter([batch]))]
    assert sum(map(len, packed)) == 1
    sessions, handle, times = Sessions(RULES), Calls(), Calls()
    sessions.init(handle)
    assert not list(sessions.handleInputRows((0,), iter(packed), times))
    seen = set()
    for seconds in (4, 4, 8, 1000):
        sessions.folded.clear()
        times.now = round((T0.timestamp() + seconds) * 1000)
        for out in sessions.handleExpiredTimer((0,), times, None):
            seen |= {(None if pd.isna(r.session_id) else r.session_id, r.kind, r.ts) for r in out.itertuples() if r.kind in ("blink", "closed")}
    want = {(k, "blink", pd.Timestamp(e[1], unit="us")) for k, frames in mine.items() for e in folded(frames)[1] if e[0] == "blink"}
    assert {e for e in seen if e[1] == "blink"} == want and {e[0] for e in seen if e[1] == "closed"} == set(mine)
    assert sum(sum(c.n.values()) for c in (handle, sessions.sessions, sessions.waiting)) < 40


def test_a_table_is_run_with_few_state_partitions(spark, monkeypatch):
    """Each partition commits its state in each batch, so that 200 of them cost more than the frames; the session's own setting stays."""
    df = spark.createDataFrame([f for k in range(20) for f in frames_of(k, 30, 400 + k)], FRAME)
    paths, partitions = [], spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr("docscreen.streaming.sessions.shared_path", lambda *a: paths.append(shared.shared_path(*a)) or paths[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        events = run_table(spark, df, "1 day", RULES, 1)
        got = {(e.session_id, e.ts) for e in events.where("kind = 'blink'").collect()}
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    at, fs = shared._hadoop(spark, f"{paths[0]}/state/state/0")
    assert sum(x.getPath().getName().isdigit() for x in fs.listStatus(at)) == 2 * spark.sparkContext.defaultParallelism
    assert got == {(e.session_id, e.ts) for e in face.blinks(df).collect()}
    # One where the session has one; more than two for each core for many frames; never more than keys.
    assert [_partitions(most, 8, frames, 256) for most, frames in ((1, 10**9), (200, 10), (200, 20 * PARTITION_FRAMES), (1000, 10**12))] == [1, 16, 20, 256]


def test_late_frames_of_a_bucket():
    frames = np.zeros(6, FRAMES)
    frames["session"], frames["unnamed"], frames["ts"] = [7, 7, 8, 0, 0, 2**53 + 1], [False, False, False, True, False, False], [4, 5, 0, 2, 2, 1]
    known = {7: Session(last=5), None: Session(last=3), 2**53 + 1: Session(last=2), 2**53: Session(last=0)}
    assert _late(frames, known).tolist() == [True, False, False, True, False, True]
    assert not _late(frames, {}).any() and _late(frames, {None: known[None]}).tolist() == [False, False, False, True, False, False]
