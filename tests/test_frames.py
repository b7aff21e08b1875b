"""Frame files as a stream that starts again where it stopped."""

import time
from collections import Counter

import pytest

from docscreen.sources import frames


def put(folder, session, micros, data=b"x"):
    at = folder / str(session)
    at.mkdir(parents=True, exist_ok=True)
    (at / f"{micros}.jpg").write_bytes(data)


def test_stretches_keep_the_order_of_time():
    files = [(9, 2, 5, 40, "e"), (1, 1, 30, 40, "c"), (2, 1, 10, 40, "a"), (3, 1, 20, 40, "b"), (4, 2, 1, 400, "d")]
    assert [[p for p, _, _ in s.frames] for s in frames.planned(files, 100)] == [["a", "b"], ["c"], ["d"], ["e"]]
    assert frames.planned([], 100) == []


def test_restart_loses_and_repeats_no_frame(spark, tmp_path):
    frames.register(spark)
    folder, out = tmp_path / "in", tmp_path / "out"
    for k in range(6):
        put(folder, k % 2, 1_000_000 * (10 - k), b"%d" % k)
    (folder / "0" / "notes.txt").write_text("not a frame")
    stops = []

    def write(df, number):
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == 1 and not stops:
            stops.append(number)
            raise KeyError("stopped before the commit")

    def run():
        time.sleep(0.3)
        stream = spark.readStream.format("frames").option("path", str(folder)).option("settle", "0.1").option("partition_bytes", "2").load()
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run()
    for k in range(6, 9):
        put(folder, 7, k, b"%d" % k)
    with pytest.raises(Exception, match="stopped before the commit"):
        run()
    put(folder, 7, 9, b"9")  # comes while the query is down
    run()
    rows = spark.read.parquet(str(out)).collect()
    assert Counter(bytes(r.content) for r in rows) == Counter(b"%d" % k for k in range(10)) and stops == [1]
    assert {(r.session_id, r.ts.second) for r in rows if r.batch == 0} == {(k % 2, 10 - k) for k in range(6)}
    batch = spark.read.format("frames").option("path", str(folder)).load()
    assert batch.count() == 10 and spark.read.format("frames").option("path", f"{tmp_path}/none").load().count() == 0
