"""Requests from streams of events: trailing timers, late and repeated changes, one run at a time, busy files, replays."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from rungline.streaming import refresh

START = datetime.datetime(2024, 1, 1)


def at(ms):
    return START + datetime.timedelta(milliseconds=ms)


@pytest.fixture
def store(spark):
    name, value = refresh.STORE
    old = spark.conf.get(name)
    spark.conf.set(name, value)
    yield
    spark.conf.set(name, old)


def play(spark, folder, batches, **how):
    """The requests of batches of (file, ms, kind), each a file that the stream reads as one batch."""
    src = f"{folder}/events"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(f, at(ms), k) for f, ms, k in rows], refresh.EVENTS).coalesce(1).write.mode("append").parquet(f"{src}/b{i:03d}")
    stream = spark.readStream.schema(refresh.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    out = refresh.requests(stream, **how)
    done = f"{folder}/requests"
    q = out.writeStream.foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(done)).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    zero = spark.createDataFrame([(START,)], "t timestamp").select(F.unix_millis("t")).first()[0]
    return [(r.file, r.due_ms - zero, r.action, r.changes) for r in spark.read.parquet(done).orderBy("batch", "due_ms", "file").collect()]


def test_bursts_runs_and_busy_files(spark, store, tmp_path):
    tick = lambda ms: [("clock", ms, "done")]
    batches = [
        [("a", 100, "changed"), ("a", 300, "changed"), ("b", 200, "changed"), (None, 1, "changed"), ("a", 150, "saved")],
        [("a", 250, "changed"), ("a", 250, "changed")],  # late and repeated: the timer stays at 700
        tick(5000),  # both are due
        [("a", 6000, "changed"), ("b", 6100, "busy")],
        tick(12000),  # a waits for its run, b is tried again
        [("a", 13000, "done"), ("b", 13000, "busy")],  # a's next run starts at once, b gives up
        [("a", 14000, "done"), ("a", 14050, "done")],
        tick(30000),
    ]
    got = play(spark, tmp_path, batches, tries=2)
    assert [g for g in got if g[0] == "a"] == [("a", 700, "run", 4), ("a", 6400, "joined", 1), ("a", 13000, "run", 1)]
    assert [g for g in got if g[0] == "b"] == [("b", 600, "run", 1), ("b", 8100, "run", 1), ("b", 13000, "failed", 1)]
    assert {g[0] for g in got} == {"a", "b"}


def test_polls_and_edits_are_events(spark):
    health = spark.createDataFrame([("p1", "ok"), ("p2", "stale"), ("p3", "missing")], "project string, state string")
    assert {(r.file, r.ts, r.kind) for r in refresh.stale_events(health, F.lit(START)).collect()} == {("p2", START, "changed"), ("p3", START, "changed")}
    files = spark.createDataFrame([("/x/p1/Programs/A/M.rll", START), ("/x/p1/in/p2/a.st", START), ("/y/z.rll", START), ("/x/p1/notes.md", START), ("M.rll", START)], "path string, ts timestamp")
    exports = spark.createDataFrame([("/x/p1", "one"), ("/x/p1/in/p2", "two")], "folder string, project string")
    assert sorted(r.file for r in refresh.project_of(files, exports).collect()) == ["one", "two"]
