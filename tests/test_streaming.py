import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loomwell.operators import versions
from loomwell.plans import tables as t
from loomwell.streaming import progress as p
from loomwell.streaming import recovery, timers


def test_stream_equals_batch(spark, tmp_path):
    events = t.progress(spark, "/root/testdata/sf0.001").filter(F.col("task_id").cast("int") < 40)
    n = events.agg(F.max("ord")).first()[0]
    for i in range(3):  # three files in order: three batches
        events.filter((F.col("ord") > n * i // 3 - (i == 0)) & (F.col("ord") <= n * (i + 1) // 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = p.reduce_stream(stream).writeStream.outputMode("update").format("memory").queryName("reduced").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        end = time.time() + 120  # idle batches go on, for the timeouts' sake
        while sum(b["numInputRows"] for b in q.recentProgress) < events.count() and q.isActive and time.time() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    got = {}
    for r in spark.sql("SELECT * FROM reduced").collect():
        if r.task_id not in got or r.n_events >= got[r.task_id].n_events:
            got[r.task_id] = r
    assert {k: tuple(r) for k, r in got.items()} == {r.task_id: tuple(r) for r in p.reduce_batch(events).collect()}


def test_events_after_the_end_are_ignored(spark):
    rows = [("a", 1, "connected", None), ("a", 2, "progress", 3), ("a", 3, "complete", 4), ("a", 4, "complete", 9), ("a", 5, "error", None)]
    e = spark.createDataFrame([(k, o, ty, s, 10, s, 0, "u", None) for k, o, ty, s in rows], p.EVENT)
    r = p.reduce_batch(e).first()
    assert (r.status, r.progress, r.success, r.n_events) == ("completed", 100, 4, 3)


def test_json_events(spark):
    raw = spark.createDataFrame([('{"task_id":"a","ord":1,"type":"progress","data":{"current":1,"total":3}}',), ("bad",)], "value string")
    assert [(r.task_id, r.current, r.total) for r in p.parsed(raw).collect()] == [("a", 1, 3), (None, None, None)]


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_timers_fire_without_later_events(spark, tmp_path):
    """An idle task gets heartbeats, then expires; an ended one keeps its end."""
    rows = [("a", 1, "connected", None, None), ("a", 2, "progress", 3, 10), ("b", 1, "complete", None, None)]
    events = spark.createDataFrame([(k, o, ty, c, n, None, None, "u", None) for k, o, ty, c, n in rows], p.EVENT)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        q = timers.timed(stream, heartbeat_seconds=3, idle_seconds=30).writeStream.outputMode("update").format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
        end, got = time.time() + 120, []
        while time.time() < end and q.isActive and sum(r.kind == "expired" for r in got) < 2:
            time.sleep(1)
            got = spark.sql("SELECT * FROM timed").collect()
        q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    for task, status in (("a", "running"), ("b", "completed")):
        mine = sorted((r.at_ms, r.kind, r.status, r.n_events) for r in got if r.task_id == task)
        assert mine[0][1] == "update" and mine[-1][1] == "expired" and len(mine) >= 3 and {m[1] for m in mine[1:-1]} == {"heartbeat"}
        assert {m[2] for m in mine} == {status} and {m[3] for m in mine} == {2 if task == "a" else 1}
        assert mine[-1][0] - mine[0][0] >= 30000


def test_recovery_from_the_checkpoint(spark, tmp_path):
    """A batch is stored, its end isn't noted, and the stream starts again: equal to the batch twin, no batch twice."""
    events = t.progress(spark, "/root/testdata/sf0.001").filter(F.col("task_id").cast("int") < 30)
    n = events.agg(F.max("ord")).first()[0]
    for i in range(3):
        events.filter((F.col("ord") > n * i // 3 - (i == 0)) & (F.col("ord") <= n * (i + 1) // 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path, checkpoint, calls = str(tmp_path / "store"), str(tmp_path / "c"), []

    def run(fail_at=None):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

        def after(df, number):
            calls.append(number)
            if number == fail_at:
                raise RuntimeError("killed")

        q = recovery.write_latest(p.reduce_stream(stream), path, ["task_id"], [F.col("n_events")], checkpoint, "tasks", after)
        try:
            end = time.time() + 120  # batches without data go on, for the timeouts' sake
            while q.isActive and len(versions.current(spark, path).segments) < 3 and time.time() < end:
                time.sleep(0.5)
            if not q.isActive:
                q.awaitTermination(1)
        finally:
            q.stop()

    with pytest.raises(StreamingQueryException):
        run(fail_at=1)
    run()
    assert calls.count(1) == 2 and [s["batch"] for s in versions.current(spark, path).segments] == ["tasks:0", "tasks:1", "tasks:2"]
    got = {r.task_id: tuple(r) for r in recovery.latest(spark, path, ["task_id"], p.STATE).collect()}
    assert got == {r.task_id: tuple(r) for r in p.reduce_batch(events).collect()}
    assert recovery.put_batch(spark.createDataFrame([], p.STATE), path, ["task_id"], [F.col("n_events")], "other") is False
