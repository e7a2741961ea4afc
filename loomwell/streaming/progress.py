"""Progress events of tasks: a batch reducer, and the same as a stateful stream.

Defined cases: null counts keep the value before; events of a task are told apart by ``ord``;
a task without events has no row; events without a task are the null task's; unknown types
count as events and change nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENT = "task_id string, ord long, type string, current long, total long, success long, failed long, url string, message string"
STATE = "task_id string, status string, progress long, success long, failed long, url string, message string, n_events long"
TERMINAL = ("final", "complete", "error")


def parsed(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines {task_id, ord, type, data{...}} as events."""
    data = "current long, total long, success long, failed long, url string, message string"
    e = F.from_json(column, f"task_id string, ord long, type string, data struct<{data.replace(' long', ':long').replace(' string', ':string')}>")
    return raw.select(e.alias("e")).select("e.task_id", "e.ord", "e.type", "e.data.*")


def percent(current: Column, total: Column) -> Column:
    """Rounded half up; 0 where the total is 0 or unknown."""
    return F.when(total > 0, F.floor(current * 100 / total + 0.5)).otherwise(0).cast("long")


def reduce_batch(events: DataFrame) -> DataFrame:
    """One row for each task: what a client shows after all its events in order.

    The first terminal event ends a task; what follows is ignored. Success and
    failed counts, url and message keep their last value that isn't null (url
    and message: nor blank).
    """
    order = F.col("ord")
    first_end = F.min(F.when(F.col("type").isin(*TERMINAL), order))
    ends = events.groupBy("task_id").agg(first_end.alias("end"))
    live = events.join(ends, "task_id").filter(F.col("end").isNull() | (order <= F.col("end")))
    last = lambda value, where=None: F.max_by(value, F.when(value.isNotNull() if where is None else value.isNotNull() & where, order))
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    working = F.col("type") == "progress"
    counted = F.col("type").isin("progress", "final", "complete")
    message = F.when(working, F.coalesce(text("message"), F.concat(F.lit("진행 중: "), F.col("current").cast("string"), F.lit("/"), F.col("total").cast("string"))))
    message = message.when(F.col("type") == "connected", "연결됨").when(F.col("type") == "error", F.concat(F.lit("오류: "), F.coalesce("message", F.lit("")))).when(F.col("type").isin("final", "complete"), F.coalesce(text("message"), F.lit("완료"))).when(F.col("type") == "status", text("message"))
    out = live.groupBy("task_id").agg(
        F.max_by("type", order).alias("last_type"), last(percent(F.col("current"), F.col("total")), working).alias("p"),
        last(F.when(counted, F.col("success"))).alias("success"), last(F.when(counted, F.col("failed"))).alias("failed"),
        last(F.when(working, text("url"))).alias("url"), last(message).alias("message"), F.count(F.lit(1)).alias("n_events"),
    )
    status = F.when(F.col("last_type").isin("final", "complete"), "completed").when(F.col("last_type") == "error", "failed").otherwise("running")
    done = F.col("last_type").isin("final", "complete")
    return out.select("task_id", status.alias("status"), F.when(done, F.lit(100).cast("long")).otherwise(F.coalesce("p", F.lit(0).cast("long"))).alias("progress"), F.coalesce("success", F.lit(0).cast("long")).alias("success"), F.coalesce("failed", F.lit(0).cast("long")).alias("failed"), "url", "message", "n_events")


def _step(state: dict, e: dict) -> dict:
    """One event applied to a task's state; nothing after the end."""
    if state["status"] != "running":
        return state
    s = dict(state, n_events=state["n_events"] + 1)
    if e["type"] == "connected":
        s["message"] = "연결됨"
    elif e["type"] == "status":
        s["message"] = e["message"] or s["message"]
    elif e["type"] in ("progress", "final", "complete"):
        s["success"] = s["success"] if e["success"] is None else e["success"]
        s["failed"] = s["failed"] if e["failed"] is None else e["failed"]
        if e["type"] == "progress":
            total = e["total"] or 0
            s["progress"] = (2 * (e["current"] or 0) * 100 + total) // (2 * total) if total > 0 else 0
            s["url"] = e["url"] or s["url"]
            s["message"] = e["message"] or f"진행 중: {e['current']}/{e['total']}"
        else:
            s |= {"status": "completed", "progress": 100, "message": e["message"] or "완료"}
    elif e["type"] == "error":
        s |= {"status": "failed", "message": f"오류: {e['message'] or ''}"}
    return s


_NAMES = ("status", "progress", "success", "failed", "url", "message", "n_events")


def reduce_stream(events: DataFrame, idle_seconds: int = 300) -> DataFrame:
    """The same reduction over a stream: a task's state after each batch that has events of it.

    State goes ``idle_seconds`` after a task's last event. Events of a task have
    to come in order between batches; inside a batch ``ord`` orders them.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = dict(zip(_NAMES, state.get, strict=True)) if state.exists else {"status": "running", "progress": 0, "success": 0, "failed": 0, "url": None, "message": None, "n_events": 0}
        rows = pd.concat(list(batches)).sort_values("ord")
        for e in rows.to_dict("records"):  # pandas turns null numbers into NaN, and the rest of their column into floats
            s = _step(s, {k: None if pd.isna(v) else int(v) if isinstance(v, float) else v for k, v in e.items()})
        state.update(tuple(s[n] for n in _NAMES))
        state.setTimeoutDuration(idle_seconds * 1000)
        yield pd.DataFrame([{"task_id": key[0], **s}])

    return events.groupBy("task_id").applyInPandasWithState(update, STATE, STATE.split(", ", 1)[1], "update", "ProcessingTimeTimeout")


def throttled(events: DataFrame, every: int = 10) -> DataFrame:
    """Progress events at every tenth step and the last."""
    return events.filter((F.col("type") == "progress") & ((F.col("current") % every == 0) | (F.col("current") == F.col("total"))))


def task_history(tasks: DataFrame, keep: int = 10) -> DataFrame:
    """The tasks completed last, one row each: the first row of an id counts."""
    one = tasks.groupBy("task_id").agg(F.min("completed_at").alias("completed_at"))
    return one.orderBy(F.col("completed_at").desc(), "task_id").limit(keep)


def assembled(deltas: DataFrame) -> DataFrame:
    """(call_id, name, arguments): streamed tool calls put together in order."""
    parts = F.sort_array(F.collect_list(F.struct("ord", "delta")))
    return deltas.groupBy("call_id").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("ord"))).alias("name"), F.array_join(F.transform(parts, lambda p: p["delta"]), "").alias("arguments"))


def with_gap(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Seconds since the key's event before: where a heartbeat would have come."""
    w = Window.partitionBy(*keys).orderBy(at)
    return events.withColumn("gap_s", F.col(at).cast("long") - F.lag(F.col(at).cast("long")).over(w))


def throttled_by_time(events: DataFrame, keys: list[str], at: str, seconds: float = 2.0) -> DataFrame:
    """Of each key's events the first in every stretch of so many seconds since the key's own first, and the last."""
    w = Window.partitionBy(*keys)
    since = F.col(at).cast("double") - F.min(F.col(at).cast("double")).over(w)
    stretch = events.withColumn("__stretch", F.floor(since / seconds)).withColumn("__last", F.max(at).over(w))
    place = F.row_number().over(Window.partitionBy(*keys, "__stretch").orderBy(at))
    return stretch.withColumn("__place", place).filter((F.col("__place") == 1) | (F.col(at) == F.col("__last"))).drop("__stretch", "__last", "__place")


def heartbeats(events: DataFrame, keys: list[str], at: str, idle: int = 30) -> DataFrame:
    """(keys, at): where a silent stream would have sent a heartbeat: every ``idle`` seconds of a gap between two events."""
    w = Window.partitionBy(*keys).orderBy(at)
    gaps = events.select(*keys, F.lag(at).over(w).alias("__from"), F.col(at).alias("__to")).filter(F.col("__to").cast("double") - F.col("__from").cast("double") > idle)
    beats = F.sequence(F.col("__from") + F.expr(f"INTERVAL {idle} SECONDS"), F.col("__to") - F.expr("INTERVAL 1 MICROSECOND"), F.expr(f"INTERVAL {idle} SECONDS"))
    return gaps.select(*keys, F.explode(beats).alias("at"))


def recovered(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Task rows (those of STATE) with the stored results of tasks whose end a client missed: only tasks that still run change.

    results: task_id, status, success, failed, message. Applied again it changes
    nothing, so a stream may call it for each batch it sees.
    """
    r = results.select("task_id", *[F.col(c).alias(f"__{c}") for c in ("status", "success", "failed", "message")])
    joined = tasks.join(r, "task_id", "left")
    ended = (F.col("status") == "running") & F.col("__status").isin("completed", "failed")
    new = {
        "status": F.col("__status"), "progress": F.when(F.col("__status") == "completed", F.lit(100).cast("long")).otherwise(F.col("progress")),
        "success": F.coalesce("__success", "success"), "failed": F.coalesce("__failed", "failed"), "message": F.coalesce("__message", "message"),
    }
    return joined.select(*[F.when(ended, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in tasks.columns])
