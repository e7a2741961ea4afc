"""Progress of tasks with timers: heartbeats and expiry come when they are due, without later events.

Each task has its state and one processing-time timer. An event applies to the state
and sets the timer anew; a timer that comes due sends a heartbeat and is set again,
until the task has been idle too long: then it expires, and its state goes. State of
tasks whose timer is lost goes by its time to live.

Defined cases: events after a task's end change nothing but are counted as contact;
events without a task are the null task's; events of one batch are ordered by ``ord``;
a task that expired begins anew with its next event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomwell.streaming.progress import _NAMES, STATE, _step

#: kind: update (events came), heartbeat (none came for a while), expired (none came for too long).
TIMED = STATE + ", kind string, at_ms long"
_KEPT = STATE.split(", ", 1)[1] + ", seen_ms long"


class _Tasks(StatefulProcessor):
    def __init__(self, heartbeat_ms: int, idle_ms: int):
        self.heartbeat_ms, self.idle_ms = heartbeat_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", _KEPT, 4 * self.idle_ms)

    def _row(self, key, state: dict, kind: str, now: int) -> pd.DataFrame:
        return pd.DataFrame([{"task_id": key[0], **{n: state[n] for n in _NAMES}, "kind": kind, "at_ms": now}])

    def _timer(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        state = dict(zip(_NAMES, self.task.get(), strict=False)) if self.task.exists() else {"status": "running", "progress": 0, "success": 0, "failed": 0, "url": None, "message": None, "n_events": 0}
        events = pd.concat(list(rows)).sort_values("ord")
        for e in events.to_dict("records"):  # pandas turns null numbers into NaN, and the rest of their column into floats
            state = _step(state, {k: None if pd.isna(v) else int(v) if isinstance(v, float) else v for k, v in e.items()})
        self.task.update((*[state[n] for n in _NAMES], now))
        self._timer(now + min(self.heartbeat_ms, self.idle_ms))
        yield self._row(key, state, "update", now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.task.exists():
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        *values, seen = self.task.get()
        state = dict(zip(_NAMES, values, strict=True))
        if now - seen >= self.idle_ms:
            self.task.clear()
            yield self._row(key, state, "expired", now)
        else:
            self._timer(now + min(self.heartbeat_ms, seen + self.idle_ms - now))
            yield self._row(key, state, "heartbeat", now)


def timed(events: DataFrame, heartbeat_seconds: float = 30, idle_seconds: float = 300) -> DataFrame:
    """STATE with kind and at_ms for each update, heartbeat and expiry of each task of a stream of events.

    The session's state store has to be RocksDB's (``spark.sql.streaming.stateStore.providerClass``).
    """
    keyed = events.select(F.col("task_id"), *[c for c in events.columns if c != "task_id"])
    return keyed.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=_Tasks(int(heartbeat_seconds * 1000), int(idle_seconds * 1000)), outputStructType=TIMED, outputMode="Update", timeMode="ProcessingTime"
    )
