"""Admission over a stream: the admitted times of each key are list state, forgotten by a timer when a key is idle."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators.admission import OUT, Gate, requests

TIMES = StructType([StructField("at", DoubleType())])


class Admission(StatefulProcessor):
    """Decides a micro-batch's requests of one key in order of time. State: the key's latest `capacity` admitted times."""

    def __init__(self, capacity: int, window_s: float, idle_ms: int | None):
        self.capacity, self.window_s, self.idle_ms = capacity, window_s, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.times = handle, handle.getListState("admitted", TIMES)

    def _keep(self, times, timers) -> None:
        if times:
            self.times.put([(float(t),) for t in times])
        if self.idle_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        gate = Gate(self.capacity, self.window_s, key[0], [t[0] for t in self.times.get()] if self.times.exists() else ())
        some = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        allowed, retry = gate.decide(some["key"], some["ts"].tolist())
        self._keep(gate.admitted, timerValues)
        yield some.assign(allowed=allowed, retry_after_s=retry)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._keep(sorted(initialState["ts"].tolist())[-self.capacity :] if self.capacity else (), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def admission_stream(df: DataFrame, capacity: int, window_s: float, idle_ms: int | None = None, admitted: DataFrame | None = None) -> DataFrame:
    """The streaming form of operators.admission: rows of a micro-batch in order of time, keys apart.

    With idle_ms, a key that is idle so long is forgotten. admitted (key, ts): times that count as admitted before the stream begins. The session must
    keep state in RocksDB (spark.sql.streaming.stateStore.providerClass), as transformWithState asks for. A new checkpoint begins anew.
    """
    processor = Admission(capacity, window_s, idle_ms)
    before = None if admitted is None else admitted.selectExpr("cast(key as string) as key", "cast(ts as double) as ts").dropna().groupBy("key")
    return requests(df).groupBy("key").transformWithStateInPandas(processor, OUT, "append", "none" if idle_ms is None else "processingTime", initialState=before)
