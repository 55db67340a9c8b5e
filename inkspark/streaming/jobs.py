"""Job states over a stream of events: one small state for each job in the state store.

The rules are those of ``operators.histories``; replaying a log in any number of micro-batches, with restarts from the checkpoint, ends in
the states of the batch fold, as long as a job's events come in order. An analysis that hears nothing for ``patience`` of event time fails by a timer: the
job gets back the state that it had before.

Needs RocksDB as state store: ``spark.sql.streaming.stateStore.providerClass`` (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from inkspark.operators.histories import after

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "job string, status string, stage string, accepted long, rejected long, last_event string"
_STATE = "status string, before string, stage string, accepted long, rejected long"


def use_state_store(spark: SparkSession) -> None:
    """Streams of this session keep their states in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _Jobs(StatefulProcessor):
    """Folds a job's events; ``stage`` events report progress and count only while the job is analysed and when the stage changes."""

    def __init__(self, patience_ms: int | None) -> None:
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", _STATE)

    def _now(self) -> list:
        return list(self.state.get()) if self.state.exists() else ["draft", "draft", None, 0, 0]

    def _row(self, key: tuple, now: list, event: str | None) -> pd.DataFrame:
        status, _, stage, accepted, rejected = now
        return pd.DataFrame([(key[0], status, stage, accepted, rejected, event)], columns=["job", "status", "stage", "accepted", "rejected", "last_event"])

    def _clear_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now, last, heard = self._now(), None, None
        for r in pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable").itertuples(index=False):
            status, before, stage, accepted, rejected = now
            last, heard = r.event, int(r.at.value // 1_000_000)
            if r.event == "stage":
                fits = status == "analyzing" and r.stage != stage
                to, stage = (status, before), r.stage if fits else stage
            else:
                to = after(r.event, status, before)
                fits = to is not None
                stage = None if fits else stage
            status, before = to if fits else (status, before)
            now = [status, before, stage, accepted + fits, rejected + (not fits)]
        self.state.update(tuple(now))
        if self.patience is not None:
            self._clear_timers()
            if now[0] == "analyzing":
                self.handle.registerTimer(heard + self.patience)
        yield self._row(key, now, last)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self._now()
        if now[0] == "analyzing":
            now = [now[1], now[1], None, *now[3:]]
            self.state.update(tuple(now))
            yield self._row(key, now, "timeout")


def job_states(events: DataFrame, late: str = "1 minute", patience_ms: int | None = None) -> DataFrame:
    """job, status, stage, accepted, rejected, last_event of every job that a micro-batch touches, in update mode.

    ``events`` (a stream): job string, at timestamp, seq long, event string, stage string. The watermark only drives timers: states are kept.
    """
    known = events.select("job", "at", "seq", "event", "stage")
    timed = patience_ms is not None
    known = known.withWatermark("at", late) if timed else known
    return known.groupBy("job").transformWithStateInPandas(_Jobs(patience_ms), OUTPUT, "Update", "EventTime" if timed else "None")
