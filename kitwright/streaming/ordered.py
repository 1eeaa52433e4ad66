"""Stateful processors that see each key's events in order of time, however they come in.

Events wait until the watermark has passed them; a timer at the time of each
then hands them over in order. Events behind the watermark are dropped, as in
every stateful stream. Timers need the RocksDB state store (:data:`STORE`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def millis(ts: pd.Timestamp) -> int:
    """The first whole millisecond at or after ``ts``."""
    return -(-ts.value // 1_000_000)


class InOrder(StatefulProcessor):
    """Subclasses have ``WAITING``, the fields of an event (``ts`` and ``seq`` first), and :meth:`passed`."""

    WAITING: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.names = [f.split()[0] for f in self.WAITING.split(", ")]

    def passed(self, key: tuple, events: list[tuple], now: pd.Timestamp) -> pd.DataFrame:
        """The output for the events that lie at or before ``now``, in order; none of a later call lies before it."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for ts, *event in part.loc[part["ts"].notna(), self.names].itertuples(index=False, name=None):
                self.waiting.appendValue((ts.to_pydatetime(), *event))
                self.handle.registerTimer(millis(ts))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        events = [(pd.Timestamp(ts), *rest) for ts, *rest in self.waiting.get()]
        due = sorted((e for e in events if e[0] <= now), key=lambda e: e[:2])
        if due:
            later = [(e[0].to_pydatetime(), *e[1:]) for e in events if e[0] > now]
            self.waiting.put(later) if later else self.waiting.clear()
        yield self.passed(key, due, now)

    def close(self) -> None:
        pass
