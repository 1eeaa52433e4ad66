"""The read-once slot (:mod:`kitwright.operators.slots`) over a stream of events, in event time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from kitwright.streaming.ordered import InOrder, millis


class Slot(InOrder):
    """One key's slot, emptied by a read or by its timer."""

    WAITING = "ts timestamp, seq long, writes boolean"

    def __init__(self, seconds: float):
        self.life = pd.Timedelta(seconds=seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.slot = handle.getValueState("slot", "ts timestamp, seq long")

    def passed(self, key: tuple, events: list[tuple], now: pd.Timestamp) -> pd.DataFrame:
        held = (lambda v: (pd.Timestamp(v[0]), v[1]))(self.slot.get()) if self.slot.exists() else None
        out = []
        for ts, seq, writes in events:
            if writes:
                held = ts, seq
            else:
                out.append((key[0], seq, held[1] if held and ts - held[0] <= self.life else None))
                held = None
        if held and now - held[0] > self.life:
            held = None
        if held:
            self.slot.update((held[0].to_pydatetime(), held[1]))
            self.handle.registerTimer(millis(held[0] + self.life) + 1)
        elif self.slot.exists():
            self.slot.clear()
        return pd.DataFrame(out, columns=["user_id", "event_id", "found"]).astype({"found": "Int64"}) if out else pd.DataFrame()


def reads_stream(events: DataFrame, writes: Column, reads: Column, seconds: float, delay: str) -> DataFrame:
    """``user_id``, ``event_id`` and ``found`` of each event that ``reads``, of events (``user_id``, ``ts``, ``event_id``) that come up to ``delay`` late."""
    kept = events.filter(writes | reads).select("user_id", F.col("ts").cast("timestamp"), F.col("event_id").alias("seq"), F.coalesce(writes, F.lit(False)).alias("writes")).withWatermark("ts", delay)
    return kept.groupBy("user_id").transformWithStateInPandas(Slot(seconds), "user_id long, event_id long, found long", "update", "EventTime")
