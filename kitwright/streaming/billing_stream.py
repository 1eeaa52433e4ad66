"""The billing state machine over a stream of events, in event time.

Events may come late and out of order, up to the watermark's delay. Each is
kept until the watermark has passed it; a timer at its time then applies it
after all that are earlier, so what a user's state goes through is what the
batch fold goes through. A cancelled plan has a timer at the end of its period
and ends then, without another event. Events behind the watermark are dropped,
as in every stateful stream.

An output row is a state and the time it holds from; a user has one for each
time that changed it. A user's events of one delay are kept, no more.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessorHandle

from kitwright.streaming.ordered import InOrder, millis

STATE = "plan string, interval string, cancels boolean, period_end timestamp, has_card boolean, n_invoices int"
OUTPUT = f"user_id long, since timestamp, {STATE}"


def _months_later(ts: pd.Timestamp, months: int) -> pd.Timestamp:
    first = ts.replace(day=1) + pd.DateOffset(months=months)
    return first + pd.Timedelta(days=ts.day - 1)


def _ended(s: tuple, now: pd.Timestamp) -> tuple:
    plan, interval, cancels, period_end, has_card, made = s
    if cancels and period_end is not None and period_end <= now:
        return "free", "monthly", False, None, has_card, made
    return s


def _apply(s: tuple, e: tuple) -> tuple:
    ts, _, action, new_plan, new_interval = e
    plan, interval, cancels, period_end, has_card, made = _ended(s, ts)
    if action == "select" and not (new_plan == plan and (plan == "free" or new_interval == interval)):
        action = "change"
    if action == "change" and new_plan == "free":
        plan, interval, cancels, period_end = "free", "monthly", False, None
    elif action == "change" and has_card:
        plan, interval, cancels = new_plan, new_interval, False
        period_end, made = _months_later(ts, 12 if new_interval == "yearly" else 1), made + 1
    elif action == "cancel" and plan != "free":
        cancels = True
    elif action == "resume":
        cancels = False
    elif action == "add_card":
        has_card = True
    elif action == "remove_card" and plan == "free":
        has_card = False
    return plan, interval, cancels, period_end, has_card, made


class Subscription(InOrder):
    """One user's state, and a timer for the end of the period."""

    WAITING = "ts timestamp, seq long, action string, plan string, interval string"

    def __init__(self, opened: str):
        self.opened = pd.Timestamp(opened)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", STATE)

    def _now(self) -> tuple:
        if not self.state.exists():
            return "pro", "monthly", False, self.opened + pd.Timedelta(days=30), True, 4
        plan, interval, cancels, period_end, has_card, made = self.state.get()
        return plan, interval, cancels, None if pd.isna(period_end) else pd.Timestamp(period_end), has_card, made

    def passed(self, key: tuple, events: list[tuple], now: pd.Timestamp) -> pd.DataFrame:
        """The events, then the end of the period."""
        before = s = self._now()
        since = now
        for e in events:
            s, since = _apply(s, e), e[0]
        if _ended(s, now) != s:
            s, since = _ended(s, now), s[3]
        if s == before and self.state.exists():
            return pd.DataFrame()
        self.state.update((*s[:3], None if s[3] is None else s[3].to_pydatetime(), *s[4:]))
        if s[2] and s[3] is not None and s[3] > now:
            self.handle.registerTimer(millis(s[3]))
        columns = ["user_id", "since", "plan", "interval", "cancels", "period_end", "has_card", "n_invoices"]
        return pd.DataFrame([(key[0], since, *s)], columns=columns).astype({"since": "datetime64[ns]", "period_end": "datetime64[ns]"})


def replay_stream(events: DataFrame, opened: str, delay: str = "1 day") -> DataFrame:
    """States of each user with events (``user_id``, ``ts``, ``seq``, ``action``, ``plan``, ``interval``) that come up to ``delay`` late.

    The session needs the settings of ``ordered.STORE``.
    """
    watched = events.select("user_id", "ts", "seq", "action", "plan", "interval").withWatermark("ts", delay)
    return watched.groupBy("user_id").transformWithStateInPandas(Subscription(opened), OUTPUT, "update", "EventTime")
