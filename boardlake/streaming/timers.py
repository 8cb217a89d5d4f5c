"""Boards that become due as the clock passes: keyed state with timers.

The clock is that of the polls themselves (event time, by their watermark), so a log that is read again gives the same
answers. A board's state is its interval, when it is due and until when it is watched. Each poll sets the timer anew; a board whose
timer the clock reaches is sent out once, and a watch that has run out is too.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .poll_state import BUSY, GROWTH, JITTER, QUIET, WATCHED

#: How long a board stays watched after it was last asked for.
WATCH = timedelta(days=14)
#: What holds state with timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "domain string, event string, at timestamp, interval_s int"


def millis(t: pd.Timestamp) -> int:
    return int(t.value // 1_000_000)


class Boards(StatefulProcessor):
    """The state of one board: (interval_s, due, watched until, last poll), times in milliseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("board", "interval_s int, due long, watched long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        interval, due, watched, last = self.state.get() if self.state.exists() else (BUSY, -1, -1, -1)
        for changed, failed, asked, at, spread in sorted(pd.concat(list(rows))[["changed", "failed", "watched", "polled_at", "spread"]].itertuples(index=False), key=lambda r: r[3]):
            now = millis(at)
            if now <= last:  # a poll that comes late tells nothing new
                continue
            watched = now + int(WATCH.total_seconds() * 1000) if asked else watched
            interval = interval if failed else BUSY if changed else min(int(interval * GROWTH), WATCHED if watched > now else QUIET)
            due, last = now + int(interval * (1 - JITTER * int(spread) / 1000)) * 1000, now
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        for t in {due, watched} - {-1}:
            self.handle.registerTimer(t)
        self.state.update((interval, due, watched, last))
        yield pd.DataFrame({"domain": [], "event": [], "at": pd.to_datetime([]), "interval_s": []}).astype({"domain": str, "event": str, "interval_s": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        interval, due, watched, last = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        told = [e for e, t in (("due", due), ("unwatched", watched)) if t == at]
        self.state.update((interval, -1 if due == at else due, -1 if watched == at else watched, last))
        yield pd.DataFrame({"domain": [key[0]] * len(told), "event": told, "at": [pd.Timestamp(at, unit="ms")] * len(told), "interval_s": [interval] * len(told)})

    def close(self) -> None:
        pass


def due_boards(polls: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(domain, event, at, interval_s): `due` when the clock passes a board's next poll, `unwatched` when its watch has run out.

    polls is a stream of domain, changed, failed, polled_at, and watched if there is; delay is how late a poll may come. The session's
    state store becomes the one that keeps timers. Null flags count as false; polls without domain or time are left out.
    """
    polls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in polls.columns else F.lit(False)
    rows = polls.where("domain is not null and polled_at is not null").select("domain", flag("changed").alias("changed"), flag("failed").alias("failed"), flag("watched").alias("watched"), "polled_at", F.pmod(F.xxhash64("domain"), F.lit(1000)).alias("spread"))
    return rows.withWatermark("polled_at", delay).groupBy("domain").transformWithStateInPandas(Boards(), EVENTS, "Update", "EventTime")
