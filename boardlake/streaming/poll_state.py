"""Poll state of boards: adaptive intervals as keyed state, in a batch or in a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Seconds between polls.
BUSY, QUIET, WATCHED, GROWTH, JITTER = 300, 14_400, 1_800, 1.5, 0.35


def next_interval(interval: Column, changed: Column, failed: Column, watched: Column) -> Column:
    """300 s after a change, half as long again after a quiet poll up to four hours (half an hour if watched); an error holds."""
    ceiling = F.when(watched, WATCHED).otherwise(QUIET)
    grown = F.least(F.floor(F.coalesce(interval, F.lit(BUSY)) * GROWTH), ceiling)
    return F.when(failed, F.coalesce(interval, F.lit(BUSY))).when(changed, BUSY).otherwise(grown).cast("int")


def jittered(interval: Column, key: Column) -> Column:
    """Up to 35 % less, by a hash of the key, so that boards do not come due together."""
    return F.floor(interval * (1 - JITTER * F.pmod(F.xxhash64(key), F.lit(1000)) / 1000)).cast("int")


def record(state: DataFrame, results: DataFrame, watched: DataFrame) -> DataFrame:
    """The state after a run's results (domain, changed, failed, polled_at)."""
    names = watched.select("domain", F.lit(True).alias("_w")).distinct()
    both = state.join(results, "domain", "full_outer").join(names, "domain", "left")
    polled = F.col("polled_at").isNotNull()
    step = next_interval(F.col("interval_s"), F.coalesce("changed", F.lit(False)), F.coalesce("failed", F.lit(False)), F.coalesce("_w", F.lit(False)))
    due = F.timestamp_add("SECOND", jittered(step, F.col("domain")), F.col("polled_at"))
    return both.select(
        "domain", F.when(polled, step).otherwise(F.col("interval_s")).alias("interval_s"), F.when(polled, due).otherwise(F.col("next_at")).alias("next_at"),
        F.when(polled & F.coalesce("changed", F.lit(False)), F.col("polled_at")).otherwise(F.col("last_change")).alias("last_change"),
    )


def streamed(polls: DataFrame) -> DataFrame:
    """The same intervals as state of a stream of polls (domain, changed, failed, polled_at, and watched if there is), in the order of their times."""
    watched = "watched" in polls.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        interval = state.get[0] if state.exists else BUSY
        rows = pd.concat(list(batches)).sort_values("polled_at")
        for changed, failed, seen in zip(rows["changed"], rows["failed"], rows["watched"] if watched else [False] * len(rows), strict=True):
            interval = interval if failed else BUSY if changed else min(int(interval * GROWTH), WATCHED if seen else QUIET)
        state.update((interval,))
        yield pd.DataFrame({"domain": [key[0]], "interval_s": [interval], "polled_at": [rows["polled_at"].iloc[-1]]})

    kept = polls.groupBy("domain").applyInPandasWithState(step, "domain string, interval_s int, polled_at timestamp", "interval_s int", "update", GroupStateTimeout.NoTimeout)
    return kept.select("domain", "interval_s", F.timestamp_add("SECOND", jittered(F.col("interval_s"), F.col("domain")), F.col("polled_at")).alias("next_at"))
