"""Structured Streaming forms of the monitoring operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, at: str = "ts", window: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts for each type and window; rows later than the watermark are dropped."""
    w = F.window(at, window, slide) if slide else F.window(at, window)
    counts = events.withWatermark(at, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("event_type", F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    rows = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, keys: list[str], at: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def content_changes(snapshots: DataFrame) -> DataFrame:
    """Streaming form of monitor.content_changes over (key, seq, digest, valid): a change for each valid snapshot whose
    digest differs from the last valid one. State: one digest for each key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            if row.valid:
                if last is not None and last != row.digest:
                    out.append((key[0], row.seq, row.digest, last))
                last = row.digest
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["key", "seq", "digest", "previous"])

    return snapshots.groupBy("key").applyInPandasWithState(step, "key string, seq long, digest string, previous string", "digest string", "append", GroupStateTimeout.NoTimeout)


def failure_streaks(log: DataFrame, persistent: int = 4) -> DataFrame:
    """Streaming form of the current streak over (key, seq, failed): the number of failures since the last success
    after each micro-batch. State: one number for each key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("seq")
        for failed in rows["failed"]:
            streak = streak + 1 if failed else 0
        state.update((streak,))
        yield pd.DataFrame({"key": [key[0]], "seq": [int(rows["seq"].max())], "streak": [streak], "persistent": [streak >= persistent]})

    return log.groupBy("key").applyInPandasWithState(step, "key string, seq long, streak long, persistent boolean", "streak long", "append", GroupStateTimeout.NoTimeout)


def first_seen(observations: DataFrame) -> DataFrame:
    """Streaming discovery over (owner, item, seq): items that an owner shows for the first time after its first
    micro-batch, which only seeds. State: one key for each item of an owner, and one flag for each owner, so no row of the
    state grows. Of several sightings of a new item in one micro-batch any one gives the seq."""

    def after_seed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seeded = state.exists
        state.update((True,))
        for frame in frames:
            yield frame[["owner", "item", "seq"]] if seeded else frame.head(0)[["owner", "item", "seq"]]

    fresh = observations.select("owner", "item", "seq").dropDuplicates(["owner", "item"])
    return fresh.groupBy("owner").applyInPandasWithState(after_seed, "owner string, item string, seq long", "seeded boolean", "append", GroupStateTimeout.NoTimeout)
