"""Streaming monitors whose state ends: what wasn't seen for a lifetime of event time is forgotten. Each item has a state of
one row and one timer; the timer moves with each sighting and removes the row once the watermark has passed it, so the
state holds what is alive, however long the stream runs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def use_rocksdb(spark: SparkSession) -> None:
    """States with timers need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Living(StatefulProcessor):
    """One (at, digest) for each key, and what it means for the next row."""

    def __init__(self, lifetime_ms: int):
        self.lifetime = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long, digest string")

    def told(self, key: tuple, at: int, digest: str | None, last: tuple | None) -> tuple | None:
        """The output row of a sighting; last: (at, digest) of the one before, unless that is a lifetime ago."""
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, out = self.last.get() if self.last.exists() else None, []
        before = last[0] if last else None
        frame = pd.concat(list(rows))
        for at, digest in sorted(zip(frame["ms"].tolist(), frame["digest"].tolist(), strict=True), key=lambda r: (r[0], r[1] or "")):
            alive = last is not None and at - last[0] < self.lifetime
            row = self.told(key, at, digest, last if alive else None)
            if row is not None:
                out.append(row)
            if last is None or at >= last[0]:
                last = (at, digest)
        self.last.update(last)
        if before != last[0]:
            if before is not None:
                self.handle.deleteTimer(before + self.lifetime)
            self.handle.registerTimer(last[0] + self.lifetime)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame([], columns=self.columns)

    def close(self) -> None:
        pass


class _FirstSeen(_Living):
    columns = ("owner", "item", "ms")

    def told(self, key, at, digest, last):
        return (key[0], key[1], at) if last is None else None


class _Changes(_Living):
    columns = ("key", "ms", "digest", "previous")

    def told(self, key, at, digest, last):
        return (key[0], at, digest, last[1]) if last is not None and last[1] != digest else None


def _run(rows: DataFrame, keys: list[str], processor: _Living, schema: str, at: str, late: str) -> DataFrame:
    use_rocksdb(rows.sparkSession)
    dealt = rows.withWatermark(at, late).select(*keys, "digest", at, F.unix_millis(at).alias("ms")).groupBy(*keys)
    return dealt.transformWithStateInPandas(processor, schema, "Append", "EventTime")


def first_seen(observations: DataFrame, owners: DataFrame, lifetime_ms: int, late: str = "1 hour") -> DataFrame:
    """Streaming discovery over (owner, item, at): sightings of items that their owner hasn't shown for a lifetime, but for
    those of the owner's first day, which only seed. owners: (owner, start), a static table."""
    found = _run(observations.withColumn("digest", F.lit(None).cast("string")), ["owner", "item"], _FirstSeen(lifetime_ms), "owner string, item string, ms long", "at", late)
    return _after_start(found, owners)


def first_seen_batch(observations: DataFrame, owners: DataFrame, lifetime_ms: int) -> DataFrame:
    """The same over a whole log."""
    rows = observations.select("owner", "item", F.unix_millis("at").alias("ms"))
    before = F.lag("ms").over(Window.partitionBy("owner", "item").orderBy("ms"))
    return _after_start(rows.withColumn("before", before).where(_ended(lifetime_ms)).drop("before"), owners)


def _ended(lifetime_ms: int) -> Column:
    return F.col("before").isNull() | (F.col("ms") - F.col("before") >= lifetime_ms)


def _after_start(rows: DataFrame, owners: DataFrame) -> DataFrame:
    at = F.timestamp_millis("ms")
    return rows.join(owners, "owner").where(F.to_date(at) > F.to_date("start")).select("owner", "item", at.alias("at"))


def content_changes(snapshots: DataFrame, lifetime_ms: int, late: str = "1 hour") -> DataFrame:
    """Streaming changes over (key, at, digest, valid): valid snapshots whose digest differs from the last valid one within a
    lifetime; after a longer silence a snapshot only seeds."""
    found = _run(snapshots.where("valid"), ["key"], _Changes(lifetime_ms), "key string, ms long, digest string, previous string", "at", late)
    return found.select("key", F.timestamp_millis("ms").alias("at"), "digest", "previous")


def content_changes_batch(snapshots: DataFrame, lifetime_ms: int) -> DataFrame:
    """The same over a whole log."""
    order = Window.partitionBy("key").orderBy("at", "digest")
    rows = snapshots.where("valid").select("key", "at", "digest", F.lag("digest").over(order).alias("previous"), F.lag("at").over(order).alias("then"))
    near = F.unix_millis("at") - F.unix_millis("then") < lifetime_ms
    return rows.where(near & ~F.col("digest").eqNullSafe(F.col("previous"))).drop("then")
