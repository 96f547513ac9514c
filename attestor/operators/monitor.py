"""Monitoring: changes, discoveries, streaks, health, backlogs. Every operator works on an append-only log in batch;
attestor.streaming has the incremental forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.ordered import Ordered


def content_changes(snapshots: DataFrame, key: str, order: str, digest: str, valid: Column) -> DataFrame:
    """Snapshots whose digest differs from the last valid one of their key. The first valid one only seeds; invalid
    ones (errors, challenge pages) neither change nor replace what is known."""
    rows = snapshots.withColumn("__valid", F.coalesce(valid, F.lit(False)))
    rows = Ordered(rows, [key], [order]).last(F.when(F.col("__valid"), F.col(digest)), "previous").done()
    return rows.where(F.col("__valid") & F.col("previous").isNotNull() & (F.col("previous") != F.col(digest))).drop("__valid")


def first_seen(observations: DataFrame, owner: str, item: str, at: str) -> DataFrame:
    """Items first observed after their owner's first day: what the first synchronisation brings only seeds."""
    items = observations.groupBy(owner, item).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    start = observations.groupBy(owner).agg(F.min(at).alias("__start"))
    return items.join(start, owner).where(F.to_date("first_seen") > F.to_date("__start")).drop("__start")


def failure_streaks(log: DataFrame, key: str, at: str, tie: str, failed: Column, persistent: int = 4) -> DataFrame:
    """Runs of consecutive failures of each key (gaps and islands): number, first and last failure, persistent or not. A
    streak's island is the number of successes before it."""
    order = list(dict.fromkeys((at, tie)))
    rows = Ordered(log.select(key, *order, F.coalesce(failed, F.lit(False)).alias("__f")), [key], order)
    rows = rows.total(F.when(F.col("__f"), 0).otherwise(1), "island").done()
    runs = rows.where("__f").groupBy(key, "island").agg(F.count(F.lit(1)).alias("failures"), F.min(at).alias("first_failure"), F.max(at).alias("last_failure"))
    return runs.withColumn("persistent", F.col("failures") >= persistent).drop("island")


def recovered(errors: DataFrame, checks: DataFrame, key: str, at: str) -> DataFrame:
    """Errors with a later successful check of the same key."""
    latest = checks.groupBy(key).agg(F.max(at).alias("__latest"))
    return errors.join(latest, key, "left").withColumn("recovered", F.coalesce(F.col("__latest") > F.col(at), F.lit(False))).drop("__latest")


#: Hours until the next attempt after 0, 1, 2 … failures, and from then on (fixed values).
RETRY_HOURS, RETRY_LAST = (0, 6, 24, 72, 168, 336), 336


def retry_hours(attempts: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, RETRY_HOURS)), (attempts + 1).cast("int")), F.lit(RETRY_LAST))


def retry_due(rows: DataFrame, terminal: tuple[str, ...], now: Column) -> DataFrame:
    """Rows to be tried: not terminal, and a technical error only from its next time on (unreadable times are due)."""
    at = F.try_to_timestamp("next_retry_at")
    return rows.where(~F.col("status").isin(*terminal) & ((F.col("status") != "technical_error") | at.isNull() | (at <= now)))


def source_state(streak: Column, equivalent: Column, structured: Column, feed: Column, persistent: int = 4) -> Column:
    """What a failing source counts as, by precedence: covered by an equivalent source, by structured data, by a feed
    (home pages only, which the caller decides), persistent, or failing."""
    return F.when(streak == 0, "healthy").when(equivalent, "covered_equivalent").when(structured, "covered_structured").when(feed, "covered_feed").when(streak >= persistent, "persistent").otherwise("failing")


def protected(status: Column) -> Column:
    """HTTP statuses that say a page is there but guarded (fixed values)."""
    return status.isin(401, 403, 405, 429)


def latest_state(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a keyed upsert as a new snapshot."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__s"))
    return last.select(*keys, *[F.col("__s")[c].alias(c) for c in rest])


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, in an explicit order."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__s"))
    return first.select(*keys, *[F.col("__s")[c].alias(c) for c in rest])


def append_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose keys don't exist yet, once for each key."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys)
