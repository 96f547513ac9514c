"""Ordered logs cut at any place give what one window over each key gives."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from attestor.operators import monitor, ordered


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(2)
    day = datetime(2024, 1, 1)
    rows = []
    for k in range(3000):
        key = 7 if rng.random() < 0.5 else rng.choice([None, 1, 2, 3, 4, *range(10, 60)])
        rows.append((key, day + timedelta(minutes=rng.randrange(60 * 24 * 40)), k, rng.choice(["error", "error", "view", "click"]), None if rng.random() < 0.3 else f"d{rng.randrange(3)}", rng.choice([None, *map(float, range(20))])))
    return spark.createDataFrame(rows, "key long, at timestamp, id long, kind string, digest string, value double").repartition(5).cache()


@pytest.mark.parametrize("ranges", ["1", "13"])
def test_values_cross_borders(spark, log, ranges):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        window = Window.partitionBy("key").orderBy("at", "id")
        before, upto, after = window.rowsBetween(Window.unboundedPreceding, -1), window.rowsBetween(Window.unboundedPreceding, 0), window.rowsBetween(1, Window.unboundedFollowing)
        want = log.select("id", F.last("digest", True).over(before), F.first("digest", True).over(after), F.sum(F.col("kind").eqNullSafe("error").cast("long")).over(upto))
        dealt = ordered.Ordered(log, ["key"], ["at", "id"])
        if ranges != "1":
            assert dealt.rows.where("key = 7").select("__part").distinct().count() > 3  # the hot key is shared
        got = dealt.last(F.col("digest"), "a").following(F.col("digest"), "b").total((F.col("kind") == "error").cast("long"), "c").done()
        assert sorted(map(tuple, got.select("id", "a", "b", "c").collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_percentiles_are_exact(spark, log):
    want = log.groupBy("kind").agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)") for p in (0.0, 0.1, 0.5, 0.95, 1.0)), F.max("value"))
    got = ordered.percentiles(log, "kind", "value", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_releases_equal_a_walk(spark, log):
    want = {}
    for key in {r.key for r in log.collect()}:
        hours = sorted(r.at.replace(minute=0, second=0, microsecond=0) for r in log.where(F.col("key").eqNullSafe(key)).collect())
        last, n, held = None, 0, 0
        for h in hours:
            if h == last:
                continue
            if last is None or h >= last + timedelta(hours=48):
                last, n, held = h, n + 1, 0
            else:
                held += 1
        want[key] = (n, last, held)
    assert {r.key: (r.releases, r.last_release, r.held) for r in ordered.releases(log, "key", "at").collect()} == want


def test_long_chains_and_empty_logs(spark):
    day = datetime(2020, 1, 1)
    chain = spark.createDataFrame([(1, day + timedelta(days=2 * k)) for k in range(200)], "key long, at timestamp")
    assert [tuple(r) for r in ordered.releases(chain, "key", "at").collect()] == [(1, 200, day + timedelta(days=398), 0)]
    assert ordered.releases(chain.limit(0), "key", "at").collect() == []
    assert ordered.percentiles(spark.createDataFrame([], "kind string, value double"), "kind", "value", {"a": 0.5}).collect() == []


def test_streaks_and_changes_of_a_hot_key(spark, log):
    window = Window.partitionBy("key").orderBy("at", "id")
    island = F.sum(F.when(F.col("kind") == "error", 0).otherwise(1)).over(window.rowsBetween(Window.unboundedPreceding, 0))
    want = log.withColumn("i", island).where("kind = 'error'").groupBy("key", "i").agg(F.count(F.lit(1)), F.min("at"), F.max("at")).drop("i")
    got = monitor.failure_streaks(log, "key", "at", "id", F.col("kind") == "error").drop("persistent")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    previous = F.last("digest", True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    rows = log.select("key", (F.unix_seconds("at") * 10000 + F.col("id")).alias("n"), "digest", previous.alias("p")).where("digest is not null and p <> digest")
    got = monitor.content_changes(log.select("key", (F.unix_seconds("at") * 10000 + F.col("id")).alias("n"), "digest"), "key", "n", "digest", F.col("digest").isNotNull())
    assert sorted(map(tuple, got.select("key", "n", "digest", "previous").collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
