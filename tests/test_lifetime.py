import random
from datetime import datetime, timedelta

import pytest

from attestor.streaming import lifetime

pytest.importorskip("google.protobuf")
DAY = datetime(2026, 1, 1)
HOUR = 3_600_000


def run(spark, tmp_path, frames, schema, of, name):
    """The rows that a stream of one micro-batch for each frame gives, and the most rows its state ever had."""
    for k, frame in enumerate(frames):
        spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = of(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
        most = max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"])
        batches = sum(p["numInputRows"] > 0 for p in q.recentProgress)
    finally:
        q.stop()
    return sorted(map(tuple, spark.table(name).collect()), key=repr), most, batches


@pytest.fixture
def few(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def test_discovery_forgets(spark, tmp_path, few):
    rng = random.Random(3)
    frames = []
    for k in range(14):  # ten new items a batch, three hours apart; some come again soon, some late
        at = lambda k=k: DAY + timedelta(hours=3 * k, minutes=rng.randrange(60))
        again = [("o", f"i{max(0, k - d)}-{rng.randrange(10)}", at()) for d in (1, 1, 5)]
        frames.append([("o", f"i{k}-{n}", at()) for n in range(10)] + again)
    schema = "owner string, item string, at timestamp"
    owners = spark.createDataFrame([("o", DAY)], "owner string, start timestamp")
    got, most, batches = run(spark, tmp_path, frames, schema, lambda s: lifetime.first_seen(s, owners, 6 * HOUR), "seen")
    want = lifetime.first_seen_batch(spark.createDataFrame([r for f in frames for r in f], schema), owners, 6 * HOUR)
    assert got == sorted(map(tuple, want.collect()), key=repr) and len(got) > 40
    assert batches == len(frames) and most < 140  # 4 batches are alive at most; states and timers count


def test_changes_forget(spark, tmp_path, few):
    rng = random.Random(5)
    frames = [[(f"k{rng.randrange(4)}", DAY + timedelta(hours=k, minutes=n), rng.choice("ab"), rng.random() < 0.8) for n in range(3)] for k in range(12)]
    schema = "key string, at timestamp, digest string, valid boolean"
    got, _, _ = run(spark, tmp_path, frames, schema, lambda s: lifetime.content_changes(s, 2 * HOUR), "changed")
    want = lifetime.content_changes_batch(spark.createDataFrame([r for f in frames for r in f], schema), 2 * HOUR)
    assert got == sorted(map(tuple, want.collect()), key=repr) and got
