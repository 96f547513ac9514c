from datetime import datetime
from pyspark.sql import functions as F

from attestor.operators import monitor as M
from attestor.streaming import watch


def run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return [tuple(r) for r in stream.sparkSession.table(name).collect()]


def parts(tmp_path, frames, schema, spark):
    """One file, and so one micro-batch, for each frame."""
    import time

    for k, frame in enumerate(frames):
        spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_changes_batch_equals_stream(spark, tmp_path):
    schema = "key string, seq long, digest string, valid boolean"
    frames = [[("u", 1, "a", True), ("v", 1, "z", False)], [("u", 2, "q", False), ("v", 2, "z", True)], [("u", 3, "b", True), ("v", 3, "z", True)]]
    got = run(watch.content_changes(parts(tmp_path, frames, schema, spark)), "changes")
    batch = M.content_changes(spark.createDataFrame([r for f in frames for r in f], schema), "key", "seq", "digest", F.col("valid"))
    assert sorted(got) == sorted(tuple(r) for r in batch.select("key", "seq", "digest", "previous").collect()) == [("u", 3, "b", "a")]


def test_streaks_and_first_seen(spark, tmp_path):
    schema = "key string, seq long, failed boolean"
    frames = [[("u", 1, True), ("u", 2, True)], [("u", 3, True), ("u", 4, True)], [("u", 5, False)]]
    got = sorted(run(watch.failure_streaks(parts(tmp_path, frames, schema, spark)), "streaks"))
    assert got == [("u", 2, 2, False), ("u", 4, 4, True), ("u", 5, 0, False)]
    seen = tmp_path / "seen"
    seen.mkdir()
    frames = [[("f", "a", 1), ("f", "z", 1)], [("f", "a", 2), ("f", "b", 3), ("g", "b", 3)], [("f", "b", 4), ("g", "b", 4), ("g", "c", 5), ("f", "z", 5)]]
    found = run(watch.first_seen(parts(seen, frames, "owner string, item string, seq long", spark)), "first")
    assert sorted(found) == [("f", "b", 3), ("g", "c", 5)]


def test_windows_batch_equals_stream(spark, tmp_path):
    frame = [(datetime.fromisoformat("2026-01-01 00:10"), "a"), (datetime.fromisoformat("2026-01-01 00:50"), "a"), (datetime.fromisoformat("2026-01-09 00:00"), "b")]
    stream = parts(tmp_path, [frame, [(datetime.fromisoformat("2026-01-20 00:00"), "b")]], "ts timestamp, event_type string", spark)
    got = {(e, str(s), n) for e, s, n in run(watch.windowed_counts(stream), "windows")}
    assert {("a", "2026-01-01 00:00:00", 2), ("b", "2026-01-09 00:00:00", 1)} == got
