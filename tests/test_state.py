import random

import pytest
from pyspark.sql import functions as F

from attestor.sources.state import Conflict, VersionedState


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def state(spark, path, buckets=8):
    return VersionedState(spark, f"file://{path}", "k long, v string, t long", ["k"], buckets)


def table(spark, data):
    return spark.createDataFrame(data, "k long, v string, t long")


def test_upserts_equal_a_full_outer_join(spark, tmp_path):
    rng = random.Random(1)
    s, old = state(spark, tmp_path), table(spark, [])
    for n in range(3):
        changes = table(spark, [(rng.choice([None, *range(40)]), f"{n}", n) for n in range(n * 10, n * 10 + 12)])
        last = changes.groupBy("k").agg(F.max_by("v", "t").alias("v2"), F.max("t").alias("t2")).withColumnRenamed("k", "k2")
        old = old.join(last, F.col("k").eqNullSafe(F.col("k2")), "full").select(F.when(F.col("t2").isNull(), F.col("k")).otherwise(F.col("k2")).alias("k"), F.coalesce("v2", "v").alias("v"), F.coalesce("t2", "t").alias("t"))
        assert s.upsert(changes, "t").number == n + 1
        assert rows(s.read()) == rows(old)
        old = table(spark, rows(old))


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    s = state(spark, tmp_path)
    first = s.upsert(table(spark, [(k, "a", 1) for k in range(100)]))
    second = s.upsert(table(spark, [(3, "b", 2)]))
    assert sum(first.folders[k] != second.folders[k] for k in first.folders) == 1
    assert rows(s.read(1)) == [(k, "a", 1) for k in sorted(range(100), key=lambda k: repr((k, "a", 1)))]
    assert s.read().where("v = 'b'").count() == 1 and s.read().count() == 100


def test_a_batch_counts_once_and_late_rows_lose(spark, tmp_path):
    s = state(spark, tmp_path)
    s.upsert(table(spark, [(1, "new", 9)]), "t", "q", 0)
    assert s.upsert(table(spark, [(1, "again", 10)]), "t", "q", 0).number == 1
    s.upsert(table(spark, [(1, "late", 3), (2, "x", 1), (2, "y", 2)]), "t", "q", 1)
    assert rows(s.read()) == [(1, "new", 9), (2, "y", 2)]
    assert s.upsert(table(spark, []), "t", "q", 2).number == 3 and rows(s.read()) == [(1, "new", 9), (2, "y", 2)]


def test_a_run_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    s = state(spark, tmp_path)
    s.upsert(table(spark, [(1, "a", 1)]))
    with monkeypatch.context() as m:
        m.setattr(VersionedState, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            s.upsert(table(spark, [(1, "b", 2), (5, "c", 2)]))
    assert rows(s.read()) == [(1, "a", 1)] and len(list((tmp_path / "data").iterdir())) == 2
    s.upsert(table(spark, [(1, "b", 2)]))
    s.clean(1)
    assert rows(s.read()) == [(1, "b", 2)] and len(list((tmp_path / "data").iterdir())) == 1


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    s, other = state(spark, tmp_path), state(spark, tmp_path)
    before = s.version()
    other.upsert(table(spark, [(1, "other", 1)]))
    monkeypatch.setattr(s, "version", lambda number=None: before)
    with pytest.raises(Conflict):
        s.upsert(table(spark, [(1, "mine", 1)]))
    assert rows(other.read()) == [(1, "other", 1)]
    with pytest.raises(ValueError):
        state(spark, tmp_path, 9).read()


def test_keys_alone(spark, tmp_path):
    s = VersionedState(spark, f"file://{tmp_path}", "k long, v string", ["k", "v"], 4)
    s.upsert(spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k long, v string"))
    s.upsert(spark.createDataFrame([(1, "b"), (2, None)], "k long, v string"))
    assert rows(s.read()) == [(1, "a"), (1, "b"), (2, None)]
