"""Sinks: day partitions, append-if-absent, versioned state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators.monitor import append_absent


def overwrite_days(df: DataFrame, path: str, at: str) -> None:
    """One partition for each day; only days that df has are replaced."""
    df.withColumn("day", F.to_date(at)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def append_if_absent(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append only rows whose keys aren't there yet; replaying adds nothing."""
    existing = df.sparkSession.read.schema(df.schema).parquet(path) if _exists(df, path) else None
    new = df.dropDuplicates(keys) if existing is None else append_absent(existing, df, keys)
    new.write.mode("append").parquet(path)


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(target)


def upsert(state: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """A new state snapshot: rows of `changes` replace those of `state` with the same keys. The caller writes it as the
    next version, so that readers of the present one aren't disturbed."""
    return state.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)
