"""Small helpers shared by the training-data operators: table access, Arrow batch mapping, the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.session import shared_folder, ship_package

#: Rows in one Arrow batch sent to a Python worker; long texts make larger batches costly in memory.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches of at most BATCH_ROWS rows."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def record_batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share (see attestor.session.shared_folder)."""
    return shared_folder(spark)


def materialize(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut, a lost executor costs nothing."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_dir(spark: SparkSession, folder: str) -> None:
    """Remove a folder below shared_dir that nothing will read again."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc32_mod(column: str, modulus: int) -> Column:
    """crc32 of a column's decimal text, modulo `modulus`: the folds of the labelled rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
