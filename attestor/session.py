"""The Spark session that the engine expects: UTC, adaptive execution, this package on its Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once, so that they needn't have it on their own path."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="attestor-")  # the driver serves the archive from here until the session ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder, f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


def shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Without the setting a folder under
    /tmp/checkpoints is taken, but only where all executors are in this process: on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or "file:///tmp/checkpoints").rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below shared_base."""
    return f"{shared_base(spark)}/attestor-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in a shared folder, read back: what several branches of a plan need is computed once, and a
    lost executor costs nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if its scan has fewer splits than there are cores (a small table in one row group). A
    large table has more and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def session(app: str = "attestor", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings. Cluster settings (master, memory, checkpoint folder) come from outside;
    `conf` has further ones, with _ for . in names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    settings |= {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
