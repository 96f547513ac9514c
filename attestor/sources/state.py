"""Keyed state as versions. Rows lie in buckets by a hash of their keys; an upsert rewrites only the buckets that its changes
touch, into a new folder, and then publishes a manifest that names a folder for every bucket. Publishing is one rename
that fails if the version is there already, so a run that dies before it changes nothing, readers of a version are never
disturbed, and of two writers one fails."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has published the version first."""


@dataclass(frozen=True)
class Version:
    number: int
    folders: dict[int, str]  # of each bucket that has rows
    batches: dict[str, int]  # of each writer, the last batch that is in


class VersionedState:
    """A table of `schema` with one row for each value of `keys`, below `path`. buckets is fixed when the first version is
    written."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self._to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._to_path(self.path).getFileSystem(self._conf)

    def _numbers(self) -> list[int]:
        place = self._to_path(f"{self.path}/versions")
        names = [s.getPath().getName() for s in self._files.listStatus(place)] if self._files.exists(place) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def version(self, number: int | None = None) -> Version:
        """A version, the last one if no number is given; version 0 is empty."""
        known = self._numbers()
        number = (known[-1] if known else 0) if number is None else number
        if number == 0:
            return Version(0, {}, {})
        text = self.spark.read.text(f"{self.path}/versions/{number:012d}.json", wholetext=True).first().value
        found = json.loads(text)
        if found["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {found['buckets']} buckets, not {self.buckets}")
        return Version(number, {int(k): v for k, v in found["folders"].items()}, found["batches"])

    def read(self, number: int | None = None) -> DataFrame:
        return self._rows(self.version(number))

    def _rows(self, version: Version, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={k}" for k, folder in sorted(version.folders.items()) if only is None or k in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, changes: DataFrame, order: str | None = None, writer: str = "", batch: int | None = None) -> Version:
        """Changes replace rows of the same keys, the one with the largest `order` if there are several, and if the state's own row has
        no larger one. A batch of a writer that is in already changes nothing. Rows with a null in the keys are rows like others."""
        now = self.version()
        if batch is not None and batch <= now.batches.get(writer, -1):
            return now
        columns = self.spark.createDataFrame([], self.schema).columns
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = changes.select(columns).withColumn("bucket", bucket)
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # as many as there are buckets at most
        folders, folder = dict(now.folders), uuid.uuid4().hex
        if touched:
            old = self._rows(now, touched).select(columns).withColumn("bucket", bucket)
            both = old.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))
            rest = [c for c in columns if c not in self.keys] or self.keys[:1]
            rank = F.struct(*([order] if order else []), "__new")
            merged = both.groupBy("bucket", *self.keys).agg(F.max_by(F.struct(*rest), rank).alias("__row"))
            rows = merged.select("bucket", *(F.col("__row")[c].alias(c) if c in rest else F.col(c) for c in columns))
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
            folders |= dict.fromkeys(touched, folder)
        batches = now.batches | ({writer: batch} if batch is not None else {})
        version = Version(now.number + 1, folders, batches)
        self._publish(version)
        return version

    def _publish(self, version: Version) -> None:
        draft = self._to_path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        text = json.dumps({"buckets": self.buckets, "folders": version.folders, "batches": version.batches})
        out = self._files.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._to_path(f"{self.path}/versions/{version.number:012d}.json"), none)
        except Exception as e:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"{self.path}: version {version.number} is there") from e
            raise

    def clean(self, keep: int = 2) -> None:
        """Remove all versions but the last `keep`, and folders that none of these names (also those of runs that died). No
        writer may be at work."""
        numbers = self._numbers()
        held = {f for n in numbers[-keep:] for f in self.version(n).folders.values()}
        for n in numbers[:-keep]:
            self._files.delete(self._to_path(f"{self.path}/versions/{n:012d}.json"), False)
        data = self._to_path(f"{self.path}/data")
        for s in self._files.listStatus(data) if self._files.exists(data) else []:
            if s.getPath().getName() not in held:
                self._files.delete(s.getPath(), True)
