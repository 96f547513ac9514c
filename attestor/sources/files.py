"""File sources: front-matter documents, registries, event logs, keyed states."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestor.session import ship_package

FENCE = "---\n"


def _scalar(value: str) -> object:
    value = value.strip()
    if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
        return value[1:-1]
    if value.startswith("[") and value.endswith("]"):
        return [_scalar(v) for v in value[1:-1].split(",") if v.strip()]
    return value


def parse_front_matter(text: str) -> tuple[dict[str, list[str]], str] | None:
    """(meta, body) of a document that opens with a fence; None if it has no closed front matter. A plain YAML subset:
    scalars, quoted scalars, flow and block lists, and continued lines. Every value is a list of strings."""
    text = text.replace("\r\n", "\n")
    if not text.startswith(FENCE) or "\n---" not in text[3:]:
        return None
    head, _, body = text[len(FENCE) :].partition("\n---")
    meta: dict[str, list[str]] = {}
    key = None
    for line in head.split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line[0] in " \t-" and key is not None:
            item = line.strip()
            if item.startswith("- "):
                meta[key].append(str(_scalar(item[2:])))
            elif meta[key]:
                meta[key][-1] += " " + item
            else:
                meta[key].append(item)
        elif ":" in line:
            key, _, raw = line.partition(":")
            key, value = key.strip(), _scalar(raw)
            meta[key] = [str(v) for v in value] if isinstance(value, list) else [value] if value not in ("", "null", "~") else []
        else:
            return None
    return meta, body.partition("\n")[2]


def read_front_matter(spark: SparkSession, path: str, pattern: str = "*.md", strict: bool = False) -> DataFrame:
    """path, meta MAP<STRING, ARRAY<STRING>>, body, raw_sha256, readable for each file below path. Unreadable files
    have an empty meta and readable = false, or stop the job if strict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_front_matter(t or "") for t in batch.column(1).to_pylist()]
            if strict and not all(found):
                raise ValueError(f"no front matter: {[p for p, f in zip(batch.column(0).to_pylist(), found, strict=True) if not f][:3]}")
            meta = pa.array([list(f[0].items()) if f else [] for f in found], pa.map_(pa.string(), pa.list_(pa.string())))
            body = pa.array([f[1] if f else t for f, t in zip(found, batch.column(1).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), meta, body, batch.column(2), pa.array([bool(f) for f in found])], names=["path", "meta", "body", "raw_sha256", "readable"])

    ship_package(spark)
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value"), F.sha2("value", 256).alias("raw_sha256"))
    return rows.mapInArrow(run, "path string, meta map<string,array<string>>, body string, raw_sha256 string, readable boolean")


def read_registry(spark: SparkSession, path: str, array: str, element: StructType | str) -> DataFrame:
    """The records of an array of a JSON registry, with a declared schema (never inferred)."""
    kind = element if isinstance(element, str) else element.simpleString()
    return spark.read.schema(f"`{array}` array<{kind}>").json(path, multiLine=True).select(F.inline(array))


def read_event_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of dated JSON-lines files; corrupt lines are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path, pathGlobFilter="20??-??-??.jsonl")
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_keyed_state(spark: SparkSession, path: str, section: str, value: str) -> DataFrame:
    """key and the fields of value for each entry of a section (a JSON object); no rows if the section is missing."""
    rows = spark.read.schema(f"`{section}` map<string, struct<{value}>>").json(path, multiLine=True)
    return rows.select(F.explode(section).alias("key", "value")).select("key", "value.*")
