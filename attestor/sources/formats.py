"""File formats for spark.read and spark.readStream: documents with front matter, YAML and JSON registries, dated logs, keyed
states. `register(spark)` makes them known; then

    spark.read.format("front_matter").load(path)
    spark.read.format("registry").option("array", "sources").load(path)
    spark.read.format("dated_log").load(path);  spark.readStream.format("dated_log").load(path)
    spark.read.format("keyed_state").option("section", "pages").load(path)

Options: pattern (of file names), mode (lenient, the default: what can't be read is a row with its error; strict: it stops the job).
Paths may be of any store that pyarrow knows (a plain path, file:, hdfs:, s3: ...). Small files share a partition and
large logs are cut into ranges of bytes, so neither many files nor long ones gather in one task."""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from attestor.session import ship_package
from attestor.sources.files import parse_front_matter

try:  # only YAML registries need it
    import yaml
except ImportError:
    yaml = None

#: Bytes of small files read in one task, and of a range of a log.
PARTITION_BYTES = 16 << 20


@dataclass
class Span(InputPartition):
    """Ranges of bytes of files: (path, start, end)."""

    ranges: list[tuple[str, int, int]]


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:") :])
    return pyarrow.fs.LocalFileSystem(), path


def listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """(path in its store, size) of the files below path, in order of their paths. Files that begin with _ or . are none."""
    files, root = _store(path)
    info = files.get_file_info(root)
    if info.type == pyarrow.fs.FileType.File:
        return [(root, info.size)]
    found = files.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == pyarrow.fs.FileType.File and fnmatch(f.base_name, pattern) and f.base_name[0] not in "_.")


class _Options:
    def __init__(self, options: dict, pattern: str):
        self.path, self.pattern = options["path"], options.get("pattern", pattern)
        self.strict = options.get("mode", "lenient").lower() == "strict"
        self.array, self.section = options.get("array", ""), options.get("section", "")


class _WholeFiles(DataSourceReader):
    """Each file is read whole by one task; `rows` makes its rows."""

    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Span]:
        spans, size = [Span([])], 0
        for path, n in listed(self.options.path, self.options.pattern):
            if spans[-1].ranges and size + n > PARTITION_BYTES:
                spans.append(Span([]))
                size = 0
            spans[-1].ranges.append((path, 0, n))
            size += n
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        files, _ = _store(self.options.path)
        for path, _, _ in partition.ranges:
            with files.open_input_stream(path) as f:
                data = f.read()
            try:
                yield from self.rows(path, data)
            except Exception as e:
                if self.options.strict:
                    raise ValueError(f"{path}: {e}") from e
                yield self.broken(path, data, str(e))


class _FrontMatterReader(_WholeFiles):
    def rows(self, path: str, data: bytes) -> Iterator[tuple]:
        found = parse_front_matter(data.decode("utf-8"))
        if found is None:
            raise ValueError("no front matter")
        yield path, found[0], found[1], hashlib.sha256(data).hexdigest(), None

    def broken(self, path: str, data: bytes, error: str) -> tuple:
        return path, {}, data.decode("utf-8", "replace"), hashlib.sha256(data).hexdigest(), error


def _tree(path: str, data: bytes) -> dict:
    text = data.decode("utf-8")
    if path.endswith((".yml", ".yaml")):
        if yaml is None:
            raise ImportError("YAML registries need PyYAML")
        found = yaml.safe_load(text) or {}
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError("the root must be a mapping")
    return found


def _text(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)  # YAML has dates


class _RegistryReader(_WholeFiles):
    def rows(self, path: str, data: bytes) -> Iterator[tuple]:
        items = _tree(path, data).get(self.options.array) or []
        if not isinstance(items, list):
            raise ValueError(f"{self.options.array} must be a list")
        for k, item in enumerate(items):
            yield path, k, _text(item), None

    def broken(self, path: str, data: bytes, error: str) -> tuple:
        return path, None, None, error


class _StateReader(_WholeFiles):
    def rows(self, path: str, data: bytes) -> Iterator[tuple]:
        for key, value in (_tree(path, data).get(self.options.section) or {}).items():
            yield path, str(key), _text(value), None

    def broken(self, path: str, data: bytes, error: str) -> tuple:
        return path, None, None, error


def lines_of(files: pyarrow.fs.FileSystem, path: str, start: int, end: int) -> Iterator[tuple[str, int, str]]:
    """(path, offset, line) of the lines that begin in [start, end); the last may end behind it."""
    with files.open_input_file(path) as f:
        at = start
        if start:  # a line that begins before belongs to the range before
            f.seek(start - 1)
            at = start - 1 + len(_line(f))
        f.seek(at)
        while at < end:
            line = _line(f)
            if not line:
                return
            if line.strip():
                yield path, at, line.decode("utf-8", "replace").rstrip("\r\n")
            at += len(line)
            f.seek(at)


def _line(f: pyarrow.NativeFile) -> bytes:
    """The bytes from the file's place to the end of its line."""
    out = []
    while True:
        piece = f.read(1 << 16)
        cut = piece.find(b"\n")
        if cut >= 0 or not piece:
            out.append(piece[: cut + 1] if cut >= 0 else b"")
            return b"".join(out)
        out.append(piece)


class _LogReader(DataSourceReader):
    def __init__(self, options: _Options):
        self.options = options

    def partitions(self) -> list[Span]:
        ranges = [(p, k, min(n, k + PARTITION_BYTES)) for p, n in listed(self.options.path, self.options.pattern) for k in range(0, n, PARTITION_BYTES)]
        spans, size = [Span([])], 0
        for r in ranges:
            if spans[-1].ranges and size + r[2] - r[1] > PARTITION_BYTES:
                spans.append(Span([]))
                size = 0
            spans[-1].ranges.append(r)
            size += r[2] - r[1]
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        files, _ = _store(self.options.path)
        for path, start, end in partition.ranges:
            yield from lines_of(files, path, start, end)


class _LogStream(DataSourceStreamReader):
    """Offsets are the bytes of each file that have been read; a line counts once its end is there."""

    def __init__(self, options: _Options):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, _ = _store(self.options.path)
        return {path: self._whole(files, path, n) for path, n in listed(self.options.path, self.options.pattern)}

    @staticmethod
    def _whole(files: pyarrow.fs.FileSystem, path: str, size: int) -> int:
        """The end of the last whole line."""
        with files.open_input_file(path) as f:
            end = size
            while end:
                begin = max(0, end - (1 << 16))
                f.seek(begin)
                cut = f.read(end - begin).rfind(b"\n")
                if cut >= 0:
                    return begin + cut + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Span]:
        new = [(p, start.get(p, 0), n) for p, n in end.items() if n > start.get(p, 0)]
        return [Span([(p, k, min(n, k + PARTITION_BYTES))]) for p, a, n in new for k in range(a, n, PARTITION_BYTES)] or [Span([])]

    def read(self, partition: Span) -> Iterator[tuple]:
        yield from _LogReader(self.options).read(partition)

    def commit(self, end: dict) -> None:
        pass


class FrontMatter(DataSource):
    @classmethod
    def name(cls) -> str:
        return "front_matter"

    def schema(self) -> str:
        return "path string, meta map<string,array<string>>, body string, raw_sha256 string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _FrontMatterReader(_Options(self.options, "*.md"))


class Registry(DataSource):
    @classmethod
    def name(cls) -> str:
        return "registry"

    def schema(self) -> str:
        return "path string, position int, item string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _RegistryReader(_Options(self.options, "*.y*ml"))


class KeyedState(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_state"

    def schema(self) -> str:
        return "path string, key string, value string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _StateReader(_Options(self.options, "*.json"))


class DatedLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dated_log"

    def schema(self) -> str:
        return "path string, at long, line string"

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(_Options(self.options, "20??-??-??.jsonl"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LogStream(_Options(self.options, "20??-??-??.jsonl"))


def register(spark: SparkSession) -> None:
    ship_package(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers that plan a source have no shipped package
    for source in (FrontMatter, Registry, KeyedState, DatedLog):
        spark.dataSource.register(source)


def parsed(rows: DataFrame, column: str, schema: str, strict: bool = False) -> DataFrame:
    """rows with the fields of a JSON column in its place. What doesn't parse is left out, or stops the job if strict."""
    kept = [c for c in rows.columns if c != column]
    options = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}
    found = rows.withColumn("__json", F.from_json(column, schema if strict else f"{schema}, __corrupt string", options))
    fine = found.where(F.col("__json").isNotNull() & (F.lit(True) if strict else F.col("__json.__corrupt").isNull()))
    return fine.select(*kept, "__json.*").drop("__corrupt")
