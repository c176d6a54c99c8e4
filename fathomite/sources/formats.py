"""Landed files and run traces as data sources: ``spark.read.format("landed_texts")`` and ``"run_traces"``.

``register`` makes them known to a session. Files are listed by the driver and packed into partitions by their bytes. The
schema that is asked for is what is read: without ``text`` (or ``document``) and ``error`` no file is opened. A filter
``stem = ...`` or ``stem IN (...)`` leaves other files unread.
A file that cannot be read or parsed is a row with an error, and the others are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from fnmatch import fnmatch

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: Bytes of files in a partition; a larger file is a partition of its own, as it is read whole.
PARTITION_BYTES = 64 << 20


@dataclass
class Found:
    path: str
    stem: str
    length: int
    modified: datetime | None


@dataclass
class Files(InputPartition):
    files: list[Found]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, local without a scheme, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def listed(path: str, pattern: str) -> list[Found]:
    """Files under ``path``, or itself, whose name fits ``pattern``, in the order of their paths; hidden ones left out."""
    fs, place = opened(path)
    top = fs.get_file_info(place)
    if top.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    infos = [top] if top.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(place, recursive=True))
    hidden = lambda i: any(part[:1] in ("_", ".") for part in i.path[len(place) :].split("/"))
    kept = [i for i in infos if i.type == pafs.FileType.File and fnmatch(i.base_name, pattern) and not hidden(i)]
    utc = lambda t: t.astimezone(timezone.utc) if t else None
    return [Found(i.path, i.base_name.rsplit(".", 1)[0], i.size, utc(i.mtime)) for i in sorted(kept, key=lambda i: i.path)]


def packed(files: list[Found], most: int) -> list[Files]:
    """Files in turn, closed into a partition before it would have more than ``most`` bytes."""
    parts: list[Files] = []
    size = 0
    for f in files:
        if not parts or size + f.length > most:
            parts.append(Files([]))
            size = 0
        parts[-1].files.append(f)
        size += f.length
    return parts


class FileReader(DataSourceReader):
    """Rows of files by the columns asked for; ``content`` says what the bytes of a file are."""

    def __init__(self, options: dict[str, str], schema: StructType, content: list[str]):
        self.path, self.pattern = options.get("path"), options.get("pattern", "*")
        if not self.path:
            raise ValueError("the path to read is missing")
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))
        self.names, self.content = schema.fieldNames(), content
        self.stems: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("stem",):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.stems = own if self.stems is None else self.stems & own
            else:
                yield f

    def partitions(self) -> list[Files]:
        files = [f for f in listed(self.path, self.pattern) if self.stems is None or f.stem in self.stems]
        return packed(files, self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        wanted = bool(set(self.names) & set(self.content))
        for f in partition.files:
            row = {"path": f.path, "stem": f.stem, "length": f.length, "modified": f.modified}
            if wanted:
                try:
                    with fs.open_input_stream(f.path) as stream:
                        row |= self.parsed(stream.read())
                except (OSError, ValueError) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
            yield tuple(row.get(n) for n in self.names)

    def parsed(self, data: bytes) -> dict[str, str]:
        raise NotImplementedError


class TextReader(FileReader):
    def parsed(self, data: bytes) -> dict[str, str]:
        return {"text": data.decode("utf-8")}


class TraceReader(FileReader):
    def parsed(self, data: bytes) -> dict[str, str]:
        """A trace, bare or as the one field ``canonical`` of an object, and its run's id."""
        trace = json.loads(data.decode("utf-8"))
        if isinstance(trace, dict) and isinstance(trace.get("canonical"), dict):
            trace = trace["canonical"]
        if not isinstance(trace, dict):
            raise ValueError("a trace is an object")
        run = trace.get("run_id")
        return {"run_id": None if run is None else str(run), "document": json.dumps(trace, ensure_ascii=False)}


class LandedTexts(DataSource):
    """(path, stem, length, modified, text, error); options path, pattern and partitionBytes. Texts are UTF-8."""

    @classmethod
    def name(cls) -> str:
        return "landed_texts"

    def schema(self) -> str:
        return "path string, stem string, length bigint, modified timestamp, text string, error string"

    def reader(self, schema: StructType) -> FileReader:
        return TextReader(self.options, schema, ["text", "error"])


class RunTraces(DataSource):
    """(path, stem, length, modified, run_id, document, error); options as for texts. ``document`` is the trace as JSON."""

    @classmethod
    def name(cls) -> str:
        return "run_traces"

    def schema(self) -> str:
        return "path string, stem string, length bigint, modified timestamp, run_id string, document string, error string"

    def reader(self, schema: StructType) -> FileReader:
        return TraceReader(self.options, schema, ["run_id", "document", "error"])


def register(spark: SparkSession) -> None:
    """Make both known to ``spark``, and let its Python sources take filters, without which Spark refuses these."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (LandedTexts, RunTraces):
        spark.dataSource.register(source)
