"""A registered data source over a folder where a fetcher lands its responses.

`spark.read.format("landed")` and `spark.readStream.format("landed")` give (path, record, modified, value,
corrupt). What can't be read is a row too: its value is null and `corrupt` says why, so one broken file
doesn't stop a run and can be looked into. Options:

- path: a folder of any store that pyarrow knows by its URI, or a local one that all executors share;
  files in folders below count, names that start with a dot or underscore don't
- kind: `text` (a file is a value), `json` (so too, if it is JSON), `lines`, or `jsonl` (each line
  is a value, and JSON)
- partition_bytes: files are packed into partitions of this size, by size on disk
- settle: seconds since a file's last change before a stream takes it

Names with .gz are unpacked; lines are read one by one, whole files at once. A stream's offset is the last
file by (modified, path): each file comes once, if files are moved in whole and their times are those of landing.
"""

from __future__ import annotations

import datetime as dt
import gzip
import io
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, record int, modified timestamp, value string, corrupt string"
KINDS = ("text", "json", "lines", "jsonl")


@dataclass
class Files(InputPartition):
    """(path, modified in ms) of the files of a partition."""

    files: tuple[tuple[str, int], ...]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Landing:
    """What the reader and the stream reader share."""

    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "text")
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {KINDS}, not {self.kind}")
        self.partition_bytes, self.settle = int(options.get("partition_bytes", 32 << 20)), float(options.get("settle", 1))

    def listed(self) -> list[tuple[int, str, int]]:
        """(modified in ms, path, bytes) of all files, in order."""
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        shown = lambda p: not any(x[0] in "._" for x in p.removeprefix(root).split("/") if x)
        return sorted((f.mtime_ns // 1_000_000, f.path, f.size) for f in found if f.is_file and shown(f.path))

    def packed(self, found: list[tuple[int, str, int]]) -> list[Files]:
        out, size = [[]], 0
        for modified, path, n in found:
            if out[-1] and size + n > self.partition_bytes:
                out.append([])
                size = 0
            out[-1].append((path, modified))
            size += n
        return [Files(tuple(files)) for files in out if files]

    def read(self, partition: Files | None) -> Iterator[tuple]:
        """Records of a partition; Spark asks with none where there are no files."""
        store, _ = _store(self.path)
        for path, modified in partition.files if partition else ():
            at = dt.datetime.fromtimestamp(modified / 1000, dt.timezone.utc)
            record = 0
            try:
                with store.open_input_stream(path, compression=None) as raw:
                    stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw)
                    for value in stream if self.kind in ("lines", "jsonl") else (stream.read(),):
                        yield path, record, at, *self.told(value.rstrip(b"\r\n") if self.kind in ("lines", "jsonl") else value)
                        record += 1
            except (OSError, EOFError) as e:  # gone, cut off or no gzip
                yield path, record, at, None, f"unreadable: {e}"

    def told(self, raw: bytes) -> tuple[str | None, str | None]:
        """(value, corrupt) of a record."""
        try:
            value = raw.decode()
            if self.kind in ("json", "jsonl"):
                json.loads(value)
        except UnicodeDecodeError as e:
            return None, f"no UTF-8 at byte {e.start}: {raw[:200].decode(errors='replace')}"
        except (ValueError, RecursionError) as e:
            return None, f"no JSON ({e}): {value[:200]}"
        return value, None


class LandedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.landing = Landing(options)

    def partitions(self) -> list[Files]:
        return self.landing.packed(self.landing.listed())

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.landing.read(partition)


class LandedStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.landing = Landing(options)
        self.last = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        now = (time.time() - self.landing.settle) * 1000
        settled = [(m, p) for m, p, _ in self.landing.listed() if m <= now]
        if settled and settled[-1] > (self.last["modified"], self.last["path"]):
            self.last = dict(zip(("modified", "path"), settled[-1]))
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = ((x["modified"], x["path"]) for x in (start, end))
        return self.landing.packed([f for f in self.landing.listed() if low < f[:2] <= high])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.landing.read(partition)

    def commit(self, end: dict) -> None:
        pass


class LandedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options)

    def streamReader(self, schema) -> LandedStream:
        return LandedStream(self.options)


def read(spark: SparkSession, path: str, kind: str = "text", **options: str) -> DataFrame:
    """(path, record, modified, value, corrupt) of the files landed below a path."""
    spark.dataSource.register(LandedFiles)
    return spark.read.format("landed").options(kind=kind, path=path, **options).load()


def read_stream(spark: SparkSession, path: str, kind: str = "text", **options: str) -> DataFrame:
    """As read, of files as they land."""
    spark.dataSource.register(LandedFiles)
    return spark.readStream.format("landed").options(kind=kind, path=path, **options).load()
