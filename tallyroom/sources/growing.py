"""Log files that are still being written, as a streaming source.

An offset is a byte in each file. A batch reads what lies between two offsets, cut into byte ranges that are read side by side;
a range takes the lines that begin in it. The end of a batch is the last line end that was there when the batch
was planned, so a line that is still being written waits for its end and every line is read in exactly one batch.
A file that is shorter than its offset was begun anew and is read from its beginning; one that was begun anew and has grown
beyond its offset since cannot be told from a longer one, so logs are better rotated to new names.

Files are ``<folder>/<namespace>/<file>``, or ``namespace=<namespace>`` for that part. Any folder that pyarrow's file systems open will do;
tasks have to reach it by the same address.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "namespace string, value string, file string, block bigint, line_no bigint"
#: Bytes of a file that one task reads, and that are looked at together.
RANGE, PIECE = 64_000_000, 1_000_000


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def line_end(system: fs.FileSystem, path: str, start: int, size: int) -> int:
    """After the last line end between ``start`` and ``size``; ``start`` if there is none."""
    with system.open_input_file(path) as f:
        at = size
        while at > start:
            low = max(start, at - PIECE)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return start


@dataclass
class ByteRange(InputPartition):
    path: str
    namespace: str
    first: int
    start: int
    end: int
    last: int


def lines_of(system: fs.FileSystem, part: ByteRange) -> Iterator[pa.RecordBatch]:
    """The lines that begin in a range. ``first`` and ``last`` are line starts; what begins before ``end`` is read to its end."""
    with system.open_input_file(part.path) as f:
        at = part.start
        if at > part.first:  # go to the first line start: after the line end at or behind the byte before
            at = _next_line(f, at - 1, part.last)
        while at < part.end:
            f.seek(at)
            size = min(PIECE, part.last - at)
            data = f.read(size)
            cut = data.rfind(b"\n") + 1
            while not cut and at + size < part.last:  # one line longer than a piece
                size = min(2 * size, part.last - at)
                f.seek(at)
                data = f.read(size)
                cut = data.rfind(b"\n") + 1
            if not cut:
                return
            texts, places = [], []
            for raw in data[: cut - 1].split(b"\n"):
                if at >= part.end:
                    break
                texts.append(raw.removesuffix(b"\r").decode("utf-8", "replace"))
                places.append(at)
                at += len(raw) + 1
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.namespace] * n, pa.string()), pa.array(texts, pa.string()), pa.array([part.path] * n, pa.string()),
                 pa.array([part.start] * n, pa.int64()), pa.array(places, pa.int64())], ["namespace", "value", "file", "block", "line_no"])


def _next_line(f: pa.NativeFile, at: int, last: int) -> int:
    while at < last:
        f.seek(at)
        data = f.read(min(PIECE, last - at))
        found = data.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(data)
    return last


class GrowingLogs(DataSource):
    """``readStream.format("growing_logs").option("path", folder)``; the option ``range`` bounds the bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)))


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, width: int):
        self.folder, self.width = folder, width

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        system, root = opened(self.folder)
        found = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and not info.base_name.startswith((".", "_")):
                found[info.path] = line_end(system, info.path, 0, info.size)
        return {"files": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, last in after.items():
            first = before.get(path, 0)
            first = first if first <= last else 0
            space = path.rsplit("/", 2)[-2] if "namespace=" not in path else path.split("namespace=", 1)[1].split("/", 1)[0]
            out += [ByteRange(path, space, first, k, min(k + self.width, last), last) for k in range(first, last, self.width)]
        return out or [ByteRange("", "", 0, 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from lines_of(opened(self.folder)[0], partition)


def growing_logs(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    """Stream of the lines in growing files: namespace, value, file, block and the byte at which the line begins."""
    spark.dataSource.register(GrowingLogs)
    reader = spark.readStream.format("growing_logs").option("path", folder)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()
