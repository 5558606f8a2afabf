"""Growing log files as a stream: a Python data source with an offset for every file.

An offset is the place in each file up to which all entries are whole. A batch reads the bytes between two offsets, so a file that grows after
its batch is read on where the last one ended, and an entry that is still being written waits until the next header follows
it, or until its file has been idle for ``idleSeconds``. The driver reads only the ends of changed files, backwards, to find the last header;
ranges are cut into partitions of ``splitBytes`` at line starts.

Paths go through Arrow's file systems (``file``, ``hdfs``, ``s3``, ``gs``). A file that got shorter was replaced and is read from its start.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from kbweave.sources.streams import LOG_HEADER

NAME = "growing_logs"
TAIL_BYTES = 1 << 16
ROWS = 1000
_HEADER = re.compile(LOG_HEADER.encode(), re.M)


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def whole_entries(store, path: str, start: int, size: int, idle: bool) -> int:
    """The place after the last whole entry of a file: where its last header starts or, for an idle file, its end."""
    if idle or size <= start:
        return size
    with store.open_input_file(path) as file:
        stop, later = size, b""
        while stop > start:
            begin = max(start, stop - TAIL_BYTES)
            file.seek(begin)
            text = file.read(stop - begin) + later
            # A header at a read's first byte counts only if a line starts there; a cut line may look like one.
            found = [m.start() for m in _HEADER.finditer(text) if m.start() or begin == start]
            if found:
                return begin + found[-1]
            stop, later = begin, text[:256]
    return start


@dataclass
class Range(InputPartition):
    path: str
    first: int  # where the batch's part of the file starts
    start: int
    stop: int
    last: int  # where it ends


def lines_of(part: Range) -> Iterator[tuple[int, bytes]]:
    """Place and text of the lines that start in a partition."""
    store, path = _opened(part.path)
    with store.open_input_file(path) as file:
        at, held = part.start, b""
        if part.start > part.first:
            at -= 1  # the line before ends here, or runs on into this partition
        file.seek(at)
        skip = part.start > part.first
        read = at
        while at < part.stop:
            data = file.read(min(1 << 20, part.last - read))
            read += len(data)
            held += data
            *whole, held = held.split(b"\n")
            if not data:
                whole, held = ([held] if held else []), b""
            for line in whole:
                if not skip and at < part.stop:
                    yield at, line.removesuffix(b"\r")
                skip = False
                at += len(line) + 1
            if not data:
                return


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.pattern = re.compile(options.get("pattern", r".*"))
        self.idle = float(options.get("idleseconds", options.get("idleSeconds", "3600")))
        self.split = int(options.get("splitbytes", options.get("splitBytes", str(64 << 20))))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        from pyarrow import fs

        store, folder = _opened(self.path)
        scheme = self.path[: len(self.path) - len(folder)] if self.path.endswith(folder) else ""
        ends = {}
        for info in store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)):
            if not info.is_file or info.base_name.startswith(("_", ".")) or not self.pattern.fullmatch(info.base_name):
                continue
            start = self.known.get(info.path, 0)
            start = start if start <= info.size else 0
            idle = info.mtime is not None and time.time() - info.mtime.timestamp() >= self.idle
            ends[scheme + info.path] = self.known[info.path] = whole_entries(store, info.path, start, info.size, idle)
        return {path: ends[path] for path in sorted(ends)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        ranges = []
        for path, stop in end.items():
            first = start.get(path, 0)
            first = first if first <= stop else 0
            for at in range(first, stop, self.split):
                ranges.append(Range(path, first, at, min(at + self.split, stop), stop))
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes]] = []

        def batch() -> pa.RecordBatch:
            n = len(rows)
            texts = pa.array([line.decode("utf-8", "replace") for _, line in rows], pa.string())
            columns = [pa.array([partition.path] * n, pa.string()), pa.array([partition.start] * n, pa.int64()), pa.array([at for at, _ in rows], pa.int64()), texts]
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "place", "value"])

        for row in lines_of(partition):
            rows.append(row)
            if len(rows) == ROWS:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    def commit(self, end: dict) -> None:
        pass


class GrowingLogs(DataSource):
    """``file, block, place, value``: the lines of log files below ``path``, as far as their entries are whole."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file string, block long, place long, value string"

    def streamReader(self, schema) -> GrowingLogReader:  # noqa: N802
        return GrowingLogReader(dict(self.options))


def follow_logs(spark: SparkSession, path: str, idle_seconds: float = 3600, split_bytes: int = 64 << 20, pattern: str = ".*") -> DataFrame:
    """The stream of lines of all files below ``path`` whose names match ``pattern``."""
    spark.dataSource.register(GrowingLogs)
    reader = spark.readStream.format(NAME).option("path", path).option("idleSeconds", str(idle_seconds))
    return reader.option("splitBytes", str(split_bytes)).option("pattern", pattern).load()
