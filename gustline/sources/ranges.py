"""Capture files as byte ranges: a Python data source that deals files of any size to tasks, and follows open sessions.

A session is a folder; its files, in name order, are one byte stream.  A batch
scan deals every file in ranges of ``rangeBytes``.  A stream remembers for each
session the last file it has seen and how far, so what is appended to that file
comes with the next batch, as do later files.  A file is closed when a later one
of its session appears.  Files are read through ``pyarrow.fs``, from any store
that it knows.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RANGE_BYTES = 64 << 20
CHUNK_SCHEMA = "session_id string, path string, offset bigint, file_length bigint, arrived double, content binary"


@dataclass(frozen=True)
class ByteRange(InputPartition):
    session: str
    path: str
    start: int
    end: int
    file_length: int
    arrived: float


@dataclass(frozen=True)
class Deal(InputPartition):
    """Ranges that one task reads."""

    ranges: tuple[ByteRange, ...]


#: Bytes that a task reads, where there are enough for TASKS of them.
TASK_BYTES = 32 << 20
TASKS = 64


def _deals(ranges: list[ByteRange]) -> list[Deal]:
    """Ranges in order, dealt to tasks: at most some TASK_BYTES each, in TASKS of them where they are few."""
    share = min(TASK_BYTES, sum(r.end - r.start for r in ranges) / TASKS)
    out: list[list[ByteRange]] = []
    size = 0
    for part in ranges:
        if not out or size + part.end - part.start > share:
            out.append([])
            size = 0
        out[-1].append(part)
        size += part.end - part.start
    return [Deal(tuple(d)) for d in out]


class _Folder:
    """The files below a folder, by session."""

    def __init__(self, options: dict):
        self.uri = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.arrival = re.compile(options["arrival"]) if options.get("arrival") else None
        self.from_start = options.get("anchor") == "start"

    def files(self) -> dict[str, list[tuple[str, int, float]]]:
        """Path, length and arrival in posix seconds of every session's files, in name order."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.uri)
        found: dict[str, list[tuple[str, int, float]]] = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = info.path.rsplit("/", 1)[-1]
            if info.type == fs.FileType.File and not name.startswith(("_", ".")):
                told = self.arrival.search(name) if self.arrival else None
                arrived = float(told[1]) if told else (info.mtime_ns or 0) / 1e9
                found.setdefault(info.path.rsplit("/", 2)[-2], []).append((info.path, info.size, arrived))
        return {session: sorted(files) for session, files in found.items()}

    def deal(self, session: str, path: str, start: int, end: int, arrived: float) -> list[ByteRange]:
        cuts, length = range(start, end, self.range_bytes), 0 if self.from_start else end
        return [ByteRange(session, path, at, min(at + self.range_bytes, end), length, arrived) for at in cuts]

    def read(self, deal: Deal) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.uri)
        for part in deal.ranges:
            with system.open_input_file(part.path) as file:
                content = file.read_at(part.end - part.start, part.start)
            yield part.session, part.path, part.start, part.file_length, part.arrived, content


class _Reader(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self) -> list[Deal]:
        listed = self.folder.files().items()
        return _deals([r for s, files in listed for path, size, at in files for r in self.folder.deal(s, path, 0, size, at)])

    def read(self, partition: Deal) -> Iterator[tuple]:
        return self.folder.read(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets hold, for each session, the last file seen and the bytes of it that were there."""

    def __init__(self, folder: _Folder):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {s: [files[-1][0], files[-1][1]] for s, files in self.folder.files().items()}

    def partitions(self, start: dict, end: dict) -> list[Deal]:
        out = []
        for session, files in self.folder.files().items():
            first, seen = start.get(session, ["", 0])
            last, length = end.get(session, ["", 0])
            for path, size, arrived in files:
                if first <= path <= last:
                    low, high = seen if path == first else 0, length if path == last else size
                    out += self.folder.deal(session, path, low, high, arrived)
        return _deals(out)

    def read(self, partition: Deal) -> Iterator[tuple]:
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class CaptureRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture_ranges"

    def schema(self) -> str:
        return CHUNK_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Folder(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Folder(self.options))


def _register(spark: SparkSession) -> None:
    # the process that plans a stream knows no shipped packages, so the source goes there whole
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(CaptureRanges)


def _options(path: str, range_bytes: int, arrival: str | None, anchor: str) -> dict[str, str]:
    plain = path if "://" in path else f"file://{path.removeprefix('file:')}"
    options = {"path": plain, "rangeBytes": str(range_bytes), "anchor": anchor}
    return options | ({"arrival": arrival} if arrival else {})


def read_ranges(
    spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, arrival: str | None = None, anchor: str = "end"
) -> DataFrame:
    """Byte ranges of all capture files below ``path``.

    ``arrival`` is a pattern whose first group in a file's name is the posix second at which its last byte arrived;
    without it, or a match, that is when the file was last written.  With ``anchor`` "start" it is the first byte's
    instead: files that still grow give their bytes times that stay (``file_length`` is 0 then).
    """
    _register(spark)
    return spark.read.format("capture_ranges").options(**_options(path, range_bytes, arrival, anchor)).load()


def stream_ranges(
    spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, arrival: str | None = None, anchor: str = "end"
) -> DataFrame:
    """Byte ranges as they are appended; see :func:`gustline.streaming.captures.frame_stream`."""
    _register(spark)
    return spark.readStream.format("capture_ranges").options(**_options(path, range_bytes, arrival, anchor)).load()
