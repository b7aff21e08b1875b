"""Frames of camera sessions as a stream: a Python data source over files ``<session>/<microseconds>.<ending>``.

A micro-batch takes the files that were written after the last one's and until ``settle`` seconds ago, so a
file that becomes visible a little late is still taken, once. The offset is that time, so a query that starts again from its
checkpoint reads the same files for an unfinished batch, and goes on behind it: no frame is lost or repeated, as long as files aren't
changed after they were written. Each partition holds stretches of sessions in order of time, of about
``partition_bytes``; a session longer than that is several stretches. Nothing is read before a task reads its own.

    spark.dataSource.register(Frames)
    spark.readStream.format("frames").option("path", folder).load()
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import _store
from .packaging import ship

SCHEMA = "session_id long, ts timestamp, path string, content binary, read_error string"


@dataclass
class Stretch(InputPartition):
    """(path, session, microseconds) of frames in the order in which they are read."""

    frames: tuple


def found(path: str) -> list[tuple[int, int, int, int, str]]:
    """(written, session, microseconds, bytes, path) of all frame files; others are passed over."""
    from pyarrow import fs

    store, inner, before = _store(path)
    out = []
    for i in store.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)):
        session, stem = i.path.split("/")[-2], i.base_name.partition(".")[0]
        if i.type == fs.FileType.File and session.isdigit() and stem.isdigit() and "." in i.base_name:
            out.append((i.mtime_ns // 1000, int(session), int(stem), i.size, before + i.path))
    return out


def planned(files: list[tuple], partition_bytes: int) -> list[Stretch]:
    """Stretches of about so many bytes, by session and time."""
    out, held, size = [], [], 0
    for _, session, micros, n, path in sorted(files, key=lambda f: (f[1], f[2], f[4])):
        if held and size + n > partition_bytes:
            out.append(Stretch(tuple(held)))
            held, size = [], 0
        held.append((path, session, micros))
        size += n
    return out + ([Stretch(tuple(held))] if held else [])


def read(stretch: Stretch) -> Iterator[tuple]:
    """A row for each frame; one that can't be read has the reason instead of its content."""
    from datetime import datetime, timedelta, timezone

    for path, session, micros in stretch.frames:
        ts, content, error = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros), None, None
        try:
            store, inner, _ = _store(path)
            with store.open_input_stream(inner) as f:
                content = f.read()
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:500]
        yield session, ts, path, content, error


class Frames(DataSource):
    """Options: path, settle (seconds, 1), partition_bytes (32 MB)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def _bytes(self) -> int:
        return int(self.options.get("partition_bytes", 32_000_000))

    def reader(self, schema) -> DataSourceReader:
        return FramesReader(self.options["path"], self._bytes())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FramesStream(self.options["path"], float(self.options.get("settle", 1)), self._bytes())


class FramesReader(DataSourceReader):
    """All frames that are there."""

    def __init__(self, path: str, partition_bytes: int):
        self.path, self.bytes = path, partition_bytes

    def partitions(self) -> list[Stretch]:
        return planned(found(self.path), self.bytes) or [Stretch(())]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        yield from read(partition)


class FramesStream(DataSourceStreamReader):
    def __init__(self, path: str, settle: float, partition_bytes: int):
        self.path, self.settle, self.bytes = path, settle, partition_bytes
        self.last = 0

    def initialOffset(self) -> dict:
        return {"written": 0}

    def latestOffset(self) -> dict:
        settled = int((time.time() - self.settle) * 1_000_000)
        self.last = max([self.last, *(f[0] for f in found(self.path) if f[0] <= settled)])
        return {"written": self.last}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return planned([f for f in found(self.path) if start["written"] < f[0] <= end["written"]], self.bytes)

    def read(self, partition: Stretch) -> Iterator[tuple]:
        yield from read(partition)


def register(spark: SparkSession) -> None:
    """Make format("frames") known to a session."""
    ship(spark)
    spark.dataSource.register(Frames)
