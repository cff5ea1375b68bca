"""Lines appended to log files, as a stream whose offsets are bytes of files.

A file is known by its inode and a checksum of its first line, so a rotated file is read
to its end under its new name and the new file of the old name from its beginning; so is
a file that was cut short and written anew. A line counts once its line end is written,
a half-written one waits for the next batch. Large growth is read in several partitions.

The folders have to be reachable from the driver and all executors (a shared mount);
stores without appends need no such reader, their new files are ``stream_log``'s.
"""

from __future__ import annotations

import glob
import json
import os
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "value string, file_key string, block_start bigint, line_id bigint"
SPLIT_BYTES = 16 << 20
BLOCK_BYTES = 1 << 20  # of one read and one batch of lines
HEAD_BYTES = 256


def _local(path: str) -> str:
    """A path as the file system knows it, with or without ``file:``."""
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme == "file" else path


@dataclass
class Stretch(InputPartition):
    """Lines of one file that begin at a byte in [first, last); ``start`` begins a line."""

    path: str
    inode: int
    key: str
    start: int
    first: int
    last: int


def _head(file) -> int | None:
    """Checksum of the first line, or of its first bytes; None before it is written."""
    file.seek(0)
    head = file.read(HEAD_BYTES)
    end = head.find(b"\n") + 1
    if not end and len(head) < HEAD_BYTES:
        return None
    return zlib.crc32(head[: end or HEAD_BYTES])


def _whole_lines(file, size: int, floor: int) -> int:
    """The byte after the last line end before ``size``, at least ``floor``."""
    at = size
    while at > floor:
        begin = max(floor, at - BLOCK_BYTES)
        file.seek(begin)
        found = file.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return floor


class TailReader(DataSourceStreamReader):
    def __init__(self, paths: list[str], files_per_batch: int, split_bytes: int):
        self._paths, self._most, self._split = paths, files_per_batch, split_bytes
        self._known: dict[str, dict] | None = None

    def initialOffset(self) -> dict:
        return {}

    def _files(self) -> Iterator[str]:
        for path in self._paths:
            found = glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path)
            yield from (f for f in sorted(found) if os.path.isfile(f) and os.path.basename(f)[0] not in "._")

    def latestOffset(self) -> dict:
        known, offsets, new = self._known or {}, {}, 0
        for path in self._files():
            try:
                with open(path, "rb") as file:
                    state = os.fstat(file.fileno())
                    head = _head(file)
                    if head is None:
                        continue
                    name = f"{state.st_ino}-{head}"
                    before = known.get(name)
                    if before is None:
                        new += 1
                        if new > self._most:
                            continue
                    floor = before["end"] if before and before["end"] <= state.st_size else 0
                    end = _whole_lines(file, state.st_size, floor)
                    if end:
                        offsets[name] = {"path": path, "key": before["key"] if before else path, "end": end}
            except FileNotFoundError:  # renamed since it was listed: met again at the next call
                if before := next((n for n, k in known.items() if k["path"] == path), None):
                    offsets[before] = known[before]
        self._known = offsets
        return offsets

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self._known is None:  # a restarted query first plans its last batch again
            self._known = end
        found = []
        for name, now in end.items():
            begin = start[name]["end"] if name in start and start[name]["end"] <= now["end"] else 0
            cuts = [*range(begin, now["end"], self._split), now["end"]]
            inode = int(name.partition("-")[0])
            found += [Stretch(now["path"], inode, now["key"], begin, a, b) for a, b in zip(cuts, cuts[1:])]
        return found

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        with open(self._path_of(partition), "rb") as file:
            at = partition.first
            if at > partition.start:  # the line that is under way belongs to the stretch before
                file.seek(at - 1)
                at += len(file.readline()) - 1
            file.seek(at)
            while at < partition.last:
                lines = file.readlines(BLOCK_BYTES)
                places = []
                for line in lines:
                    if at >= partition.last:
                        break
                    places.append(at)
                    at += len(line)
                values = [line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace") for line in lines[: len(places)]]
                yield pa.RecordBatch.from_pydict(
                    {"value": values, "file_key": [partition.key] * len(places),
                     "block_start": [0] * len(places), "line_id": places},
                    schema=pa.schema([("value", pa.string()), ("file_key", pa.string()),
                                      ("block_start", pa.int64()), ("line_id", pa.int64())]),
                )

    @staticmethod
    def _path_of(partition: Stretch) -> str:
        """Where the file is now: it may have been renamed since the batch was planned."""
        folder = os.path.dirname(partition.path)
        for path in [partition.path, *(os.path.join(folder, n) for n in os.listdir(folder))]:
            try:
                if os.stat(path).st_ino == partition.inode:
                    return path
            except FileNotFoundError:
                continue
        raise FileNotFoundError(f"{partition.path} was removed before all of its lines were read")

    def commit(self, end: dict) -> None:
        """Nothing to keep: offsets are in the stream's checkpoint."""

    def stop(self) -> None:
        """No file stays open between calls."""


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        paths = [_local(p) for p in json.loads(self.options["paths"])]
        most = int(self.options.get("files_per_batch", 1 << 30))
        return TailReader(paths, most, int(self.options.get("split_bytes", SPLIT_BYTES)))


def tail_log(
    spark: SparkSession, paths: str | list[str], files_per_batch: int | None = None, split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """Growing files of folders, or of patterns, as lines with their place: ``file_key``
    is the path under which a file was first seen and ``line_id`` the byte a line begins at.

    ``files_per_batch`` limits how many files join a batch for the first time, in the
    order of ``paths`` and names; such streams are run with :func:`live.caught_up`.
    """
    spark.dataSource.register(TailSource)
    source = spark.readStream.format("log_tail").option("paths", json.dumps([paths] if isinstance(paths, str) else paths))
    if files_per_batch:
        source = source.option("files_per_batch", files_per_batch)
    return source.option("split_bytes", split_bytes).load()
