"""Zip archives of any size as a data source: one partition a range of bytes, not one a file.

The driver looks at names and sizes only. A task reads the directory at the archive's end and unpacks the
members whose headers begin in its range, so an archive of many gigabytes is spread over many tasks. Paths
may be of any file system that Arrow knows.
"""

from __future__ import annotations

import re
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBERS = "archive string, path string, value string, problem string"

#: Bytes of archive a partition covers, and of text a batch holds.
SPLIT_BYTES, BATCH_BYTES = 64_000_000, 8_000_000

#: A member that unpacks to more is quarantined: a text column can't hold it.
MOST_MEMBER_BYTES = 1_000_000_000


@dataclass
class ByteRange(InputPartition):
    archive: str
    low: int
    high: int


def _open(archive: str):
    system, path = fs.FileSystem.from_uri(archive) if "://" in archive or archive.startswith("file:") else (fs.LocalFileSystem(), archive)
    return system.open_input_file(path)


def _archives(path: str) -> list[tuple[str, int]]:
    """(path with its scheme, bytes) of the archives below a folder, or of one archive."""
    remote = "://" in path or path.startswith("file:")
    system, inner = fs.FileSystem.from_uri(path) if remote else (fs.LocalFileSystem(), path)
    scheme = path[: len(path) - len(inner)] if remote and path.endswith(inner) else ""
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".zip"))


class MemberReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, split: int):
        self.path, self.pattern, self.split = path, pattern, split

    def partitions(self) -> list[ByteRange]:
        return [ByteRange(archive, low, low + self.split) for archive, size in _archives(self.path) for low in range(0, max(size, 1), self.split)]

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's call where there are no partitions
            return
        rows: list[tuple[str, str, str | None, str | None]] = []
        held = 0
        for row in self._members(partition):
            rows.append(row)
            held += len(row[2] or "")
            if held >= BATCH_BYTES:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["archive", "path", "value", "problem"])

    def _members(self, part: ByteRange) -> Iterator[tuple[str, str, str | None, str | None]]:
        wanted = re.compile(self.pattern)
        with _open(part.archive) as file:
            try:
                archive = zipfile.ZipFile(file)
            except (zipfile.BadZipFile, pa.ArrowInvalid) as problem:  # Arrow's: too short to seek in
                if part.low == 0:  # reported once, by the first range
                    yield part.archive, part.archive, None, f"not an archive: {problem}"
                return
            for entry in archive.infolist():
                if not part.low <= entry.header_offset < part.high or not wanted.search(entry.filename):
                    continue
                if entry.file_size > MOST_MEMBER_BYTES:
                    yield part.archive, entry.filename, None, f"unpacks to {entry.file_size} bytes"
                    continue
                try:
                    yield part.archive, entry.filename, archive.read(entry).decode("utf-8", "replace"), None
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError) as problem:
                    yield part.archive, entry.filename, None, f"{type(problem).__name__}: {problem}"


class ArchiveMembers(DataSource):
    """``spark.read.format("archive_members")``; options: path, pattern (of member names), split (bytes a partition)."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> MemberReader:
        split = int(self.options.get("split", SPLIT_BYTES))
        if split < 1:
            raise ValueError("split must be at least one byte")
        return MemberReader(self.options["path"], self.options.get("pattern", ""), split)


def read_members(spark: SparkSession, path: str, pattern: str = "", split: int = SPLIT_BYTES) -> DataFrame:
    """(archive, path, value, problem) of the members whose names hold ``pattern``.

    Exactly one of value and problem is null. A broken archive is one row under its own name; a member that
    can't be unpacked, is encrypted or is larger than ``MOST_MEMBER_BYTES`` is one row with its problem. Bytes that aren't UTF-8 are
    replaced. A member listed twice is two rows. A folder without archives gives no rows.
    """
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").option("pattern", pattern).option("split", split).load(path)
