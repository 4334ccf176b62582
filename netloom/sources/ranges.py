"""Files cut into byte ranges: the partitions of the sources that read raw bytes.

Paths are opened through ``pyarrow.fs``, so a folder may be local, mounted, or a URI of a store
that Arrow knows (``hdfs://``, ``s3://``, ``gs://``).  A file of any size is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

RANGE_BYTES = 64 << 20


@dataclass(frozen=True)
class File:
    path: str
    size: int
    modified: int
    number: int


@dataclass(frozen=True)
class ByteRange(InputPartition):
    """Bytes ``start`` to ``stop`` of the file ``path``, the ``number``-th of its source, ``size`` bytes long."""

    path: str
    number: int
    size: int
    start: int
    stop: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[File]:
    """The files of a folder, or the one file, by time of change and name; hidden files are left out."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    files = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    prefix = path[: path.index("://") + 3] if "://" in path else ""
    if prefix.startswith("hdfs"):  # host and port are part of the URI but not of the inner paths
        prefix = path[: path.index("/", len(prefix))]
    ordered = sorted(((f.mtime_ns or 0, f.path, f.size) for f in files))
    return [File(prefix + name, size, modified, k) for k, (modified, name, size) in enumerate(ordered)]


def plan_ranges(files: list[File], span: int = RANGE_BYTES, unit: int = 1) -> list[ByteRange]:
    """Every file cut at multiples of about ``span`` bytes (a multiple of ``unit``); empty files give nothing."""
    if span < 1 or unit < 1:
        raise ValueError("range length and unit must be positive")
    step = max(1, span // unit) * unit
    return [
        ByteRange(f.path, f.number, f.size, at, min(f.size, at + step)) for f in files for at in range(0, f.size, step)
    ]


class NewFiles(DataSourceStreamReader):
    """Ranges of the files that have come into a folder since the last batch.

    Files count in order of change time and name, so one must be complete when it appears (written elsewhere and
    moved in), and stay: its number is its place among all of them.  The offset is the last file taken.
    """

    def __init__(self, options: dict[str, str], unit: int = 1):
        self.path, self.span, self.unit = options["path"], int(options.get("rangebytes", RANGE_BYTES)), unit

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = list_files(self.path)
        return {"modified": files[-1].modified, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        after, last = ((o["modified"], o["path"]) for o in (start, end))
        return plan_ranges([f for f in list_files(self.path) if after < (f.modified, f.path) <= last], self.span, self.unit)


def chunks(path: str, start: int, stop: int, piece: int = 8 << 20) -> Iterator[bytes]:
    """The bytes of a range, a piece at a time."""
    system, inner = opened(path)
    with system.open_input_file(inner) as f:
        for at in range(start, stop, piece):
            yield f.read_at(min(piece, stop - at), at)


