"""Capture files (classic ``pcap``) as a Spark data source: batch, stream and writer.

A file is a 24-byte header and records of a 16-byte head and a frame.  It is cut into byte ranges, and a range
reads the records that begin inside it.  Nothing marks where a record begins, so a range looks, some way before its
start and over the length of one longest record, at every place that could be a record's head and follows the
chain of lengths from there.  The true chain is among them, because some record begins within that reach; chains that begin
inside a frame run into an impossible head or join the true one.  If different chains arrive, the range looks
further back, at last from the file's header, so the records of all ranges are exactly those of the file.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, WriterCommitMessage
from pyspark.sql.types import StructType

from netloom.sources.ranges import RANGE_BYTES, ByteRange, NewFiles, list_files, opened, plan_ranges

SCHEMA = "packet_id long, ts timestamp, length int, link int, frame binary"
# Fixed values of the file format: magic numbers (microseconds, nanoseconds), header and head sizes, longest frame.
MICROS, NANOS = 0xA1B2C3D4, 0xA1B23C4D
HEADER, HEAD, LONGEST = 24, 16, 262_144
ETHERNET = 1
_ROWS = 4096
_ARROW = pa.schema([
    ("packet_id", pa.int64()), ("ts", pa.timestamp("us", tz="UTC")), ("length", pa.int32()), ("link", pa.int32()), ("frame", pa.binary())
])


@dataclass(frozen=True)
class Format:
    """What a file's header says: byte order, parts of a second, link type and the longest frame."""

    order: str
    parts: int
    link: int
    longest: int

    @classmethod
    def of(cls, header: bytes) -> Format:
        for order in "<>":
            if len(header) == HEADER:
                magic, _, _, _, _, most, link = struct.unpack(order + "IHHiIII", header)
                if magic in (MICROS, NANOS):
                    return cls(order, 10**6 if magic == MICROS else 10**9, link & 0xFFFF, min(max(most, LONGEST), 1 << 24))
        raise ValueError("not a capture file")

    def heads(self, data: np.ndarray) -> np.ndarray:
        """The places in ``data`` that could be a record's head."""
        n = len(data) - HEAD + 1
        if n <= 0:
            return np.empty(0, np.int64)
        octets = data.astype(np.uint32)

        def word(at: int) -> np.ndarray:
            parts = [octets[at + k : at + k + n] for k in range(4)]
            parts = parts[::-1] if self.order == "<" else parts
            return (parts[0] << 24) | (parts[1] << 16) | (parts[2] << 8) | parts[3]

        fraction, kept, full = word(4), word(8), word(12)
        return np.flatnonzero((fraction < self.parts) & (kept <= self.longest) & (kept <= full) & (full > 0))

    def size(self, head: bytes) -> int | None:
        """Bytes of the record with this head, or None where it is no head."""
        _, fraction, kept, full = struct.unpack(self.order + "IIII", head)
        possible = fraction < self.parts and kept <= self.longest and kept <= full and full > 0
        return HEAD + kept if possible else None


class _Heads:
    """Record heads of an open file by offset; bytes are read in windows."""

    def __init__(self, f, size: int, window: int = 1 << 20):
        self.f, self.size, self.window = f, size, window
        self.at, self.data = 0, b""

    def __getitem__(self, at: int) -> bytes:
        if not self.at <= at <= self.at + len(self.data) - HEAD:
            self.at, self.data = at, self.f.read_at(min(self.window, self.size - at), at)
        return self.data[at - self.at : at - self.at + HEAD]


def first_record(f, size: int, form: Format, start: int) -> int:
    """Offset of the first record that begins at ``start`` or later (``size`` if none does)."""
    reach, back = form.longest + HEAD, 2
    heads = _Heads(f, size)
    while True:
        low = max(HEADER, start - back * reach)
        if low == HEADER:
            places = [HEADER]
        else:
            window = np.frombuffer(f.read_at(min(size - low, reach + HEAD - 1), low), np.uint8)
            places = (low + form.heads(window)).tolist()
        follows: dict[int, int | None] = {}
        for place in places:
            path, at = [], place
            while at is not None and at < start and at not in follows:
                path.append(at)
                length = form.size(heads[at]) if at + HEAD <= size else size
                at = None if length is None else min(size, at + length)
            at = follows.get(at, at)
            follows.update((p, at) for p in path)
        landed = {follows.get(p, p) for p in places} - {None}
        if len(landed) == 1:
            return landed.pop()
        if low == HEADER:
            raise ValueError(f"no record begins around byte {start}: the file is damaged")
        back *= 2


def read_range(part: ByteRange | None) -> Iterator[pa.RecordBatch]:
    """The records that begin within a range (without one: none); one that the capture cut off is dropped."""
    if part is None:
        return
    system, inner = opened(part.path)
    with system.open_input_file(inner) as f:
        form = Format.of(f.read_at(min(HEADER, part.size), 0))
        at = first_record(f, part.size, form, part.start)
        ids, stamps, sizes, frames = [], [], [], []
        data, base = b"", at
        micros = 1 if form.parts == 10**6 else 1000

        def batch() -> pa.RecordBatch:
            links = [form.link] * len(ids)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, stamps, sizes, links, frames), _ARROW.types, strict=True)], schema=_ARROW)

        while at < part.stop and at + HEAD <= part.size:
            if at + HEAD > base + len(data):
                data, base = f.read_at(min(8 << 20, part.size - at), at), at
            second, fraction, kept, full = struct.unpack_from(form.order + "IIII", data, at - base)
            if kept > form.longest:
                raise ValueError(f"{part.path}: no record at byte {at}")
            if at + HEAD + kept > part.size:
                break
            if at + HEAD + kept > base + len(data):
                data, base = f.read_at(max(HEAD + kept, min(8 << 20, part.size - at)), at), at
            ids.append((part.number << 44) + at)
            stamps.append(second * 1_000_000 + fraction // micros)
            sizes.append(min(full, 2**31 - 1))
            frames.append(data[at - base + HEAD : at - base + HEAD + kept])
            at += HEAD + kept
            if len(ids) == _ROWS:
                yield batch()
                ids, stamps, sizes, frames = [], [], [], []
        if ids:
            yield batch()


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.span = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        return plan_ranges(list_files(self.path), self.span)

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        yield from read_range(partition)


class CaptureStream(NewFiles):
    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        yield from read_range(partition)


@dataclass
class Written(WriterCommitMessage):
    path: str


class CaptureWriter(DataSourceArrowWriter):
    """One file per task with the columns ``ts`` and ``frame``, given its name when the whole write succeeds."""

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.link = int(options.get("link", ETHERNET))
        missing = {"ts", "frame"} - set(schema.names)
        if missing:
            raise ValueError(f"a capture needs the columns {sorted(missing)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, inner = opened(self.path)
        system.create_dir(inner, recursive=True)
        name = f"{inner}/.part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.pcap"
        with system.open_output_stream(name) as out:
            out.write(struct.pack("<IHHiIII", MICROS, 2, 4, 0, 0, LONGEST, self.link))
            for batch in iterator:
                stamps = batch.column("ts").cast(pa.timestamp("us", tz="UTC")).cast(pa.int64()).to_pylist()
                for us, frame in zip(stamps, batch.column("frame").to_pylist(), strict=True):
                    if us is not None and frame is not None:
                        out.write(struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(frame), max(1, len(frame))) + frame)
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner = opened(self.path)
        kept = {m.path for m in messages if m}
        if self.overwrite:
            for old in list_files(self.path):
                system.delete_file(opened(old.path)[1])
        for path in sorted(kept):
            system.move(path, path.replace("/.part-", "/part-"))

    def abort(self, messages: list[Written | None]) -> None:
        system = opened(self.path)[0]
        for m in messages:
            if m:
                system.delete_file(m.path)


class CaptureSource(DataSource):
    """``spark.read.format("capture")``; options ``path``, ``rangeBytes``, for writes ``link``."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(self.options)

    def streamReader(self, schema: StructType) -> CaptureStream:
        return CaptureStream(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options, schema, overwrite)


def read_captures(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The frames of a capture file or a folder of them (``packet_id, ts, length, link, frame``).

    ``packet_id`` is the number of the file (by time of change and name) and the byte where the record begins.
    """
    spark.dataSource.register(CaptureSource)
    return spark.read.format("capture").option("rangeBytes", range_bytes).load(path)


def capture_stream(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The frames of capture files as they come into a folder; each batch takes all new ones."""
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("capture").option("rangeBytes", range_bytes).load(path)


def write_captures(frames: DataFrame, path: str, mode: str = "append", link: int = ETHERNET) -> None:
    """``ts`` and ``frame`` as capture files, one per task."""
    # Spark looks a source up for writing in the active session, which may be another than that of the frames.
    for session in (frames.sparkSession, SparkSession.getActiveSession()):
        if session is not None:
            session.dataSource.register(CaptureSource)
    frames.select("ts", "frame").write.format("capture").option("link", link).mode(mode).save(path)
