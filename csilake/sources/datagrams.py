"""Binary datagram logs: files that receivers append to, read as a batch or as a stream, in byte ranges.

    spark.dataSource.register(DatagramLog)
    spark.readStream.format("datagram_log").option("state", "/shared/state/q1").load("/shared/logs")

A record is a mark and, behind it, the payload's length and checksum, the time of arrival and the payload, in which the mark's first byte is
always followed by a zero: the mark stands nowhere but before a record. So a task that reads a byte range finds records by itself: it starts
the longest record's length before its range, goes from mark to mark, and keeps the records whose last byte is in its range and whose
checksum is right. Each record has one task, whatever the ranges, and one that was only partly written when a batch was planned
belongs to the next. Damaged bytes are skipped up to the next mark.

A stream's offset is the size of each file. ``bytes_per_trigger`` bounds a batch; what was planned last is kept in the file ``state``
(one for each query, beside its checkpoint), which a restarted query goes on from. Options: ``path``, ``state``, ``bytes_per_trigger``, ``bytes_per_split``.
Files must be mounted on the driver and all executors; they grow at the end and are never rewritten.
"""

from __future__ import annotations

import gc
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from csilake.sources.collector_sqlite import mounted

# The mark before each record, what stands for its first byte elsewhere, and the head (payload length, checksum, arrival in microseconds).
MARK = b"\xf5CSI"
ESCAPED = b"\xf5\x00"
HEAD = "<IIq"
HEAD_SIZE = struct.calcsize(HEAD)
#: Most bytes of a payload: what a receiver takes at once.
PAYLOAD = 2048
LONGEST = len(MARK) + 2 * (HEAD_SIZE + PAYLOAD)
SCHEMA = "file string, position bigint, arrived timestamp_ntz, value binary"
_ARROW = pa.schema([("file", pa.string()), ("position", pa.int64()), ("arrived", pa.timestamp("us")), ("value", pa.binary())])
_BATCH_ROWS = 4096
#: Bytes read at once.
PIECE = 1 << 20


def record(payload: bytes, arrived: int) -> bytes:
    """A payload of at most PAYLOAD bytes as it stands in a log."""
    if len(payload) > PAYLOAD:
        raise ValueError(f"a datagram has at most {PAYLOAD} bytes, not {len(payload)}")
    return MARK + (struct.pack(HEAD, len(payload), _checksum(payload, arrived), arrived) + payload).replace(MARK[:1], ESCAPED)


def _checksum(payload: bytes, arrived: int) -> int:
    return zlib.crc32(payload, zlib.crc32(struct.pack("<q", arrived)))


def records(data: bytes, limit: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, arrived, payload) of the whole records in ``data`` that start before ``limit``."""
    at = data.find(MARK)
    while 0 <= at < limit:
        after = data.find(MARK, at + 1)
        stop = len(data) if after < 0 else after
        body = data[at + len(MARK) : min(stop, at + LONGEST)].replace(ESCAPED, MARK[:1])
        if len(body) >= HEAD_SIZE:
            size, checksum, arrived = struct.unpack_from(HEAD, body)
            payload = body[HEAD_SIZE : HEAD_SIZE + size]
            end = at + len(MARK) + HEAD_SIZE + size + body[: HEAD_SIZE + size].count(MARK[:1])
            if size <= PAYLOAD and len(payload) == size and end <= stop and _checksum(payload, arrived) == checksum:
                yield at, end, arrived, payload
        at = after


@dataclass
class Range(InputPartition):
    path: str
    low: int
    high: int


def ranges(start: dict[str, int], end: dict[str, int], width: int) -> list[Range]:
    """What was added to each file, cut into ranges."""
    out = []
    for path, size in sorted(end.items()):
        for low in range(start.get(path, 0), size, width):
            out.append(Range(path, low, min(low + width, size)))
    return out


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    """Records whose last byte is in the range, a piece of the file at a time."""
    with open(part.path, "rb") as file:
        base, data, held = max(0, part.low - LONGEST), b"", []
        file.seek(base)
        while True:
            more = file.read(min(PIECE, part.high - base - len(data)))
            data += more
            last = not more or base + len(data) >= part.high
            end = 0
            for start, end, arrived, payload in records(data, len(data) if last else len(data) - LONGEST):
                if part.low < base + end <= part.high:
                    held.append((part.path, base + start, arrived, payload))
            while len(held) >= _BATCH_ROWS or (last and held):
                yield _to_batch(held[:_BATCH_ROWS])
                held = held[_BATCH_ROWS:]
            if last:
                return
            done = max(end, len(data) - LONGEST)
            base, data = base + done, data[done:]


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    path, position, arrived, payload = zip(*rows, strict=True)
    stamps = pa.array(np.array(arrived, dtype="int64")).cast(pa.timestamp("us"))
    return pa.RecordBatch.from_arrays([pa.array(path), pa.array(position, pa.int64()), stamps, pa.array(payload, pa.binary())], schema=_ARROW)


def sizes(path: str) -> dict[str, int]:
    """The log files below a folder and their sizes; hidden ones are being written."""
    root, found = mounted(path), {}
    for folder, _, names in os.walk(root):
        found.update({os.path.join(folder, n): os.path.getsize(os.path.join(folder, n)) for n in names if n[0] not in "._"})
    return found


class DatagramLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "datagram_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> "LogReader":
        return LogReader(self.options)

    def streamReader(self, schema: StructType) -> "LogStreamReader":
        return LogStreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> "LogWriter":
        if overwrite:
            raise ValueError("logs are only added to")
        return LogWriter(self.options)


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.width = options["path"], int(options.get("bytes_per_split", 64 << 20))

    def partitions(self) -> list[Range]:
        return ranges({}, sizes(self.path), self.width)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition)


def spare_imports() -> None:
    """Takes what a worker holds, nearly all of it imported modules, out of later garbage collections, once a process: Spark's worker makes a full one after
    each task, which for a short range takes longer than reading it."""
    if not gc.get_freeze_count():
        gc.freeze()


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.width = options["path"], int(options.get("bytes_per_split", 64 << 20))
        self.limit = int(options["bytes_per_trigger"]) if "bytes_per_trigger" in options else None
        self.state = mounted(options["state"]) if "state" in options else None
        if self.limit is not None and self.state is None:
            raise ValueError("bytes_per_trigger needs state, a file of the query's own that a restart goes on from")
        self.planned: dict[str, int] = {}
        if self.state is not None and os.path.exists(self.state):
            with open(self.state, encoding="utf-8") as file:
                self.planned = json.load(file)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Sizes now; with a limit, what was planned last and as much more as the limit lets in, file by file."""
        now = sizes(self.path)
        if self.limit is None:
            return now
        end, left = dict(self.planned), self.limit
        for path, size in sorted(now.items()):
            added = min(size - end.get(path, 0), left)
            if added > 0:
                end[path] = end.get(path, 0) + added
                left -= added
        return end

    def partitions(self, start: dict, end: dict) -> list[Range]:
        # a batch is planned before it is run, and again if it is repeated, so this is always where the next one starts
        self.planned = dict(end)
        if self.state is not None:
            os.makedirs(os.path.dirname(self.state), exist_ok=True)
            draft = f"{self.state}.{uuid.uuid4().hex}"
            with open(draft, "w", encoding="utf-8") as file:
                json.dump(self.planned, file)
            os.replace(draft, self.state)
        return ranges(start, end, self.width)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        spare_imports()
        return read_range(partition)


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class LogWriter(DataSourceArrowWriter):
    """One log a task of the columns ``arrived`` and ``value``; the files appear when the job commits."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = mounted(options["path"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        hidden = os.path.join(self.path, f".{uuid.uuid4().hex}.log")
        with open(hidden, "wb") as out:
            for batch in iterator:
                arrived = batch.column("arrived").cast(pa.timestamp("us")).cast(pa.int64()).to_pylist()
                out.writelines(record(bytes(v), t) for t, v in zip(arrived, batch.column("value").to_pylist(), strict=True) if v is not None)
        return Written(hidden)

    def commit(self, messages: list[Written | None]) -> None:
        for message in messages:
            if message and message.file:
                os.replace(message.file, os.path.join(self.path, os.path.basename(message.file)[1:]))

    def abort(self, messages: list[Written | None]) -> None:
        for message in messages:
            if message and message.file:
                os.remove(message.file)
