"""The binary write-ahead log as a Spark data source, and its writer.

A file is a series of records: body length and CRC-32 of the body (two little-endian uint32), then the body: seq
(uint64), count and dim (uint32), count ids (int64), count * dim floats (float32), and for each row the length (uint32)
and UTF-8 text of its payload, or no payloads at all. A record that is cut short or fails its checksum ends the log.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The log's layout.
FRAME, START, LENGTH = struct.Struct("<II"), struct.Struct("<QII"), struct.Struct("<I")


@dataclass
class Record:
    seq: int
    ids: list[int]
    vectors: np.ndarray
    payloads: list[str] = field(default_factory=list)

    def encode(self) -> bytes:
        x = np.ascontiguousarray(self.vectors, "<f4").reshape(len(self.ids), -1) if self.ids else np.zeros((0, 0), "<f4")
        body = [START.pack(self.seq, len(self.ids), x.shape[1]), np.array(self.ids, "<i8").tobytes(), x.tobytes()]
        if any(self.payloads):
            for p in self.payloads:
                text = p.encode("utf-8")
                body += [LENGTH.pack(len(text)), text]
        whole = b"".join(body)
        return FRAME.pack(len(whole), zlib.crc32(whole)) + whole


class _Torn(Exception):
    """The bytes end before what they announce."""


class _Cursor:
    """Takes stretches off a body; asking for more than there is, or leaving some, means that the record is torn."""

    def __init__(self, body: bytes):
        self.rest = memoryview(body)

    def take(self, size: int) -> memoryview:
        if size > len(self.rest):
            raise _Torn
        part, self.rest = self.rest[:size], self.rest[size:]
        return part

    def numbers(self, layout: struct.Struct) -> tuple[int, ...]:
        return layout.unpack(self.take(layout.size))

    def array(self, kind: str, count: int) -> np.ndarray:
        return np.frombuffer(self.take(np.dtype(kind).itemsize * count), kind)


def _decode(body: bytes) -> Record:
    cursor = _Cursor(body)
    seq, rows, dim = cursor.numbers(START)
    ids, vectors = cursor.array("<i8", rows).tolist(), cursor.array("<f4", rows * dim).reshape(rows, dim)
    texts = [bytes(cursor.take(*cursor.numbers(LENGTH))).decode("utf-8") for _ in ids] if cursor.rest else [""] * rows
    if cursor.rest:
        raise _Torn
    return Record(seq, ids, vectors, texts)


def _intact(path: str) -> Iterator[tuple[Record, int]]:
    """The intact records of a file, and where each ends."""
    end = 0
    with open(path, "rb") as f:
        while frame := f.read(FRAME.size):
            try:
                size, checksum = _Cursor(frame).numbers(FRAME)
                body = bytes(_Cursor(f.read(size)).take(size))
                if zlib.crc32(body) != checksum:
                    return
                record = _decode(body)
            except _Torn:
                return
            end += FRAME.size + size
            yield record, end


def read_log(path: str) -> Iterator[Record]:
    """The intact records of a file, one at a time."""
    for record, _ in _intact(path):
        yield record


class LogWriter:
    """Appends behind the last intact record: a torn tail is cut off when the file is opened, or else nothing after it
    could be read. With ``sync`` records are on disk when ``append`` returns."""

    def __init__(self, path: str, sync: bool = True):
        Path(path).touch()
        end = max((e for _, e in _intact(path)), default=0)
        self.sync, self.file = sync, open(path, "r+b")
        self.file.truncate(end)
        self.file.seek(end)

    def append(self, *records: Record) -> None:
        self.file.write(b"".join(r.encode() for r in records))
        self._flush()

    def reset(self) -> None:
        """Empty the log, when a snapshot holds its records."""
        self.file.truncate(0)
        self.file.seek(0)
        self._flush()

    def _flush(self) -> None:
        self.file.flush()
        if self.sync:
            os.fsync(self.file.fileno())

    def __enter__(self) -> LogWriter:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


def append_log(path: str, *records: Record) -> None:
    with LogWriter(path) as log:
        log.append(*records)


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, after: int):
        self.path, self.after = path, after

    def partitions(self) -> list[_File]:
        p = Path(self.path)
        return [_File(str(x)) for x in (sorted(p.glob("*.log")) if p.is_dir() else [p])] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        for r in read_log(partition.path):
            if r.seq > self.after:
                for i, row_id in enumerate(r.ids):
                    yield (Path(partition.path).name, r.seq, row_id, r.vectors[i].tolist(), r.payloads[i] or None)


class WalDataSource(DataSource):
    """spark.read.format("lodequery_wal").option("after", 7).load(file or folder): a partition for each *.log file."""

    @classmethod
    def name(cls) -> str:
        return "lodequery_wal"

    def schema(self) -> str:
        return "file string, seq bigint, id bigint, vec array<float>, payload string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("after", "-1")))
