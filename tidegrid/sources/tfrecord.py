"""TFRecord files of ``tf.train.Example`` records, as a data source that Spark reads and writes in parallel.

    tfrecord.register(spark)
    df.write.format("tfrecord").mode("append").save(path)
    spark.read.format("tfrecord").schema("id long, x array<double>").load(path)

A record is its length (8 bytes), the masked CRC-32C of the length, the payload, and the masked CRC-32C of the payload.
Whole numbers are int64 lists, floats are float lists (32 bit), texts and binaries are bytes lists; a null has no entry.

Each task writes files of its own under ``_temporary``; only the driver's commit moves those of the tasks that succeeded to
their place and adds ``_SUCCESS``, so that failed, repeated or speculative tasks leave nothing. Readers take
one file a task and check both sums of every record. Paths are any that pyarrow opens (local, hdfs://, s3://, gs://).

Defined results: an empty list and a null are both read as null for a scalar and as null and empty list for an array;
a field that the schema names and a record lacks is null; other fields of a record are not read; a damaged record raises
``ValueError`` with its file and offset; an empty table writes no record and reads as one without rows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: The reversed Castagnoli polynomial and the constant that masks sums.
_POLYNOMIAL, _MASK = 0x82F63B78, 0xA282EAD8
#: Records that are summed together.
_TOGETHER = 4096


@cache
def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1)
    return c


@cache
def _table_list() -> list[int]:
    return _table().tolist()


def masked_sums(parts: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of each part; one numpy step takes a byte of every part."""
    sizes = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(parts), np.uint8)
    at = np.concatenate([[0], np.cumsum(sizes)])[:-1][order].astype(np.int64)
    sums, table, descending = np.full(len(parts), 0xFFFFFFFF, np.uint32), _table(), sizes[order]
    for i in range(int(descending[0]) if len(parts) else 0):
        n = int(np.searchsorted(-descending, -i, side="left"))  # parts longer than i
        sums[:n] = table[(sums[:n] ^ data[at[:n] + i]) & 0xFF] ^ (sums[:n] >> 8)
    out = np.empty_like(sums)
    out[order] = sums ^ np.uint32(0xFFFFFFFF)
    return (((out >> 15) | (out << 17)) + np.uint32(_MASK)).astype(np.uint32)


def masked_sum(part: bytes) -> int:
    """Masked CRC-32C of a short part."""
    table, c = _table_list(), 0xFFFFFFFF
    for b in part:
        c = table[(c ^ b) & 0xFF] ^ (c >> 8)
    c ^= 0xFFFFFFFF
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    """A length-delimited protobuf field."""
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _kind(t: DataType) -> str:
    t = t.elementType if isinstance(t, ArrayType) else t
    name = t.simpleString()
    if name in ("tinyint", "smallint", "int", "bigint", "boolean"):
        return "int64"
    if name in ("float", "double"):
        return "float"
    if isinstance(t, (StringType, BinaryType)):
        return "bytes"
    raise ValueError(f"no TFRecord feature holds {name}")


def _feature(kind: str, values: list) -> bytes:
    if kind == "int64":
        return _field(3, _field(1, b"".join(_varint(int(v)) for v in values)))
    if kind == "float":
        return _field(2, _field(1, np.asarray(values, "<f4").tobytes()))
    return _field(1, b"".join(_field(1, v.encode() if isinstance(v, str) else bytes(v)) for v in values))


def encode_example(row: dict, kinds: dict[str, str]) -> bytes:
    """The Example of a row of scalars, lists and nulls."""
    entries = []
    for name, kind in kinds.items():
        value = row[name]
        if value is not None:
            values = value if isinstance(value, list) else [value]
            if any(v is None for v in values):
                raise ValueError(f"{name} holds a null inside an array")
            entries.append(_field(1, _field(1, name.encode()) + _field(2, _feature(kind, values))))
    return _field(1, b"".join(entries))


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b[at - 1] < 0x80:
            return n, at


def _fields(b: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of each field of a message."""
    at = 0
    while at < len(b):
        tag, at = _read_varint(b, at)
        wire = tag & 7
        if wire == 0:
            value, at = _read_varint(b, at)
        elif wire == 2:
            n, at = _read_varint(b, at)
            value, at = b[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[wire]
            value, at = b[at : at + n], at + n
        yield tag >> 3, wire, value


def _values(feature: bytes) -> list:
    for number, _, body in _fields(feature):
        if number == 1:
            return [v for _, _, v in _fields(body)]
        if number == 2:  # packed or one by one
            return np.frombuffer(b"".join(v for _, _, v in _fields(body)), "<f4").astype(float).tolist()
        out: list[int] = []
        for _, wire, v in _fields(body):
            if wire == 0:
                out.append(v)
            else:
                at = 0
                while at < len(v):
                    n, at = _read_varint(v, at)
                    out.append(n)
        return [n - (1 << 64) if n >> 63 else n for n in out]
    return []


def decode_example(payload: bytes, wanted: set[str]) -> dict[str, list]:
    """The named features of an Example, each as a list."""
    found: dict[str, list] = {}
    for _, _, features in _fields(payload):
        for _, _, entry in _fields(features):
            parts = {number: v for number, _, v in _fields(entry)}
            name = parts.get(1, b"").decode()
            if name in wanted:
                found[name] = _values(parts.get(2, b""))
    return found


def frame(payloads: list[bytes]) -> bytes:
    """Records of ``payloads``, one after the other."""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    out = []
    for size, head, payload, tail in zip(lengths, masked_sums(lengths), payloads, masked_sums(payloads), strict=True):
        out += [size, struct.pack("<I", head), payload, struct.pack("<I", tail)]
    return b"".join(out)


def unframe(stream, name: str) -> Iterator[bytes]:
    """Payloads of a file's records, whose sums are checked some thousand at a time."""
    at, payloads, sums, places = 0, [], [], []

    def checked() -> Iterator[bytes]:
        ok = masked_sums(payloads) == np.array(sums, np.uint32)
        for good, place, payload in zip(ok.tolist(), places, payloads, strict=True):
            if not good:
                raise ValueError(f"{name}: damaged record at byte {place}")
            yield payload

    while True:
        head = stream.read(12)
        if len(head) == 0 or len(payloads) == _TOGETHER:
            yield from checked()
            payloads, sums, places = [], [], []
            if not head:
                return
        if len(head) < 12:
            raise ValueError(f"{name}: damaged record at byte {at}")
        size, head_sum = struct.unpack("<QI", head)
        if masked_sum(head[:8]) != head_sum:  # a wrong length would read far too much
            yield from checked()
            raise ValueError(f"{name}: damaged record at byte {at}")
        payload, tail = stream.read(size), stream.read(4)
        if len(payload) < size or len(tail) < 4:
            yield from checked()
            raise ValueError(f"{name}: damaged record at byte {at}")
        payloads.append(payload)
        sums.append(struct.unpack("<I", tail)[0])
        places.append(at)
        at += 16 + size


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    """Files of ``rows_per_file`` records at most; ``attempt`` names this write's folder under ``_temporary``."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, rows_per_file: int):
        self.path, self.schema, self.overwrite, self.rows = path.rstrip("/"), schema, overwrite, rows_per_file
        self.kinds = {f.name: _kind(f.dataType) for f in schema.fields}
        self.attempt = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _open(self.path)
        folder = f"{root}/_temporary/{self.attempt}"
        store.create_dir(folder, recursive=True)
        names, stream, left = [], None, 0
        try:
            for batch in iterator:
                payloads = [encode_example(row, self.kinds) for row in batch.to_pylist()]
                while payloads:
                    if not left:
                        if stream is not None:
                            stream.close()
                        names.append(f"part-{uuid.uuid4().hex}.tfrecord")
                        stream, left = store.open_output_stream(f"{folder}/{names[-1]}"), self.rows
                    now, payloads = payloads[:left], payloads[left:]
                    stream.write(frame(now))
                    left -= len(now)
        finally:
            if stream is not None:
                stream.close()
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        names = [n for m in messages if m is not None for n in m.names]
        before = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File] if self.overwrite else []
        for name in names:
            store.move(f"{root}/_temporary/{self.attempt}/{name}", f"{root}/{name}")
        for path in before:
            store.delete_file(path)
        self._clean(store, root)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean(*_open(self.path))

    def _clean(self, store: fs.FileSystem, root: str) -> None:
        """Delete this write's folder, and ``_temporary`` if no other write is under way."""
        if store.get_file_info(f"{root}/_temporary/{self.attempt}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary/{self.attempt}")
        if store.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(f"{root}/_temporary")):
            store.delete_dir(f"{root}/_temporary")


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema
        self.kinds = {f.name: _kind(f.dataType) for f in schema.fields}

    def partitions(self) -> list[_File]:
        store, root = _open(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"{self.path} doesn't exist")
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition is None:
            return
        store, _ = _open(self.path)
        wanted = set(self.kinds)
        with store.open_input_stream(partition.path) as stream:
            for payload in unframe(stream, partition.path):
                found = decode_example(payload, wanted)
                yield tuple(self._value(f.dataType, found.get(f.name)) for f in self.schema.fields)

    def _value(self, t: DataType, values: list | None):
        if values is None or (not values and not isinstance(t, ArrayType)):
            return None
        inner = t.elementType if isinstance(t, ArrayType) else t
        if isinstance(inner, StringType):
            values = [v.decode() for v in values]
        elif inner.simpleString() == "boolean":
            values = [bool(v) for v in values]
        return values if isinstance(t, ArrayType) else values[0]


class TFRecordSource(DataSource):
    """Options: ``path``, and ``maxRecordsPerFile`` for writes."""

    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self):
        raise ValueError("TFRecord files don't hold their schema: give it to the reader")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema, overwrite, int(self.options.get("maxRecordsPerFile", 1_000_000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TFRecordSource)
