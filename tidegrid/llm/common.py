"""Shared scratch folder, materialisation and Arrow text helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels take at once.
CHUNK_BYTES = 2_000_000
#: A scratch table of so many bytes is read in one partition.
SMALL_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; only a local session may go without it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"/tmp/checkpoints/tidegrid-{os.getuid()}").rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidegrid/{label}-{uuid.uuid4().hex}"


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries made and run inside go when those queries end."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as Parquet at ``path``, read again; its shuffle files go as soon as it is written."""
    with short_lived_shuffles(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage with data that outlives any executor, and gives later joins a plain
    exchange on either side, so that adaptive execution can split a skewed key.
    """
    return written(df, scratch_path(df.sparkSession, label))


class Scratch:
    """Tables of one operator's run: ``drop`` deletes those that have no reader left, the end of the block the rest but for what it ``keep``s."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._held: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame, label: str, gather: bool = True) -> DataFrame:
        """Write and read ``df``; if ``gather``, one of ``SMALL_BYTES`` at most is read in one partition, so that joins and aggregates among such tables need no exchange."""
        path = scratch_path(self._spark, label)
        out = written(df, path)
        if gather and size_of(self._spark, path) <= SMALL_BYTES:
            out = out.coalesce(1)
        self._held.append((out, path))
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        self._held = [(x, path) for x, path in self._held if x is not df]
        return df

    def drop(self, *tables: DataFrame) -> None:
        gone = [path for x, path in self._held if any(x is t for t in tables)]
        self._held = [(x, path) for x, path in self._held if path not in gone]
        for path in gone:
            remove_path(self._spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[x for x, _ in self._held])


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a folder's files."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whichever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """What a small file holds, None where there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Make a small file that must not exist yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def commit_text(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file at once, as a finished draft's new name; False where ``path`` exists. Relies on a store whose renames are atomic, as HDFS's are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".draft-{uuid.uuid4().hex}")
    fs = final.getFileSystem(conf)
    write_text(spark, draft.toString(), text)
    try:
        if not fs.exists(final):
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, final, none)
            return True
    except Py4JJavaError:
        if not fs.exists(final):  # not a lost race
            raise
    finally:
        fs.delete(draft, False)
    return False


def list_folder(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, time of change in ms) of each file in a folder, none where there is no folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p) if s.isFile()] if fs.exists(p) else []


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores as it takes for none of them to be a column, in any case."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold that no classifier learns from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def texts(column: pa.Array) -> pa.Array:
    """``column`` with null as empty text."""
    return pc.fill_null(column, "") if column.null_count else column


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column without nulls, and where each row begins (one more than rows)."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each, or one row where a row is longer."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def slices(batch: pa.RecordBatch, at: int, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in turn, so many that the texts of column ``at`` have at most ``size`` bytes together, or one row where that has more."""
    for i, j in chunks(utf8(texts(batch.column(at)))[1], size):
        yield batch.slice(i, j - i)


def release_memory() -> None:
    """Give back to the system what Arrow and, where it is glibc's, the allocator hold of memory that is free."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the Python worker, which goes on living for later tasks, gives its free memory back."""

    @wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidy


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    """A list<int64> column from one array for each row."""
    offs = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=offs[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values.astype(np.int64), pa.int64()))
