"""Token-id files: whole texts tokenised, range coded in checksummed blocks, and read back.

A file set is a Parquet folder whose rows are segments of whole documents in ascending doc_id order:
the part and segment number, the ids of that part before it, the documents' ids and lengths, the order-0 table, and the blocks with their
checksums (see ``range_coder``). A segment is read on its own; a block that fails its checksum raises.

Defined results: a null text counts as empty and has the end id alone; rows repeated with one doc_id stand
side by side in the order of their text's hash; an empty table gives an empty set; other columns aren't
read. Rows without a doc_id come first. Ids above 65535 raise ValueError.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import range_coder
from tidegrid.llm.common import scratch_path, slices, texts, tidied
from tidegrid.llm.tokens import GROUP_BYTES, worker_tokenizer

SCHEMA = "part int, segment int, at long, n_ids long, doc_ids array<long>, n_tokens array<long>, order0 binary, blocks array<binary>, sums array<long>"


def _encode(path: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(path, words=False)
        part, number, at = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list[int], np.ndarray, np.ndarray]] = []

        def segment(groups: list[tuple[list[int], np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            docs = [d for names, _, _ in groups for d in names]
            n, ids = np.concatenate([g[1] for g in groups]), np.concatenate([g[2] for g in groups])
            table, codes, sums = range_coder.encode_checked(ids)
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([at], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([n], pa.list_(pa.int64())), pa.array([table], pa.binary()), pa.array([codes], pa.list_(pa.binary())), pa.array([sums], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["part", "segment", "at", "n_ids", "doc_ids", "n_tokens", "order0", "blocks", "sums"])

        for batch in batches:
            for group in slices(batch, 1, GROUP_BYTES):
                ids, n = tokenizer.encode(texts(group.column(1)).to_pylist())
                if len(ids) and ids.max() > range_coder.MAX_ID:
                    raise ValueError("ids above 65535 can't be coded")
                held.append((group.column(0).to_pylist(), n + 1, np.insert(ids, np.cumsum(n), np.uint32(end_id)).astype(np.uint16)))
                sizes = np.cumsum([len(g[2]) for g in held])
                # A segment goes once another one can follow, so that a part's last one isn't short: numpy takes few blocks as long as many.
                if sizes[-1] >= 2 * segment_ids:
                    k = int(np.searchsorted(sizes, segment_ids)) + 1
                    yield segment(held[:k])
                    number, at, held = number + 1, at + int(sizes[k - 1]), held[k:]
        if held:
            yield segment(held)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = range_coder.SEGMENT_IDS) -> None:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # By id; with repeats by text too, so that one id doesn't make a part too large. Texts are read once more then, for the parts' bounds.
    repeated = bool(rows.groupBy("doc_id").count().where("count > 1").limit(1).collect())
    order = ["doc_id", F.xxhash64("text")] if repeated else ["doc_id"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidied(_encode(tokenizer_path, end_id, segment_ids)), SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""
    files = spark.read.schema(SCHEMA).parquet(path)
    # One number for each task that has written; where a segment begins in its part stands in the file.
    totals = sorted(files.groupBy("part").agg(F.max(F.col("at") + F.col("n_ids")).alias("n")).collect())
    begun, starts = 0, {}
    for part, n in totals:
        starts[part] = begun
        begun += n
    starts = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, _, at, n_ids, docs, n, table, codes, sums = (c[i].as_py() for c in batch.columns)
                ids = range_coder.decode_checked(table, codes, sums, n_ids).astype("<u4", copy=False)
                n = np.array(n, np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts.value[part] + at + ends - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return read_tokens(spark, path)
