"""K-Shape over any number of series (Paparrizos and Gravano, SIGMOD 2015).

A round is one Arrow pass over the series, a row each: every task assigns its own series to the centre at the least
shape-based distance, shifts them to where they are most like it, and adds up the products of their steps, a
matrix of length x length a cluster. The matrices are summed by place; the driver gets the sums alone, whose size
doesn't depend on the number of series, and takes each one's leading direction as the new centre. The first round's
clusters are hashes of the keys, so the result doesn't depend on how series are dealt.

Defined results: a constant series has distance 1 to every centre and goes to the first; of equal distances the lower cluster has it; a cluster
that gets none takes the series that is farthest from its centre (of equally far ones the smaller key); series of different lengths raise ValueError; without
series there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.cluster import MAX_CELLS, _aligned, standardise
from tidegrid.sources.io import scratch


def series_rows(dense: DataFrame, key: str, value: str = "demand", ts: str = "bin") -> DataFrame:
    """(key, v): each key's values in time order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(ts), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))))
    return dense.where(F.col(key).isNotNull()).groupBy(key).agg(pairs.alias("s")).select(key, F.transform("s", lambda x: x["v"]).alias("v"))


def assign(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each series, and the distances to it."""
    dist = np.stack([_aligned(x, c)[0] for c in centres], axis=1)
    # Distances that differ by rounding alone are equal.
    label = (dist <= dist.min(axis=1, keepdims=True) + 1e-12).argmax(axis=1)
    return label, dist[np.arange(len(x)), label]


def leading(products: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The direction that the series of a cluster share most, on the side of their sum."""
    width = len(total)
    centring = np.eye(width) - 1.0 / width
    vector = np.linalg.eigh(centring @ products @ centring)[1][:, -1]
    if vector @ total < 0 or (vector @ total == 0 and vector[np.abs(vector).argmax()] < 0):
        vector = -vector
    return standardise(vector[None])[0]


def _standard(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return standardise(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width))


def _round(rows: DataFrame, k: int, width: int, centres: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Product matrices and, as a last row, sums of each cluster's aligned series, and their number."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((k, width + 1, width)), np.zeros(k)
        for batch in batches:
            x = _standard(batch, width)
            label = batch.column("first").to_numpy() if sent.value is None else assign(x, sent.value)[0]
            for j in np.unique(label).tolist():
                own = x[label == j]
                if sent.value is not None and sent.value[j].any():
                    own = standardise(_aligned(own, sent.value[j])[1])
                sums[j, :width] += own.T @ own
                sums[j, width] += own.sum(axis=0)
                sizes[j] += len(own)
        flat = [(j, i, sizes[j] if i == width else 0.0, sums[j, i]) for j in range(k) if sizes[j] for i in range(width + 1)]
        kinds = [("cluster", pa.int64()), ("i", pa.int64()), ("n", pa.float64()), ("row", pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in flat], t) for c, (_, t) in enumerate(kinds)], [c for c, _ in kinds])

    parts = rows.mapInArrow(run, "cluster long, i long, n double, row array<double>").select("cluster", "i", "n", F.posexplode("row").alias("at", "v"))
    found = parts.groupBy("cluster", "i", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()
    sent.destroy()
    sums, sizes = np.zeros((k, width + 1, width)), np.zeros(k)
    sums[found["cluster"], found["i"], found["at"]] = found["v"]
    last = found[(found["i"] == width) & (found["at"] == 0)]
    sizes[last["cluster"]] = last["n"]
    return sums, sizes


def farthest(rows: DataFrame, width: int, centres: np.ndarray | None) -> np.ndarray:
    """The standardised series that is farthest from its centre, the smallest key's of equally far ones."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _standard(batch, width)
            dist = np.zeros(len(x)) if sent.value is None else assign(x, sent.value)[1]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(-dist)], ["name", "near"])

    far = rows.mapInArrow(run, "name string, near double").agg(F.min(F.struct("near", "name")).alias("r")).first()["r"]
    return standardise(np.array([rows.where(F.col("name") == far["name"]).first()["v"]], float))[0]


def kshape(dense: DataFrame, key: str, k: int = 3, seed: int = 42, value: str = "demand", rounds: int = 50) -> DataFrame:
    """(key, cluster_id) of each series."""
    spark, kind = dense.sparkSession, dict(dense.dtypes)[key]
    rows = series_rows(dense, key, value)
    name = F.col(key).cast("string")
    rows = rows.select(key, "v", name.alias("name"), F.pmod(F.xxhash64(name, F.lit(seed)), F.lit(k)).alias("first"))
    path = scratch(spark, "kshape-series")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    n, width, longest = rows.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], f"`{key}` {kind}, cluster_id int")
    if width != longest:
        raise ValueError("series differ in length; densify them first")
    k = min(k, n)
    if k * width * width > MAX_CELLS:
        raise ValueError(f"{k} matrices of {width} x {width}; resample to fewer steps first")
    rows = rows.withColumn("first", F.col("first") % k)
    centres = None
    for _ in range(rounds):
        sums, sizes = _round(rows, k, width, centres)
        new = np.stack([leading(s[:width], s[width]) if size else farthest(rows, width, centres) for s, size in zip(sums, sizes, strict=True)])
        done = centres is not None and np.abs(new - centres).max() < 1e-6
        centres = new
        if done:
            break
    sent = spark.sparkContext.broadcast(centres)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = assign(_standard(batch, width), sent.value)[0]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.int32())], [key, "cluster_id"])

    return rows.mapInArrow(label, f"`{key}` {kind}, cluster_id int")
