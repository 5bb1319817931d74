"""Sources and sinks: drift-tolerant Parquet scans, provenance, CSV, footers' figures and partitioned sinks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name in the folder that all executors share (``spark.checkpoint.dir`` where it is set)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(found or f'/tmp/checkpoints/tidegrid-{os.getuid()}').rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a glob, in any store Hadoop reads, in name order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.globStatus(path) or [])


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, in any store Hadoop writes."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def monthly_paths(template: str, years: Iterable[int], months: Iterable[int] = range(1, 13)) -> list[str]:
    """``template`` with {year} and {month} filled in, for each month of each year."""
    months = list(months)
    return [template.format(year=y, month=m) for y in years for m in months]


def resolve(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first candidate that a column is named, upper or lower case alike."""
    by = {c.lower(): c for c in reversed(columns)}
    return next((by[c.lower()] for c in candidates if c.lower() in by), None)


def read_normalized(spark: SparkSession, paths: Sequence[str], spec: Mapping[str, tuple[Sequence[str], str]], required: Sequence[str] = (), provenance: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Union of files whose schemas drift, and the files left out with the reason.

    ``spec`` maps an output column to (candidate names, type). Each file's columns are found and cast at
    the scan, which keeps the vectorised reader and column pruning; a missing column is null, a file that
    lacks a required column or can't be read is left out.
    """
    groups: dict[str, tuple[dict[str, str | None], list[str]]] = {}
    bad = {}
    for path in paths:
        try:
            df = spark.read.parquet(path)
        except PySparkException as e:
            bad[path] = str(e).splitlines()[0]
            continue
        found = {out: resolve(df.columns, names) for out, (names, _) in spec.items()}
        if lacking := [c for c in required if not found[c]]:
            bad[path] = f"no column for {', '.join(lacking)}"
            continue
        # Files of one schema are one scan, so the plan grows with the schemas and not with the files.
        groups.setdefault(df.schema.json(), (found, []))[1].append(path)
    frames = []
    for found, same in groups.values():
        columns = [(F.col(f"`{found[out]}`") if found[out] else F.lit(None)).cast(kind).alias(out) for out, (_, kind) in spec.items()]
        frames.append(spark.read.parquet(*same).select(*columns, *([F.col("_metadata.file_name").alias(provenance)] if provenance else [])))
    if not frames:
        schema = T.StructType([T.StructField(out, T._parse_datatype_string(kind)) for out, (_, kind) in spec.items()] + ([T.StructField(provenance, T.StringType())] if provenance else []))
        return spark.createDataFrame([], schema), bad
    return union_all(frames), bad


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_declared(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A scan under a declared schema; declare the wider type where files drift, and cast down."""
    return spark.read.schema(schema).option("mergeSchema", "false").parquet(path)


def read_first_existing(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    for p in paths:
        if path_exists(spark, p):
            return spark.read.parquet(p)
    raise FileNotFoundError(", ".join(paths))


def read_csv(spark: SparkSession, path: str, schema: str, drop_null: Sequence[str] = ()) -> DataFrame:
    df = spark.read.option("header", True).schema(schema).csv(path)
    return df.dropna(subset=list(drop_null)) if drop_null else df


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "overwrite", max_rows_per_file: int = 0) -> None:
    """Parquet sink; with ``by`` rows are dealt by those columns first, so that a directory gets few files."""
    if by:
        df = df.repartition(*[F.col(c) for c in by], F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]), F.lit(8)))
    w = df.write.mode(mode).option("maxRecordsPerFile", max_rows_per_file)
    (w.partitionBy(*by) if by else w).parquet(path)


def file_profile(df: DataFrame) -> DataFrame:
    """file_name, n_rows, n_bytes of each file of a scan."""
    return df.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(F.count(F.lit(1)).alias("n_rows"), F.max("_metadata.file_size").alias("n_bytes"))


def _footer(spark: SparkSession, path: str) -> tuple:
    """A Parquet file's row of ``footer_profile``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(p, conf))
    try:
        blocks = list(reader.getFooter().getBlocks())
        columns = reader.getFooter().getFileMetaData().getSchema().getFieldCount()
        return p.getName(), sum(b.getRowCount() for b in blocks), columns, len(blocks), sum(b.getCompressedSize() for b in blocks), sum(b.getTotalByteSize() for b in blocks)
    finally:
        reader.close()


def page_bytes(spark: SparkSession, path: str) -> tuple[int, int]:
    """Where a Parquet file's row groups begin, and how many bytes they take."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf))
    try:
        blocks = list(reader.getFooter().getBlocks())
        begin = blocks[0].getStartingPos() if blocks else 4
        return begin, blocks[-1].getStartingPos() + blocks[-1].getCompressedSize() - begin if blocks else 0
    finally:
        reader.close()


def footer_profile(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """file_name, n_rows, n_columns, n_row_groups, compressed and uncompressed bytes of Parquet files, from their footers alone."""
    # The driver waits on stores, not on itself, so several footers are read at a time.
    with ThreadPoolExecutor(16) as pool:
        rows = list(pool.map(lambda path: _footer(spark, path), paths))
    return spark.createDataFrame(rows, "file_name string, n_rows long, n_columns int, n_row_groups int, compressed_bytes long, uncompressed_bytes long")


def write_delimited(df: DataFrame, path: str, kind: str = "csv", mode: str = "overwrite") -> None:
    """CSV with a header, or JSON lines."""
    w = df.write.mode(mode)
    w.option("header", True).csv(path) if kind == "csv" else w.json(path)


def year_month(file_name: Column) -> tuple[Column, Column]:
    """Year and month from names like ``..._2024-03.parquet``."""
    return F.regexp_extract(file_name, r"(\d{4})-(\d{2})", 1).cast("int"), F.regexp_extract(file_name, r"(\d{4})-(\d{2})", 2).cast("int")


def schema_diff(frames: Mapping[str, DataFrame]) -> list[tuple[str, str, str | None]]:
    """(column, file, type or None) of each column that any file has, to show where schemas drift."""
    names = sorted({c for df in frames.values() for c in df.columns})
    kinds = {k: dict(df.dtypes) for k, df in frames.items()}
    return [(c, k, kinds[k].get(c)) for c in names for k in frames]


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def keep_distinct_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Projection in the given order, each column once and only those there are."""
    return df.select(*[c for c in dict.fromkeys(columns) if c in df.columns])


def add_missing(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    new = {k: v for k, v in defaults.items() if k not in df.columns}
    return df.withColumns(new) if new else df


def read_whole_files(spark: SparkSession, paths: Sequence[str], schema: str | T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of the files that can be read to their end, and (file, n_footer, n_read) of each that can't.

    A file's footer may be sound and its pages not, which would end a job that reads them. Here all columns of all
    files are decoded once with damaged files cut short, pages are held against their checksums where they have any, and files that gave fewer rows than their footer says, or whose
    footer can't be read (n_footer is null), are listed and left out. The schema is ``schema``, or that of the first sound footer.

    Defined results: an empty file is sound; without any sound file there are no rows, and ``schema`` is needed.
    """
    footers, broken = {}, []

    def n_rows(path: str) -> int | None:
        try:
            return _footer(spark, path)[1]
        except Py4JJavaError:  # not a Parquet file
            return None

    with ThreadPoolExecutor(16) as pool:
        for path, n in zip(paths, pool.map(n_rows, paths), strict=True):
            if n is None:
                broken.append(path)
            else:
                footers[path] = n
    kinds = spark.read.schema(schema).parquet(*footers).schema if schema and footers else spark.read.parquet(next(iter(footers))).schema if footers else spark.createDataFrame([], schema or T.StructType()).schema
    listed = [(p, None, 0) for p in broken]
    good = list(footers)
    if footers:
        rows = spark.read.option("ignoreCorruptFiles", "true").option("parquet.page.verify-checksum.enabled", "true").schema(kinds).parquet(*footers)
        decoded = rows.select(F.col("_metadata.file_path").alias("file"), F.xxhash64(*[f"`{f.name}`" for f in kinds.fields]).alias("h"))
        # The hash of all columns makes the scan decode all of them.
        found = decoded.groupBy("file").agg(F.count("h").alias("n"), F.bit_xor("h").alias("h"))
        n_read = {_file_name(spark, r["file"]): r["n"] for r in found.collect()}  # one row a file
        lost = {p: n_read.get(_file_name(spark, p), 0) for p, n in footers.items() if n_read.get(_file_name(spark, p), 0) < n}
        listed += [(p, footers[p], n) for p, n in lost.items()]
        good = [p for p in footers if p not in lost]
    whole = spark.read.schema(kinds).parquet(*good) if good else spark.createDataFrame([], kinds)
    return whole, spark.createDataFrame(listed, "file string, n_footer long, n_read long")


def _file_name(spark: SparkSession, path: str) -> str:
    """A path with its store, as Spark's file metadata has it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
