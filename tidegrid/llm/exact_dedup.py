"""Exact dedup against a persistent digest index.

The index is a folder of one row for each distinct text, bucketed and sorted by SHA-256. An arrival is
reduced to one row for each digest with map-side aggregation, a sort-merge anti-join with the index
finds the digests that are new, and those are appended to it. The number of buckets stands in a small file
beside the data, so any later session opens the index by its path.

An arrival has a name, and rows of the index say which one brought them. Once its rows are appended it commits
the next free version, by a rename that must not replace anything. Only then is it decided: of the committed
arrivals that brought a text the one of the lowest version has it. All of lower versions had appended before, so
two arrivals at once never both keep a text, and none waits for another. Rows of an arrival that hasn't committed hold
back nobody's; if it died and is added again under its name, it appends and commits as if for the first time. An
arrival that has committed gives the same decisions when it is added again. Two writers at once must not use one name.

Every arrival adds a file to a bucket. ``compact`` writes one for each bucket again and deletes the files before it that are
older than ``min_age_s``, which has to be longer than any arrival or reader takes.

Defined results: a null text counts as empty; equal texts are byte-identical; of equal texts in one
arrival the largest doc_id stays; a text that an earlier arrival brought stays with that arrival's row.
Rows repeated with the same doc_id and text share one decision. Only ``id_col`` and ``text_col`` are
read, so other columns of any name do no harm; an empty arrival gives an empty result. Opening an index
writes no data; opening a name with another path or number of buckets than it has raises ValueError.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch, commit_text, fresh_names, list_folder, materialize, read_text, remove_path, scratch_path, write_text

_ABOUT, _VERSIONS = "_index.json", "_versions"
#: The version of rows whose arrival hasn't committed.
_NOT_YET = (1 << 63) - 1


class DigestIndex:
    """Digest index at ``path`` or of a ``name`` in the catalog; ``buckets`` is set once, by default to the session's shuffle partitions."""

    def __init__(self, spark: SparkSession, path: str | None = None, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        if name and spark.catalog.tableExists(name):
            known = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
            self.path = known["Location"].rstrip("/")
            self.buckets = int(known["Num Buckets"])
            if path and not _same_place(spark, path, self.path):
                raise ValueError(f"{name} is at {self.path}")
        else:
            self.path = (path or scratch_path(spark, "digest-index")).rstrip("/")
            about = read_text(spark, f"{self.path}/{_ABOUT}")
            self.buckets = json.loads(about)["buckets"] if about else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            if not about:
                write_text(spark, f"{self.path}/{_ABOUT}", json.dumps({"buckets": self.buckets}))
            spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, arrival STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        if buckets and buckets != self.buckets:
            raise ValueError(f"the index has {self.buckets} buckets")

    def _append(self, df: DataFrame) -> None:
        # Dealt by the bucket's own hash, each task writes one bucket.
        df.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def _rows(self) -> DataFrame:
        """All rows, with the version of their arrival."""
        self.spark.catalog.refreshTable(self.name)
        versions = list_folder(self.spark, f"{self.path}/{_VERSIONS}")
        rows = self.spark.table(self.name)
        if not versions:
            return rows.withColumn("version", F.lit(_NOT_YET))
        known = self.spark.read.schema("arrival string, version long").json([f"{self.path}/{_VERSIONS}/{n}" for n, _ in versions]).groupBy("arrival").agg(F.min("version").alias("version"))
        return rows.join(known, "arrival", "left").withColumn("version", F.coalesce("version", F.lit(_NOT_YET)))

    def entries(self, committed: bool = False) -> DataFrame:
        """(digest, keep_id, arrival, version): one row for each text, its lowest version; ``committed``: of committed arrivals only."""
        rows = self._rows()
        rows = rows.where(F.col("version") < _NOT_YET) if committed else rows
        first = F.min(F.struct("version", "arrival", "keep_id")).alias("r")
        return rows.groupBy("digest").agg(first).select("digest", "r.keep_id", "r.arrival", "r.version")

    def _commit(self, arrival: str) -> None:
        """Take the next free version, unless the arrival has one."""
        folder = f"{self.path}/{_VERSIONS}"
        version = 0
        for name, _ in sorted(list_folder(self.spark, folder)):
            version = int(name[1:-5])
            if json.loads(read_text(self.spark, f"{folder}/{name}"))["arrival"] == arrival:
                return
        while not commit_text(self.spark, f"{folder}/v{version + 1:012d}.json", json.dumps({"arrival": arrival, "version": version + 1})):
            version += 1

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrival: str | None = None) -> DataFrame:
        """Append what is new in ``docs``; return (digest, keep_id, group_size, is_new) of each distinct text in it."""
        arrival = arrival or uuid.uuid4().hex
        arrived = docs.select(F.col(id_col).cast("long").alias("id"), digest(text_col).alias("digest")).groupBy("digest").agg(F.max("id").alias("last_id"), F.count(F.lit(1)).alias("group_size"))
        with Scratch(self.spark) as scratch:
            arrived = scratch.put(arrived, "digest-arrival", gather=False)
            fresh = arrived.join(self.entries(committed=True).hint("merge"), "digest", "left_anti")
            self._append(fresh.select("digest", F.col("last_id").alias("keep_id"), F.lit(arrival).alias("arrival")))
            self._commit(arrival)
            found = arrived.join(self.entries(committed=True).hint("merge"), "digest")
            return materialize(found.select("digest", "keep_id", "group_size", (F.col("arrival") == arrival).alias("is_new")), "digest-groups")

    def compact(self, min_age_s: float = 24 * 3600) -> None:
        """One file a bucket of all that is committed; files before it go once they are old enough."""
        before = [n for n, changed in list_folder(self.spark, self.path) if n.endswith(".parquet") and changed <= (time.time() - min_age_s) * 1000]
        self._append(self.entries(committed=True).select("digest", "keep_id", "arrival"))
        for name in before:
            remove_path(self.spark, f"{self.path}/{name}")
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        """Forget the index and delete its data."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove_path(self.spark, self.path)


def _same_place(spark: SparkSession, a: str, b: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    full = [str(p.getFileSystem(conf).makeQualified(p)) for p in (path(a), path(b))]
    return full[0] == full[1]


def digest(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def _groups(docs: DataFrame, index: DigestIndex | None, id_col: str, text_col: str, arrival: str | None) -> DataFrame:
    if index:
        return index.add(docs, id_col, text_col, arrival)
    index = DigestIndex(docs.sparkSession)
    try:
        return index.add(docs, id_col, text_col)
    finally:
        index.drop()  # the decisions are written apart from it


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", arrival: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256; without an ``index`` against one of its own."""
    groups = _groups(docs, index, id_col, text_col, arrival)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text_col).alias("digest"))
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", arrival: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    d, i, own, keep = fresh_names(docs, "digest", "id", "own", "keep")
    stays = _groups(docs, index, id_col, text_col, arrival).where("is_new").select(F.col("digest").alias(d), F.col("keep_id").alias(keep))
    rows = docs.withColumns({own: digest(text_col), i: F.col(id_col).cast("long")})
    return rows.join(stays, (F.col(own) == F.col(d)) & F.col(i).eqNullSafe(F.col(keep)), "left_semi").drop(own, i)
