"""Size-tiered compaction of immutable shards under a versioned manifest.

Arrivals are written as small immutable Parquet files. ``compact`` puts the live files in tiers by size;
a tier that has ``fan_in`` files or more is merged into files of about ``target_bytes``, tiers of files
that have reached the target are left alone. A reader sees the files that one manifest lists and nothing
else: a version is committed by renaming a finished file to a name that must not exist yet, so a job that
dies, or loses a race, leaves the last version as it was. This relies on a store whose renames are atomic, as
HDFS's and local ones are; object stores' aren't. A version is committed only if its new files
are there. ``vacuum`` deletes files that no kept version lists once they are older than ``min_age_s``, which
has to be longer than any writer takes; so the files of an arrival in flight stay.

Defined results: every row of every arrival is read back exactly once, with nulls, empty and very long
texts, repeats and extra columns as they came; columns that an arrival lacks are null; a column whose name
differs from a known one in case only is that column; types are compared, and stored, with nulls allowed at every depth; one of another type than before raises ValueError
before anything is written; an empty arrival commits a version without files.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ShardConflict(RuntimeError):
    """Another writer has committed the version first."""


class MissingFiles(RuntimeError):
    """Files that a version would list aren't there."""


def nullable(kind: T.DataType) -> T.DataType:
    """``kind`` with nulls allowed at every depth, as it is stored and compared."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType))
    return kind


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fan_in: int = 4, shard_rows: int = 0):
        self.spark, self.path, self.target_bytes, self.fan_in, self.shard_rows = spark, path.rstrip("/"), target_bytes, fan_in, shard_rows
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self):
        return self._path(self.path).getFileSystem(self._conf)

    def _check(self, files: list[dict]) -> None:
        lost = [f["path"] for f in files if not self._fs().exists(self._path(f["path"]))]
        if lost:
            raise MissingFiles(f"{len(lost)} files to commit are gone, {lost[0]} among them")

    def _files(self, folder: str) -> list[dict]:
        found = self._fs().listStatus(self._path(folder))
        return [{"path": s.getPath().toString(), "bytes": s.getLen()} for s in found if s.getPath().getName().endswith(".parquet")]

    def _old_files(self, folder: str, before_ms: int) -> list[str]:
        found = self._fs().listStatus(self._path(folder))
        return [s.getPath().toString() for s in found if s.isFile() and s.getModificationTime() <= before_ms]

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path(f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "files": [], "schema": None}
        stream = self._fs().open(self._path(f"{self.path}/manifest/v{version:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: dict, files: list[dict], schema: str) -> int:
        version = base["version"] + 1
        known = {f["path"] for f in base["files"]}
        self._check([f for f in files if f["path"] not in known])
        fs = self._fs()
        final = self._path(f"{self.path}/manifest/v{version:012d}.json")
        draft = self._path(f"{self.path}/manifest/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": version, "files": files, "schema": schema}).encode()))
        out.close()
        if fs.exists(final):
            fs.delete(draft, False)
            raise ShardConflict(f"version {version} exists")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        try:
            context.rename(draft, final, self.spark.sparkContext._gateway.new_array(rename, 0))
        except Exception as e:
            fs.delete(draft, False)
            raise ShardConflict(f"version {version} exists") from e
        return version

    def _write(self, df: DataFrame) -> list[dict]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", self.shard_rows).parquet(folder)
        return self._files(folder)

    def append(self, df: DataFrame) -> int:
        base = self.manifest()
        old = T.StructType.fromJson(json.loads(base["schema"])) if base["schema"] else T.StructType()
        known = {f.name.lower(): f for f in old.fields}
        for f in df.schema.fields:
            has = known.get(f.name.lower())
            if has and nullable(has.dataType) != nullable(f.dataType):
                raise ValueError(f"{f.name} is {f.dataType.simpleString()}, it was {has.dataType.simpleString()}")
        df = df.select(*[F.col(f"`{f.name}`").alias(known[f.name.lower()].name if f.name.lower() in known else f.name) for f in df.schema.fields])
        new = T.StructType([*old.fields, *[T.StructField(f.name, nullable(f.dataType)) for f in df.schema.fields if f.name.lower() not in known]])
        return self._commit(base, [*base["files"], *self._write(df)], new.json())

    def plan(self, files: list[dict]) -> list[list[dict]]:
        """Runs of similarly sized files below the target, each of ``fan_in`` files or more."""
        tiers: dict[int, list[dict]] = {}
        for f in files:
            if f["bytes"] < self.target_bytes // 2:
                tiers.setdefault(int(math.log(max(f["bytes"], 1), self.fan_in)), []).append(f)
        return [run for _, run in sorted(tiers.items()) if len(run) >= self.fan_in]

    def compact(self) -> int:
        """Merge until no tier is full; returns the last version."""
        while runs := self.plan((base := self.manifest())["files"]):
            merged, gone = [], set()
            schema = T.StructType.fromJson(json.loads(base["schema"]))
            for run in runs:
                n = max(1, round(sum(f["bytes"] for f in run) / self.target_bytes))
                df = self.spark.read.schema(schema).parquet(*[f["path"] for f in run])
                store = ShardStore(self.spark, self.path, self.target_bytes, self.fan_in)
                merged += store._write(df.coalesce(n))
                gone |= {f["path"] for f in run}
            self._commit(base, [f for f in base["files"] if f["path"] not in gone] + merged, base["schema"])
        return base["version"]

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        schema = T.StructType.fromJson(json.loads(m["schema"])) if m["schema"] else T.StructType()
        if not m["files"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f["path"] for f in m["files"]])

    def vacuum(self, keep_versions: int = 1, min_age_s: float = 24 * 3600) -> int:
        """Delete data files that none of the last versions lists and that are at least ``min_age_s`` old; older versions can't be read after it."""
        before = int((time.time() - min_age_s) * 1000)
        fs, data = self._fs(), self._path(f"{self.path}/data")
        if not fs.exists(data):
            return 0
        old = [p for folder in fs.listStatus(data) for p in self._old_files(folder.getPath().toString(), before)]
        # Versions are read after the files, so that one committed meanwhile counts.
        live = {f["path"] for v in self.versions()[-keep_versions:] for f in self.manifest(v)["files"]}
        return sum(bool(fs.delete(self._path(p), False)) for p in old if p.endswith(".parquet") and p not in live)
