"""Chronological and hashed splits."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_split(df: DataFrame, key: str, ts: str = "bin", train: float = 0.7, least_train: int = 0, least_test: int = 0) -> DataFrame:
    """First ``floor(train * n)`` rows of each key are train; bounds as for seasonal models are optional."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    cut = F.floor(n * train)
    if least_train:
        cut = F.greatest(cut, F.lit(least_train))
    if least_test:
        cut = F.least(cut, n - least_test)
    rn = F.row_number().over(Window.partitionBy(key).orderBy(ts))
    return df.withColumns({"rn": rn, "n_key": n, "train_cut": cut}).withColumn("split", F.when(F.col("rn") <= F.col("train_cut"), "train").otherwise("test"))


def time_split(df: DataFrame, ts: str, start, end, shares: Sequence[float] = (0.7, 0.2, 0.1), names: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """Split by the wall clock between ``start`` and ``end``."""
    seconds, done, out = (end - start).total_seconds(), 0.0, F.lit(names[-1])
    cuts = []
    for share in shares[:-1]:
        done += share
        cuts.append(start + timedelta(seconds=int(seconds * done + 1e-9)))
    for cut, name in reversed(list(zip(cuts, names[:-1], strict=True))):
        out = F.when(F.col(ts) < F.lit(cut).cast("timestamp_ntz"), name).otherwise(out)
    return df.withColumn("split", out)


def canonical_split(c: Column) -> Column:
    """train, validation or test from their usual spellings; null for any other."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("train", "training"), "train").when(low.isin("val", "valid", "validation", "dev"), "validation").when(low.isin("test", "testing"), "test")


def hashed_fraction(key: Column, share: float, seed: int = 42) -> Column:
    """A sample that doesn't depend on partitioning: by the first 32 bits of the MD5 of seed and key."""
    return hashed_place(key, seed) < int(share * (1 << 32))


def hashed_place(key: Column, seed: int = 42) -> Column:
    """A number below 2**32 for each key, as good as drawn."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, or all: those of the smallest hashed places, as a top-n that each task takes first."""
    return df.orderBy(hashed_place(F.col(key), seed), key).limit(n)


def stratified_sample(df: DataFrame, stratum: str, order: Sequence[Column], n: int, total: int) -> DataFrame:
    """About ``n`` of ``total`` rows, from each stratum its share and at least one; ``order`` decides which."""
    w = Window.partitionBy(stratum)
    size = F.count(F.lit(1)).over(w)
    rn = F.row_number().over(w.orderBy(*order))
    return df.withColumns({"_size": size, "_rn": rn}).where(F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_size") * (n / max(total, 1))))).drop("_size", "_rn")
