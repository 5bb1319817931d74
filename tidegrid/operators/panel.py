"""Demand panels: sparse bin counts, dense grids, active keys, pivots and resampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.timebins import epoch, from_epoch, time_bin


def bin_counts(df: DataFrame, key: str, ts: str, seconds: int, value: str | None = None, out: str = "demand") -> DataFrame:
    """(key, bin, out): rows in each observed bin, or the sum of ``value``."""
    measure = F.count(F.lit(1)) if value is None else F.sum(value)
    return df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(key), time_bin(ts, seconds).alias("bin")).agg(measure.alias(out))


def time_grid(keys: DataFrame, key: str, start: Column, end: Column, seconds: int) -> DataFrame:
    """Every bin from ``start`` to ``end`` (both inclusive) for each distinct key, generated a key at a time and not joined."""
    steps = F.sequence(epoch(start), epoch(end), F.lit(seconds).cast("long"))
    return keys.select(key).distinct().select(key, F.explode(steps).alias("s")).select(key, from_epoch(F.col("s")).alias("bin"))


def densify(counts: DataFrame, key: str, seconds: int, value: str = "demand", keys: DataFrame | None = None, fill: float = 0.0) -> DataFrame:
    """Full key x bin grid between the first and the last observed bin; bins without rows hold ``fill``."""
    # Scalar subqueries over the same aggregate, whose exchange they share: the events are read once.
    lo, hi = counts.agg(F.min("bin")).scalar(), counts.agg(F.max("bin")).scalar()
    grid = time_grid(counts if keys is None else keys, key, lo, hi, seconds)
    return grid.join(counts, [key, "bin"], "left").select(key, "bin", F.coalesce(F.col(value).cast("double"), F.lit(fill)).alias(value))


def active_by_span(counts: DataFrame, key: str, seconds: int, least: float = 0.05) -> DataFrame:
    """Keys observed in at least ``least`` of the bins between the first and the last bin of all."""
    span = F.floor((epoch("hi") - epoch("lo")) / seconds) + 1
    ends = counts.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).select(span.alias("n"))
    found = counts.groupBy(key).agg(F.count_distinct("bin").alias("n_bins"))
    return found.withColumn("active_ratio", F.col("n_bins") / ends.scalar()).where(F.col("active_ratio") >= least)


def active_in_train(dense: DataFrame, key: str, cut: Column, value: str = "demand", least: float = 0.05) -> DataFrame:
    """Keys with demand above 0 in at least ``least`` of the dense bins before ``cut``."""
    share = F.avg((F.col(value) > 0).cast("double"))
    return dense.where(F.col("bin") < cut).groupBy(key).agg(share.alias("active_ratio")).where(F.col("active_ratio") >= least)


def active_by_mean(counts: DataFrame, key: str, least: float, value: str = "demand") -> DataFrame:
    """Keys whose total over the distinct observed bins of all keys is at least ``least``."""
    bins = counts.agg(F.count_distinct("bin")).scalar()
    return counts.groupBy(key).agg(F.sum(value).alias("total")).select(key, (F.col("total") / bins).alias("mean_demand")).where(F.col("mean_demand") >= least)


def keep_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def pivot_sum(df: DataFrame, rows: Sequence[str], column: str, values: Sequence, value: str, fill: float = 0.0) -> DataFrame:
    """Wide table with a column for each of ``values``, which are given so that no job has to find them."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(F.sum(value)).na.fill(fill)


def resample_seconds(n_keys: int, span_seconds: int, base: int, max_bins: int = 4096, max_cells: int = 12_000_000) -> int:
    """Smallest multiple of ``base`` that keeps bins and cells within bounds, by arithmetic and without jobs."""
    bins = max(1, min(max_bins, max_cells // max(1, n_keys)))
    return base * max(1, -(-(span_seconds // base + 1) // bins))


def resample(dense: DataFrame, key: str, seconds: int, value: str = "demand") -> DataFrame:
    return dense.groupBy(key, time_bin("bin", seconds).alias("bin")).agg(F.sum(value).alias(value))
