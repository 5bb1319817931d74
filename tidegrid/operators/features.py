"""Window features over a dense panel. All of one key's windows share one partitioning and one sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.timebins import epoch


def by_time(key: str | Sequence[str], ts: str = "bin"):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(ts)


def lags(value: str, ks: Sequence[int], w, fill: float | None = None, prefix: str = "lag_") -> dict[str, Column]:
    out = {f"{prefix}{k}": F.lag(value, k).over(w) for k in ks}
    return out if fill is None else {n: F.coalesce(c, F.lit(fill)) for n, c in out.items()}


def trailing(w, rows: int, include_current: bool = False):
    return w.rowsBetween(-rows + 1, 0) if include_current else w.rowsBetween(-rows, -1)


def rolling_skewness(value: str, frame) -> Column:
    """Population skewness from raw moments; null without spread or below two rows."""
    x = F.col(value).cast("double")
    n, s1, s2, s3 = F.count(x).over(frame), F.sum(x).over(frame), F.sum(x * x).over(frame), F.sum(x * x * x).over(frame)
    m = s1 / n
    var = s2 / n - m * m
    third = s3 / n - 3 * m * s2 / n + 2 * m * m * m
    return F.when((n > 1) & (var > 1e-12), third / F.nullif(F.pow(var, F.lit(1.5)), F.lit(0.0)))


def rolling(value: str, rows: int, w, prefix: str = "roll_") -> dict[str, Column]:
    """Count, maximum, minimum, mean, sample deviation and skewness of the ``rows`` rows before."""
    f = trailing(w, rows)
    return {
        f"{prefix}count": F.count(value).over(f),
        f"{prefix}max": F.max(value).over(f),
        f"{prefix}min": F.min(value).over(f),
        f"{prefix}mean": F.avg(value).over(f),
        f"{prefix}std": F.stddev_samp(value).over(f),
        f"{prefix}skew": rolling_skewness(value, f),
    }


def ewma(value: str, w, alpha: float = 0.3, terms: int = 60) -> Column:
    """Truncated exponentially weighted mean of the rows before; rows there aren't count as 0."""
    past = F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).over(w.rowsBetween(-terms, -1))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(alpha).alias("a"))
    step = lambda acc, x: F.struct((acc["s"] + x * acc["a"]).alias("s"), (acc["a"] * (1 - alpha)).alias("a"))
    return F.aggregate(F.reverse(past), start, step, lambda acc: acc["s"])


def weekly_average(value: str, w, bins_per_week: int, weeks: int = 1) -> Column:
    """Mean of the same slot in the last ``weeks`` weeks, as far as there are any."""
    past = [F.lag(value, bins_per_week * i).over(w) for i in range(1, weeks + 1)]
    n = sum((p.isNotNull().cast("int") for p in past[1:]), past[0].isNotNull().cast("int"))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in past[1:]), F.coalesce(past[0], F.lit(0.0)))
    return F.when(n > 0, total / n)


def zscore(value: str, key: str | Sequence[str], ddof: int = 1) -> Column:
    """Standard score within a key; 0 without spread."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key))
    sd = (F.stddev_samp(value) if ddof else F.stddev_pop(value)).over(w)
    return F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / F.nullif(sd, F.lit(0.0))).otherwise(F.lit(0.0))


def sequence_windows(df: DataFrame, columns: Sequence[str], rows: int, w, include_current: bool = False, out: str = "sequence") -> DataFrame:
    """Rows with a full window of ``rows`` steps of ``columns``; the current row is left out unless asked for."""
    step = F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in columns])
    return df.withColumn(out, F.collect_list(step).over(trailing(w, rows, include_current))).where(F.size(out) == rows)


def sequence_moments(df: DataFrame, n_features: int, column: str = "sequence", ddof: int = 0) -> DataFrame:
    """(feature, mean, std, lo, hi) of each feature over all steps of all sequences."""
    steps = df.select(F.explode(column).alias("step")).select(F.posexplode("step").alias("feature", "x")).select("feature", F.col("x").cast("double").alias("x"))
    std = F.stddev_samp("x") if ddof else F.stddev_pop("x")
    return steps.where(F.col("feature") < n_features).groupBy("feature").agg(F.avg("x").alias("mean"), std.alias("std"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def scale_sequences(df: DataFrame, moments: DataFrame, how: str = "standard", column: str = "sequence", out: str = "scaled") -> DataFrame:
    """Sequences with each feature scaled by moments fitted elsewhere; 0 without spread. Moments are one row a feature."""
    shift, width = ("mean", F.col("std")) if how == "standard" else ("lo", F.col("hi") - F.col("lo"))
    table = F.array_sort(F.collect_list(F.struct("feature", F.col(shift).alias("shift"), width.alias("width"))))
    fitted = moments.agg(table.alias("m")).scalar()
    cell = lambda x, m: F.when(m["width"] > 0, (x.cast("double") - m["shift"]) / m["width"]).otherwise(F.lit(0.0))
    rows = df.withColumn("_m", fitted)
    return rows.withColumn(out, F.transform(column, lambda step: F.zip_with(step, F.col("_m"), cell))).drop("_m")


def lag_array(value: str, n: int, w) -> Column:
    """The ``n`` values before, newest first."""
    return F.array(*[F.lag(value, k).over(w) for k in range(1, n + 1)])


def readiness(time_idx: Column, day: int = 48, week: int = 336) -> dict[str, Column]:
    """Which features have their whole history at an index."""
    flag = lambda c: c.cast("int")
    return {"has_lag5": flag(time_idx >= 5), "has_day": flag(time_idx >= day), "has_ewma": flag(time_idx >= 60), "has_week": flag(time_idx >= week), "cold_start": flag(time_idx < day), "ready": flag(time_idx >= week)}


def min_gap_seconds(df: DataFrame, ts: str = "bin") -> DataFrame:
    """Smallest gap between distinct bins, in windows of a day and then over the days' ends."""
    bins = df.select(F.col(ts).alias("t")).distinct().select(epoch("t").alias("s"), F.to_date("t").alias("d"))
    inside = bins.select("d", "s", (F.col("s") - F.lag("s").over(Window.partitionBy("d").orderBy("s"))).alias("gap"))
    days = inside.groupBy("d").agg(F.min("gap").alias("gap"), F.min("s").alias("first"), F.max("s").alias("last"))
    year = Window.partitionBy(F.lit(0)).orderBy("d")
    return days.select("gap", (F.col("first") - F.lag("last").over(year)).alias("over")).agg(F.least(F.min("gap"), F.min("over")).alias("min_gap_seconds"))


def similarity(series: DataFrame, key: str, cluster: str, value: str, ddof: int = 1) -> DataFrame:
    """Of each key the mean product of its z-scores with those of its own cluster's mean series (intra) and the largest with another's (inter)."""
    reps = series.groupBy(cluster, "bin").agg(F.avg(value).alias("rep"))
    reps = reps.select(F.col(cluster).alias("rep_cluster"), "bin", zscore("rep", cluster, ddof).alias("z_rep"))
    local = series.select(key, cluster, "bin", zscore(value, key, ddof).alias("z"))
    pairs = local.join(reps, "bin").groupBy(key, cluster, "rep_cluster").agg(F.avg(F.col("z") * F.col("z_rep")).alias("sim"))
    own = F.col(cluster) == F.col("rep_cluster")
    return pairs.groupBy(key, cluster).agg(F.max(F.when(own, F.col("sim"))).alias("intra_sim"), F.max(F.when(~own, F.col("sim"))).alias("inter_sim"))
