"""Profiling: descriptions, shares, crosstabs, correlations, year over year, top-k and histograms."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.expressions import safe_corr
from tidegrid.operators.clean import exact_quantiles, grouped_quantiles


def describe(df: DataFrame, column: str, probs: Sequence[float] = (0.25, 0.5, 0.75), by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact interpolated percentiles and maximum."""
    base = df.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    q = grouped_quantiles(df, F.col(column), probs, by).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], "q")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    both = base.join(q, same, "left") if by else base.withColumn("q", q.scalar())
    names = [f"p{round(p * 100, 4):g}".replace(".", "_") for p in probs]
    return both.select(*by, "n", "mean", "std", "min", *[F.col("q")[i].alias(x) for i, x in enumerate(names)], "max")


def value_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and per cent of all rows of each combination of values."""
    return with_total_share(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")))


def with_total_share(counts: DataFrame, n: str = "n", out: str = "pct") -> DataFrame:
    """``counts`` with each row's per cent of the grand total, a scalar that no task has to gather rows for."""
    return counts.withColumn(out, F.col(n) * 100.0 / counts.agg(F.sum(n)).scalar())


def crosstab_row_pct(df: DataFrame, row: str, column: str) -> DataFrame:
    counts = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("row_pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(row)))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, r) of all pairs, in one pass."""
    pairs = list(combinations_with_replacement(columns, 2))
    wide = df.agg(*[(F.lit(1.0) if x == y else safe_corr(F.col(x), F.col(y))).alias(f"c{i}") for i, (x, y) in enumerate(pairs)])
    long = ", ".join(f"'{x}', '{y}', c{i}" for i, (x, y) in enumerate(pairs))
    return wide.selectExpr(f"stack({len(pairs)}, {long}) as (x, y, r)")


def strong_pairs(corr: DataFrame, least: float = 0.5) -> DataFrame:
    return corr.where((F.col("x") != F.col("y")) & (F.abs("r") > least)).orderBy(F.abs("r").desc(), "x", "y")


def linear_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope, intercept and r of y on x."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), safe_corr(F.col(x), F.col(y)).alias("r"), F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()).alias("n"))


def pct_change(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = (), out: str = "pct_change") -> DataFrame:
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)
    before = F.lag(value).over(w)
    return df.withColumn(out, F.when(before != 0, (F.col(value) - before) * 100.0 / F.nullif(before, F.lit(0))))


def first_in_group(df: DataFrame, by: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """Of each group the ``columns`` of its first row by ``order``, as a map-side aggregate."""
    return df.groupBy(*by).agg(F.min_by(F.struct(*columns), order).alias("_r")).select(*by, *[F.col("_r")[c].alias(c) for c in columns])


def top_k(df: DataFrame, k: int, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rn).where(F.col("rank") <= k)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bucket, n) of ``bins`` equal buckets between the bounds; values outside are clipped into the end ones."""
    c = F.greatest(F.lit(low), F.least(F.col(column), F.lit(high)))
    at = F.least(F.floor((c - low) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def jarque_bera(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """n, population skewness and excess kurtosis, and the Jarque-Bera statistic; null without spread."""
    c = F.col(column)
    m = df.groupBy(*by).agg(F.count(c).alias("n"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurt"))
    return m.withColumn("jb", F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4.0))


def ks_normal(df: DataFrame, column: str) -> DataFrame:
    """Largest distance between the empirical distribution and the normal one of the same mean and deviation.

    Values are counted first; the running share is then a window in parts between approximate quantiles,
    with the parts' own totals carried over, so no task holds the column, whatever its outliers.
    """
    v = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    s = v.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("sd")).first()
    if not s["n"] or not s["sd"]:
        return df.sparkSession.createDataFrame([(s["n"], None)], "n long, ks double")
    marks = sorted(set(v.agg(F.percentile_approx("v", [i / 256 for i in range(1, 256)], 10_000).alias("q")).first()["q"]))
    counts = v.groupBy("v").count().withColumn("part", F.aggregate(F.array(*map(F.lit, marks)), F.lit(0), lambda acc, x: acc + (F.col("v") > x).cast("int")))
    parts = counts.groupBy("part").agg(F.sum("count").alias("c"))
    base = parts.select("part", F.coalesce(F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    upto = counts.join(F.broadcast(base), "part").withColumn("upto", F.col("base") + F.sum("count").over(Window.partitionBy("part").orderBy("v")))
    z = (F.col("v") - s["m"]) / s["sd"] / 2**0.5
    # Abramowitz and Stegun 7.1.26 for the error function.
    t = 1 / (1 + 0.3275911 * F.abs(z))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    cdf = 0.5 * (1 + F.signum(z) * (1 - poly * F.exp(-z * z)))
    gap = F.greatest(F.abs(F.col("upto") / s["n"] - cdf), F.abs(cdf - (F.col("upto") - F.col("count")) / s["n"]))
    return upto.agg(F.sum("count").alias("n"), F.max(gap).alias("ks"))


def qq_points(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """(p, sample_q, normal_q): the column's quantiles beside those of the normal distribution of the same mean and deviation."""
    from statistics import NormalDist

    s = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("sd")).first()
    q = exact_quantiles(df, column, probs)
    rows = [(p, v, None if s["sd"] is None else s["m"] + s["sd"] * NormalDist().inv_cdf(p)) for p, v in zip(probs, q, strict=True)]
    return df.sparkSession.createDataFrame(rows, "p double, sample_q double, normal_q double")
