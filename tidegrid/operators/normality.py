"""Tests of normality with p values.

Defined results: null and NaN values don't count; without spread, or with fewer than three values, statistic and p value are null;
an empty table gives one row with n = 0 and nulls (no row for a grouped test).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.normal import normal_above, normal_quantile, polynomial
from tidegrid.operators.profile import jarque_bera, ks_normal
from tidegrid.operators.splits import hashed_place

#: Values that Royston's approximation holds for.
MOST = 5000
#: Parts that a group is drawn from.
PARTS = 32
#: Terms of Kolmogorov's series.
_TERMS = 100
#: Royston's polynomials (AS R94), from the highest power down; the outer weights by 1 / sqrt(n), mean and log deviation by n or log n.
_LAST, _SECOND = [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
_FEW_SHIFT, _FEW_MEAN, _FEW_LOG_SD = [0.459, -2.273], [-6.714e-4, 0.025054, -0.39978, 0.5440], [-0.0020322, 0.062767, -0.77857, 1.3822]
_MANY_MEAN, _MANY_LOG_SD = [0.0038915, -0.083751, -0.31082, -1.5861], [0.0030302, -0.082676, -0.4803]


def shapiro_p_value(w: Column, n: Column) -> Column:
    """The p value of a Shapiro-Wilk statistic of ``n`` values, 3 to 5000."""
    x = F.log1p(-F.least(w, F.lit(1.0 - 1e-15)))
    n = n.cast("double")
    few = (-F.log(polynomial(n, _FEW_SHIFT) - x) - polynomial(n, _FEW_MEAN)) / F.exp(polynomial(n, _FEW_LOG_SD))
    many = (x - polynomial(F.log(n), _MANY_MEAN)) / F.exp(polynomial(F.log(n), _MANY_LOG_SD))
    three = 6.0 / 3.141592653589793 * (F.asin(F.sqrt(w)) - F.asin(F.lit(0.75**0.5)))
    # Below the shift of few values the statistic is as small as it gets.
    return F.when(n == 3, F.greatest(three, F.lit(0.0))).when((n <= 11) & (x >= polynomial(n, _FEW_SHIFT)), 0.0).when(n <= 11, normal_above(few)).otherwise(normal_above(many))


def shapiro_wilk(df: DataFrame, column: str, key: str, by: Sequence[str] = (), sample: int = MOST, seed: int = 42) -> DataFrame:
    """(by, n, w, p_value): the Shapiro-Wilk test on a sample of each group.

    The method is defined for up to 5000 values, so a group's ``sample`` values of the smallest hashed places of ``key``, or
    all, are tested; they are the same whatever the partitioning. Groups are drawn from in ``PARTS`` hashed parts first, so a
    hot group is spread, and its last task gets ``PARTS`` samples at most. Only the sample is put in order.
    """
    if not 3 <= sample <= MOST:
        raise ValueError(f"the sample must have 3 to {MOST} values")
    names = [f"_g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col(column).cast("double").alias("v"), hashed_place(F.col(key), seed).alias("place"), F.col(key).cast("string").alias("k"))
    rows = rows.where(F.col("v").isNotNull() & ~F.isnan("v"))
    if names:
        first = Window.orderBy("place", "k", "v")
        drawn = rows.withColumn("part", F.pmod(F.xxhash64("k"), F.lit(PARTS)))
        for within in ([*names, "part"], names):
            drawn = drawn.withColumn("rn", F.row_number().over(first.partitionBy(*within))).where(F.col("rn") <= sample)
        drawn = drawn.drop("rn", "part")
    else:  # a top-n, which each task takes first
        drawn = rows.orderBy("place", "k", "v").limit(sample)
    own = Window.partitionBy(*(names or [F.lit(0)]))
    n = F.count(F.lit(1)).over(own)
    ranked = drawn.withColumns({"n": n, "i": F.row_number().over(own.orderBy("v"))})
    ranked = ranked.withColumn("m", normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25)))
    u = 1.0 / F.sqrt(F.col("n"))
    top, next_ = (F.max(F.when(F.col("i") == F.col("n") - k, F.col("m"))).over(own) for k in (0, 1))
    ranked = ranked.withColumns({"ss": F.sum(F.col("m") * F.col("m")).over(own), "m1": top, "m2": next_})
    a1 = F.when(F.col("n") == 3, F.lit(0.5**0.5)).otherwise(F.col("m1") / F.sqrt("ss") + polynomial(u, _LAST))
    ranked = ranked.withColumns({"a1": a1, "a2": F.when(F.col("n") > 5, F.col("m2") / F.sqrt("ss") + polynomial(u, _SECOND))})
    c = F.col
    rest = F.when(c("n") > 5, (c("ss") - 2 * c("m1") ** 2 - 2 * c("m2") ** 2) / (1 - 2 * c("a1") ** 2 - 2 * c("a2") ** 2)).when(c("n") > 3, (c("ss") - 2 * c("m1") ** 2) / (1 - 2 * c("a1") ** 2))
    from_end = F.least(c("i") - 1, c("n") - c("i"))
    weight = F.when(from_end == 0, c("a1")).when((from_end == 1) & (c("n") > 5), c("a2")).otherwise(F.abs(c("m")) / F.sqrt(rest))
    # The middle of an odd number, and of three values, has no weight.
    weight = F.when(2 * c("i") == c("n") + 1, 0.0).otherwise(F.signum(2 * c("i") - c("n") - 1) * weight)
    found = ranked.withColumn("a", weight).groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum(c("a") * c("v")).alias("b"), (F.var_pop("v") * F.count(F.lit(1))).alias("s"), (F.max("v") - F.min("v")).alias("span"))
    w = F.when((c("n") >= 3) & (c("span") > 0), F.least(c("b") * c("b") / c("s"), F.lit(1.0)))
    found = found.withColumn("w", w)
    return found.select(*[F.col(g).alias(b) for g, b in zip(names, by, strict=True)], "n", "w", F.when(c("w").isNotNull(), shapiro_p_value(c("w"), c("n"))).alias("p_value"))


def kolmogorov_above(d: Column, n: Column) -> Column:
    """The p value of a Kolmogorov-Smirnov distance of ``n`` values, by its limit's series."""
    x = F.sqrt(n.cast("double")) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    # Below a fifth the limit differs from 1 by less than 1e-11, and the series no longer shows it.
    return F.when(d.isNull(), F.lit(None)).when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(series, F.lit(1.0))))


def ks_test(df: DataFrame, column: str) -> DataFrame:
    """(n, ks, p_value) against the normal distribution of the column's own mean and deviation, taken as given."""
    return ks_normal(df, column).withColumn("p_value", kolmogorov_above(F.col("ks"), F.col("n")))


def jarque_bera_test(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, skew, kurt, jb, p_value): the statistic is chi-squared with two degrees of freedom in the limit."""
    return jarque_bera(df, column, by).withColumn("p_value", F.exp(-F.col("jb") / 2.0))
