"""Guarded arithmetic, buckets, labels and sample moments as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` where ``den`` is positive, else null."""
    return F.when(den > 0, num / den)


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """``c`` within bounds; null stays null."""
    if low is not None:
        c = F.when(c < low, F.lit(low)).otherwise(c)
    if high is not None:
        c = F.when(c > high, F.lit(high)).otherwise(c)
    return c


def buckets(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed interval that holds ``c``; null outside, the lowest edge included in nothing."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        out = F.when((c > lo) & (c <= hi), label).otherwise(out)
    return out


def label(c: Column, names: Mapping, default: str) -> Column:
    """Names of codes, by a literal map."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))


def first_match(c: Column, groups: Sequence[tuple[str, Sequence]], default: str) -> Column:
    """Name of the first group that lists ``c``."""
    out = F.lit(default)
    for name, members in reversed(groups):
        out = F.when(c.isin(list(members)), name).otherwise(out)
    return out


def adjusted_skewness(c: Column) -> Column:
    """Sample skewness G1 from Spark's population skewness; null below three rows or without spread."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def adjusted_kurtosis(c: Column) -> Column:
    """Sample excess kurtosis G2 from Spark's population kurtosis."""
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis(c) + 6))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, 0 where either column is constant."""
    x2, y2 = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = (F.coalesce(F.stddev_pop(x2), F.lit(0.0)) > 0) & (F.coalesce(F.stddev_pop(y2), F.lit(0.0)) > 0)
    cov = F.covar_pop(x2, y2) / F.nullif(F.stddev_pop(x2) * F.stddev_pop(y2), F.lit(0.0))
    return F.when(spread, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov))).otherwise(F.lit(0.0))
