"""Forecast metrics as aggregate expressions: usable in any ``agg``, grouped or not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def mape(y: Column, p: Column) -> Column:
    """Per cent, over rows with y > 0."""
    return F.avg(F.when(y > 0, F.abs((y - p) / F.nullif(y, F.lit(0.0))))) * 100


def smape(y: Column, p: Column, eps: float = 1e-6) -> Column:
    return F.avg(2 * F.abs(y - p) / (F.abs(y) + F.abs(p) + eps)) * 100


def wmape(y: Column, p: Column, least: float = 1e-9) -> Column:
    total = F.sum(F.abs(y))
    return F.when(total >= least, F.sum(F.abs(y - p)) / F.nullif(total, F.lit(0.0)) * 100)


def r2(y: Column, p: Column) -> Column:
    """Null where y has no spread."""
    n = F.count(y)
    sst = F.var_pop(y) * n
    return F.when(sst > 0, 1 - F.sum((y - p) * (y - p)) / F.nullif(sst, F.lit(0.0)))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows where ``value`` is neither null nor NaN."""
    ok = value.isNotNull() & ~F.isnan(value)
    return F.sum(F.when(ok, value * weight)) / F.nullif(F.sum(F.when(ok, weight)).cast("double"), F.lit(0.0))


def nan_mean(value: Column) -> Column:
    return F.avg(F.when(~F.isnan(value), value))


def all_metrics(y: Column, p: Column) -> list[Column]:
    return [f(y, p).alias(f.__name__) for f in (mae, rmse, mape, smape, wmape, r2)]
