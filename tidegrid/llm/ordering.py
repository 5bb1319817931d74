"""Global positions of rows in an order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch, fresh_names

_ROWS = (1 << 33) - 1


def with_positions(scratch: Scratch, df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """``df`` with column ``name``: each row's place, from 0, in the order of ``order``.

    Rows are dealt by ranges of the order and sorted where they land, then written with their place
    there; only the number of rows of each range is added up in one task. Rows that are equal in all of
    ``order`` share a range, so it should end in what tells rows apart. ``df`` is read twice (once for
    the ranges' bounds) and should be cheap. The written table is kept, since what is returned reads it.
    """
    mark, part, first = fresh_names(df, "mark", "part", "first")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(mark, F.monotonically_increasing_id())
    dealt = scratch.keep(scratch.put(dealt, label, gather=False)).withColumn(part, F.shiftright(mark, 33))
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    firsts = sizes.select(part, F.coalesce(before, F.lit(0)).alias(first))
    return dealt.join(firsts, part).withColumn(name, F.col(first) + F.col(mark).bitwiseAND(F.lit(_ROWS))).drop(mark, part, first)
