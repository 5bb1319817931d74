"""Row rules, quality reports, exact quantiles and Tukey fences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_open(ts: str, start: str, end: str) -> Column:
    """``start <= ts < end`` against zone-less literals, which Parquet scans prune by."""
    return (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))


def in_range(c: Column, low, high, null_ok: bool = False) -> Column:
    """Closed range; null passes only where ``null_ok``."""
    ok = c.between(F.lit(low), F.lit(high))
    return c.isNull() | ok if null_ok else F.coalesce(ok, F.lit(False))


def all_of(rules: Mapping[str, Column]) -> Column:
    """Conjunction in which null counts as false."""
    out = F.lit(True)
    for rule in rules.values():
        out = out & F.coalesce(rule, F.lit(False))
    return out


def rule_counts(df: DataFrame, rules: Mapping[str, Column], total: str = "n_rows") -> DataFrame:
    """(rule, n, pct) of each rule, counted in one pass; the rules may overlap."""
    counts = df.agg(F.count(F.lit(1)).alias(total), *[F.count_if(F.coalesce(r, F.lit(False))).alias(f"r{i}") for i, r in enumerate(rules.values())])
    names = ", ".join(f"'{name}', r{i}" for i, name in enumerate(rules))
    return counts.selectExpr(total, f"stack({len(rules)}, {names}) as (rule, n)").select("rule", "n", F.when(F.col(total) > 0, F.col("n") * 100.0 / F.col(total)).alias("pct"))


def null_profile(df: DataFrame, columns: Sequence[str], by: Sequence[Column] = ()) -> DataFrame:
    """Per cent of nulls in each column, grouped by ``by``, one row for each column."""
    wide = df.groupBy(*by).agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in columns])
    keys = [c for c in wide.columns if c not in columns]
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return wide.selectExpr(*[f"`{k}`" for k in keys], f"stack({len(columns)}, {pairs}) as (column_name, null_pct)")


def grouped_quantiles(df: DataFrame, column: Column, probs: Sequence[float], by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """(by, n, q): linear-interpolated quantiles of each group's whole column, without gathering a group.

    An approximate pass brackets each quantile of each group; a second counts the rows below all brackets
    at once, a third the values inside them. So only about 4 / ``accuracy`` of a group's rows, as value
    counts, are ever put in order, each quantile of each group in a task of its own. A group of at most
    ``accuracy`` rows is its own bracket.
    """
    names = [f"_g{i}" for i in range(len(by))]
    values = df.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], column.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    eps = 2.0 / accuracy
    asked = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-eps, eps)})
    marks = values.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.percentile_approx("_v", asked, accuracy).alias("_q"))
    few = F.col("_n") <= accuracy
    low = [F.when(few | F.lit(p <= eps), F.col("_lo")).otherwise(F.col("_q")[asked.index(min(1.0, max(0.0, p - eps)))]) for p in probs]
    high = [F.when(few | F.lit(p >= 1 - eps), F.col("_hi")).otherwise(F.col("_q")[asked.index(min(1.0, max(0.0, p + eps)))]) for p in probs]
    spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"), lo.alias("lo"), hi.alias("hi")) for i, (p, lo, hi) in enumerate(zip(probs, low, high, strict=True))])
    marks = marks.select(*names, F.col("_n").alias("n"), spans.alias("spans"))
    m = marks.select(*[F.col(n).alias(f"m{n}") for n in names], "n", "spans")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"m{n}"))
    marked = values.join(m, same) if names else values.withColumn("_m", F.struct(m.select(F.struct("n", "spans")).scalar().alias("m"))).select("_v", "_m.m.n", "_m.m.spans")
    # Rows below a bracket only count; those inside are counted by value.
    each = marked.select(*names, "n", "_v", F.explode(F.filter("spans", lambda s: F.col("_v") <= s["hi"])).alias("s")).select(*names, "n", "s.i", "s.p", F.when(F.col("_v") >= F.col("s.lo"), F.col("_v")).alias("_v"))
    counts = each.groupBy(*names, "n", "i", "p", "_v").agg(F.count(F.lit(1)).alias("c"))
    # Nulls, which stand for what is below, come first.
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy(*names, "i").orderBy("_v"))).where("_v is not null")
    rank = (F.col("n") - 1) * F.col("p")
    found = upto.groupBy(*names, "n", "i").agg(F.first(rank).alias("rank"), F.min(F.when(F.col("upto") > F.floor(rank), F.col("_v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil(rank), F.col("_v"))).alias("b"))
    q = F.col("a") + (F.coalesce("b", "a") - F.col("a")) * (F.col("rank") - F.floor("rank"))
    out = found.groupBy(*names).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, q)).alias(f"q{i}") for i in range(len(probs))])
    return out.select(*[F.col(n).alias(c) for c, n in zip(by, names, strict=True)], "n", F.array(*[f"q{i}" for i in range(len(probs))]).alias("q"))


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], accuracy: int = 10_000) -> list[float | None]:
    """Linear-interpolated quantiles of a whole column without gathering it."""
    row = grouped_quantiles(df, F.col(column), probs, accuracy=accuracy).first()
    return list(row["q"]) if row else [None] * len(probs)


def tukey_bounds(df: DataFrame, column: str, k: float = 1.5, least_iqr: float = 0.0) -> tuple[float | None, float | None]:
    """``q1 - k iqr`` and ``q3 + k iqr``; the spread is at least ``least_iqr``."""
    q1, q3 = exact_quantiles(df, column, [0.25, 0.75])
    if q1 is None:
        return None, None
    iqr = max(q3 - q1, least_iqr)
    return q1 - k * iqr, q3 + k * iqr


def fence(df: DataFrame, column: str, k: float = 1.5, upper_only: bool = False, how: str = "drop") -> DataFrame:
    """Rows outside the fence are dropped, capped at it, or their value is set to 0 or null."""
    lo, hi = tukey_bounds(df, column, k)
    if hi is None:
        return df
    c = F.col(column)
    inside = c <= hi if upper_only else c.between(lo, hi)
    if how == "drop":
        return df.where(inside)
    if how == "cap":
        return df.withColumn(column, F.least(c, F.lit(hi)) if upper_only else F.greatest(F.lit(lo), F.least(c, F.lit(hi))))
    other = {"zero": F.lit(0.0), "null": F.lit(None).cast("double")}[how]
    return df.withColumn(column, F.when(inside, c).otherwise(other))


def cleaning_report(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """(metric, n): input rows, rows that each step is the first to reject, rows kept."""
    first, passed = [], F.lit(True)
    for name, ok in steps.items():
        ok = F.coalesce(ok, F.lit(False))
        first.append((name, F.count_if(passed & ~ok)))
        passed = passed & ok
    made = [("input", F.count(F.lit(1))), *first, ("kept", F.count_if(passed))]
    wide = df.agg(*[c.alias(f"m{i}") for i, (_, c) in enumerate(made)])
    names = ", ".join(f"'{name}', m{i}" for i, (name, _) in enumerate(made))
    return wide.selectExpr(f"stack({len(made)}, {names}) as (metric, n)")
