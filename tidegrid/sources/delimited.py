"""CSV files whose columns' types are inferred together, without a value turning null unseen.

All values are read as text first. One aggregate counts, for each column, how many values each type would take, and the
column gets the narrowest type that takes all of them: boolean, bigint, double, date, timestamp without zone, or text. Files
whose headers differ are read by their own header and united by name, so a file with whole numbers and one with decimals
agree on double, and columns may stand in any order or lack.

Defined results: empty fields are null and fit every type; a column without values is text; numbers with leading zeros, and whole
numbers beyond 18 digits, are text, as a number would change them; names that differ in case only are one column, as the first file spells it;
a file without a header line has no rows; the same file twice gives its rows twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types from the narrowest on, with what a value must look like for its cast to keep it.
_TYPES: list[tuple[str, str]] = [
    ("boolean", r"^(?i:true|false)$"),
    ("bigint", r"^[+-]?(0|[1-9][0-9]{0,17})$"),
    ("double", r"^[+-]?((0|[1-9][0-9]{0,14})(\.[0-9]*)?|\.[0-9]+|(0|[1-9])(\.[0-9]+)?[eE][+-]?[0-9]+)$"),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("timestamp_ntz", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$"),
]


def _takes(value: Column, kind: str, pattern: str) -> Column:
    return value.rlike(pattern) & value.try_cast(kind).isNotNull()


def read_text_columns(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> DataFrame:
    """All columns of all files as text, united by name."""
    headers: dict[str, list[str]] = {}
    for path in paths:
        first = spark.read.text(path).limit(1).collect()
        if first and first[0][0]:
            headers.setdefault(first[0][0], []).append(path)
    out = None
    for own in headers.values():
        part = spark.read.option("header", True).option("sep", sep).option("multiLine", False).csv(own, inferSchema=False)
        # A value that is quoted and empty is as null as one that isn't there.
        part = part.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in part.columns])
        if out is not None:
            known = {c.lower(): c for c in out.columns}
            part = part.select(*[F.col(f"`{c}`").alias(known.get(c.lower(), c)) for c in part.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no file has a header")
    return out


def inferred_types(texts: DataFrame) -> dict[str, str]:
    """The narrowest type of each column that takes all of its values, by one aggregate over all rows."""
    counts = [F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(texts.columns)]
    counts += [F.count_if(_takes(F.col(f"`{c}`"), kind, pattern)).alias(f"n{i}_{kind}") for i, c in enumerate(texts.columns) for kind, pattern in _TYPES]
    found = texts.agg(*counts).first()
    return {c: next((kind for kind, _ in _TYPES if found[f"n{i}"] and found[f"n{i}_{kind}"] == found[f"n{i}"]), "string") for i, c in enumerate(texts.columns)}


def read_inferred(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> DataFrame:
    """The files' rows, each column of one inferred type."""
    texts = read_text_columns(spark, paths, sep)
    kinds = inferred_types(texts)
    return texts.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in kinds.items()])
