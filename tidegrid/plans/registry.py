"""Registry of queries over the driver's tables, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


HOUR = 3600

#: Dense hourly panel of events by type, in SQL.
PANEL_SQL = """with c as (select event_type, time_bucket(interval '1 hour', ts) as bin, count(*) as demand from events group by all),
ends as (select min(bin) as lo, max(bin) as hi from c),
g as (select event_type, unnest(generate_series(lo, hi, interval '1 hour')) as bin from (select distinct event_type from events), ends),
d as (select g.event_type, g.bin, coalesce(c.demand, 0)::double as demand from g left join c using (event_type, bin))
"""

#: Trips with two timestamps: order date to ship date.
TRIPS_SQL = """with t as (select o_orderkey, l_linenumber, o_orderdate as pickup, l_shipdate as dropoff, l_extendedprice as fare, l_quantity as distance,
  l_extendedprice * l_discount as tip, l_extendedprice * l_tax as tolls, l_linenumber as passengers, l_returnflag as payment, o_orderpriority as priority,
  (epoch(l_shipdate) - epoch(o_orderdate)) / 60.0 as minutes from lineitem join orders on l_orderkey = o_orderkey)
"""


def panel(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    from tidegrid.operators.panel import bin_counts, densify

    return densify(bin_counts(table(spark, sf_dir, "events"), key, "ts", HOUR), key, HOUR)


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegrid.functions.timebins import minutes_between

    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    price = F.col("l_extendedprice")
    return lines.select(
        "o_orderkey", "l_linenumber", F.col("o_orderdate").alias("pickup"), F.col("l_shipdate").alias("dropoff"), price.alias("fare"), F.col("l_quantity").alias("distance"), (price * F.col("l_discount")).alias("tip"),
        (price * F.col("l_tax")).alias("tolls"), F.col("l_linenumber").alias("passengers"), F.col("l_returnflag").alias("payment"), F.col("o_orderpriority").alias("priority"), minutes_between("o_orderdate", "l_shipdate").alias("minutes"),
    )
