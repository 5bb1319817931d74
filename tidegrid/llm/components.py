"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch

MAX_ROUNDS = 60


def _star(links: DataFrame, label: str, large: bool, scratch: Scratch) -> DataFrame:
    """Links (u, v) with u > v; each node's larger (or smaller) neighbours move to the smallest one."""
    if large:
        sides = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.put(sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), label)
        moved = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = scratch.put(links.groupBy("u").agg(F.min("v").alias("m")), label)
        moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _is_stars(links: DataFrame) -> bool:
    """Whether every node that has a smaller one has only that one, which has none itself."""
    facts = links.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("distinct")).first()
    if facts["n"] != facts["distinct"]:
        return False
    return links.select(F.col("v").alias("u")).distinct().join(links.select("u"), "u", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component is the smallest node reachable.

    A hub is never gathered in one task: the smallest neighbour is a map-side aggregate, and the join
    that hands it on reads two exchanges that adaptive execution can split. Rounds grow with the
    logarithm of the longest path.
    """
    canon = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    with Scratch(links.sparkSession) as scratch:
        now = scratch.put(canon, "links")
        for _ in range(MAX_ROUNDS):
            if _is_stars(now):
                break
            large = scratch.put(_star(now, "large", True, scratch), "large-star")
            scratch.drop(now)
            now = scratch.put(_star(large, "small", False, scratch), "links")
        else:
            raise RuntimeError(f"links haven't settled in {MAX_ROUNDS} rounds")
        found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        return scratch.keep(scratch.put(found, "components"))
