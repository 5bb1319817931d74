"""MinHash near-dedup with bottom-k sketches of one hash function.

1. Each text becomes its set of distinct five-word shingles, hashed to 63 bits. Texts with equal sets form
   a class; the row with the smallest doc_id stands for it. Its sketch is the ``K`` smallest values.
2. Inverted lists of the retained values generate overlaps. Lists of one member go first: a class of which
   fewer than ``least(n)`` values are in lists of two or more is alone and goes with its postings. Of the
   others, values are taken from the rarest on, by exact counts; ``left`` is how many a class still has
   from a value on, and a class is listed under a value only while that is ``least(n)`` or more. Two
   linked classes meet under the rarest value they share, and both have at least ``needed(n, m)`` left
   there. So a passage that a third of all texts share lists a text only if the text is little else.
3. A list's leading member is paired with each other member that can be linked to it. Pairs that the union
   sketch puts clearly below the threshold are dropped, the rest is verified on full sets; links make
   components. So a group of m copies costs m - 1 pairs a list.
4. Lists that still hold two components or more may hide links between them. Their members are listed anew
   by full sets, where all bounds are exact. A leader of each list's largest component is paired with the
   members of the others, as long as this finds links; then the pairs that are left between other members
   and the largest component, or each other, are verified. So no link is lost to a cap, and members of one
   component are never paired with each other.
5. A document's component is its class's.

The chance that a pair of similarity 0.75 or more isn't listed, or dropped by its union sketch, is that of
a deviation of ``Z`` standard deviations, about 3e-7 at the threshold itself and less above; pairs of sets of
up to ``K`` shingles are handled exactly. Verified links are exact.

Defined results: null or wordless text has an empty set, is linked with nothing and is its own component;
rows repeated with one doc_id are one document; an empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch, chunks, fresh_names, long_lists, texts, tidied, utf8
from tidegrid.llm.components import components
from tidegrid.llm.shingles import shingle_sets

#: Values in a sketch.
K = 128
#: Per cent of the union that a link needs.
PERCENT = 75
#: Standard deviations that an estimate may lie below.
Z = 5.0
#: Rounds of leading members before pairs are taken; fewer where a round finds no link.
LEADS = 4


def least_overlap(union: int) -> float:
    """Least number of the union sketch's ``union`` values in both sets, if the sets are linked."""
    j = PERCENT / 100
    return j * union - Z * math.sqrt(union * j * (1 - j))


def least_whole(n: Column) -> Column:
    """Least number of values that a set of ``n`` shares with a linked set."""
    return F.ceil(F.lit(PERCENT) * n / 100)


def least(n: Column) -> Column:
    """Least number of values that the sketch of a set of ``n`` shares with that of a linked set."""
    sampled = F.lit(math.ceil(least_overlap(K)))
    # A set that is whole in its sketch may be linked to another such set, or to one whose sketch is a sample.
    return F.when(n > K, sampled).otherwise(F.least(least_whole(n), F.greatest(sampled, F.lit(0)))).cast("long")


def needed(n: Column, m: Column) -> Column:
    """Least number of values that the sketches of linked sets of ``n`` and ``m`` values share.

    A link needs 75/175 of both sizes together in common. Where both sketches are whole that is exact; else
    each of the larger set's ``K`` values is shared with that number's share of the larger size, less ``Z``
    deviations and three values for where the sketches end.
    """
    common = F.lit(PERCENT) * (n + m)
    whole = needed_whole(n, m)
    q = common / ((100 + PERCENT) * F.greatest(n, m))
    part = F.greatest(K * q - Z * F.sqrt(K * q * (1 - q)) - 3, F.lit(least_overlap(K)))
    return F.when(F.greatest(n, m) <= K, whole.cast("double")).otherwise(part)


def needed_whole(n: Column, m: Column) -> Column:
    """Least number of values that linked sets of ``n`` and ``m`` values share."""
    return F.ceil(F.lit(PERCENT) * (n + m) / (100 + PERCENT))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = utf8(texts(batch.column(1)))
        for i, j in chunks(offs):
            sets = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    long_lists([s[:K] for s in sets]),
                ],
                ["doc_id", "n_shingles", "class", "sketch"],
            )


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = utf8(texts(batch.column(1)))
        for i, j in chunks(offs):
            sets = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), long_lists(sets)], ["doc_id", "class", "shingles"])


def _listed(sets: DataFrame, column: str, enough, scratch: Scratch) -> DataFrame:
    """Postings (value, rep, n, left) of ``sets`` (rep, n, ``column``) that a link may need, by exact counts of values."""
    values = sets.select("rep", "n", F.explode(column).alias("value"))
    shared = scratch.put(values.groupBy("value").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-shared")
    # From the most common on, so that a value's place is the number of values from it on.
    place = Window.partitionBy("rep").orderBy(F.desc("size"), F.desc("value"))
    placed = values.join(shared, "value").withColumn("left", F.row_number().over(place).cast("long"))
    listed = scratch.put(placed.where(F.col("left") >= enough(F.col("n"))).select("value", "rep", "n", "left"), "near-listed")
    scratch.drop(shared)
    return listed


def _whole_sets(known: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, n, shingles) of the full sets of ``known`` (rep, class)."""
    ids = known.select(F.col("rep").alias("doc_id"), F.col("class").alias("own"))
    whole = docs.join(ids.select("doc_id"), "doc_id", "left_semi").mapInArrow(tidied(_whole), "doc_id long, class binary, shingles array<long>")
    # A repeated id may also stand for another text; only the set of the class counts, and once.
    whole = whole.withColumnRenamed("class", "own").join(ids, ["doc_id", "own"], "left_semi")
    return whole.dropDuplicates(["doc_id", "own"]).select(F.col("doc_id").alias("rep"), F.size("shingles").cast("long").alias("n"), "shingles")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the union of their sketches doesn't put below the threshold."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    union = F.array_union("sa", "sb")
    # Where both sketches are whole sets, so is their union's; then the estimate is exact.
    whole = (F.col("na") <= K) & (F.col("nb") <= K)
    both = F.when(whole, F.size(F.array_intersect("sa", "sb"))).otherwise(F.size(F.array_intersect(F.array_intersect("sa", "sb"), "u")))
    need = F.when(whole, F.size(union) * PERCENT / 100).otherwise(F.size("u") * PERCENT / 100 - Z * F.sqrt(F.size("u") * (PERCENT * (100 - PERCENT) / 10_000)))
    return pairs.join(side("a"), "a").join(side("b"), "b").withColumn("u", F.slice(F.array_sort(union), 1, K)).where(both >= need).select("a", "b")


def _linked(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough; a repeated row only makes a link twice."""
    left = whole.select(F.col("rep").alias("a"), F.col("shingles").alias("ha"))
    right = whole.select(F.col("rep").alias("b"), F.col("shingles").alias("hb"))
    inter = F.size(F.array_intersect("ha", "hb"))
    linked = 100 * inter.cast("long") >= PERCENT * (F.size("ha") + F.size("hb") - inter).cast("long")
    return pairs.join(left, "a").join(right, "b").where(linked).select("a", "b")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _can_link(n: Column, m: Column, x: Column, y: Column, need) -> Column:
    """Whether sets of ``n`` and ``m`` that meet with ``x`` and ``y`` values left can be linked."""
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (F.least(x, y) >= need(n, m))


def _parted(listed: DataFrame, parts: DataFrame) -> DataFrame:
    """Postings with the component that their member is in by now."""
    return listed.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(*listed.columns, F.coalesce("component", "rep").alias("part"))


def _open_rows(parted: DataFrame, scratch: Scratch) -> DataFrame:
    """Postings of lists that hold two components or more, with the one that has most members there as ``main``."""
    sizes = parted.groupBy("value", "part").agg(F.count(F.lit(1)).alias("members"))
    lists = sizes.groupBy("value").agg(F.max(F.struct("members", "part")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    lists = scratch.put(lists.select("value", F.col("m.part").alias("main")), "near-mixed")
    rows = scratch.put(parted.join(lists, "value"), "near-open")
    scratch.drop(lists)
    return rows


def _lead_pairs(rows: DataFrame, need, scratch: Scratch) -> DataFrame:
    """Pairs of each list's leading member with the members of other components that it can be linked to.

    The member with the most left leads: it holds least of its own, so most are like it. Rows with a ``main``
    have their leader from it.
    """
    heads = rows.where("part = main") if "main" in rows.columns else rows
    lead = F.max(F.struct("left", (-F.col("rep")).alias("order"), "rep", "n", *[c for c in ("part",) if c in rows.columns])).alias("l")
    lists = scratch.put(heads.groupBy("value").agg(lead).select("value", F.col("l.rep").alias("lead"), F.col("l.n").alias("lead_n"), F.col("l.left").alias("lead_left")), "near-leads")
    others = rows.where("part <> main") if "main" in rows.columns else rows
    pairs = others.join(lists, "value").where((F.col("rep") != F.col("lead")) & _can_link(F.col("n"), F.col("lead_n"), F.col("left"), F.col("lead_left"), need))
    pairs = scratch.put(pairs.select(*_ordered("rep", "lead")).distinct(), "near-pairs")
    scratch.drop(lists)
    return pairs


def _links_left(listed: DataFrame, parts: DataFrame, whole: DataFrame, scratch: Scratch) -> DataFrame:
    """Components once every pair that ``listed`` allows between two of ``parts`` is verified."""
    as_links = lambda p: p.select(F.col("node").alias("a"), F.col("component").alias("b"))
    rows, tested = _open_rows(_parted(listed, parts), scratch), None
    for _ in range(LEADS):
        pairs = _lead_pairs(rows, needed_whole, scratch)
        if tested is not None:
            pairs = scratch.put(pairs.join(tested, ["a", "b"], "left_anti"), "near-fresh")
        tested = pairs if tested is None else scratch.put(pairs.unionByName(tested), "near-tested")
        links = scratch.put(_linked(pairs, whole), "near-links")
        if links.isEmpty():
            break
        parts = components(as_links(parts).unionByName(links))
        scratch.drop(rows)
        rows = _open_rows(_parted(listed, parts), scratch)
    side = lambda i, name, keep: rows.where(keep).select(F.col("value"), F.col("rep").alias(name), *[F.col(c).alias(f"{c}{i}") for c in ("n", "left", "part", "main")])
    # Either side of a pair outside the main component, so that its members never meet each other.
    x, y = side(1, "x", "part <> main"), side(2, "y", "true")
    apart = (F.col("part1") != F.col("part2")) & ((F.col("part2") == F.col("main2")) | (F.col("x") < F.col("y")))
    met = x.join(y, (x["value"] == y["value"]) & apart & _can_link(F.col("n1"), F.col("n2"), F.col("left1"), F.col("left2"), needed_whole))
    pairs = scratch.put(met.select(*_ordered("x", "y")).distinct().join(tested, ["a", "b"], "left_anti"), "near-rest")
    scratch.drop(rows)
    return components(as_links(parts).unionByName(_linked(pairs, whole)))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        sketched = scratch.put(docs.mapInArrow(tidied(_sketch), "doc_id long, n_shingles long, class binary, sketch array<long>"), "near-sketches")
        members = sketched.where("n_shingles > 0 and doc_id is not null")
        first = scratch.put(members.groupBy("class").agg(F.min("doc_id").alias("rep")), "near-first")
        classes = members.join(first.select(F.col("class").alias("c"), "rep"), (F.col("class") == F.col("c")) & (F.col("doc_id") == F.col("rep")), "left_semi").dropDuplicates(["class", "doc_id"])
        classes = scratch.put(classes.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "class", "sketch"), "near-classes")
        rows = scratch.put(sketched.select("doc_id", "n_shingles", "class"), "near-rows")
        scratch.drop(sketched)

        listed = _listed(classes, "sketch", least, scratch)
        near = scratch.put(classes.join(listed.select("rep").distinct(), "rep", "left_semi"), "near-involved")
        scratch.drop(classes)
        whole = scratch.put(_whole_sets(near, docs), "near-whole")
        stars = _lead_pairs(listed, needed, scratch)
        likely = scratch.put(_likely(stars, near), "near-likely")
        parts = components(_linked(likely, whole))
        scratch.drop(near, likely)

        # Lists that hold more than one component: their members anew, by their full sets.
        again = scratch.put(_open_rows(_parted(listed, parts), scratch).select("rep").distinct(), "near-again")
        scratch.drop(listed)
        again = _listed(whole.join(again, "rep", "left_semi"), "shingles", least_whole, scratch)
        final = _links_left(again, parts, whole, scratch)

        named = first.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("class_component"))
        named = scratch.keep(scratch.put(named, "near-named"))
        rows = scratch.keep(rows).join(named, "class", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("class_component", "doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns."""
    (name,) = fresh_names(docs, "kept")
    kept = near_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(name))
    return docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(name)), "left_semi")
