"""Merkle manifest of a dataset: one root digest, and for each row the siblings that prove it.

A row's leaf is the digest of its fields with their lengths. Leaves of a group ascend by id; each
``ARITY`` consecutive nodes (the last run may be shorter) become the digest of their digests, until one is
left, the group's subroot. The subroots, ordered by group, are the leaves of one more tree whose top is the root.

The nodes of a set of rows form a sparse forest: digests keyed by (tree, level, index). Two forests join by
uniting their keys; whenever all siblings of a run are there, whose number follows from the tree's size, they
resolve into their parent, and a group's finished top becomes a leaf of the tree of groups. This is associative,
and a forest of neighbouring rows holds no more than some nodes a level. So forests of blocks of ``BLOCK`` rows
are reduced ``FAN`` at a time in a tree, each round of which is a written table: a lost executor costs one
round's task, and the driver gets no nodes. Walking the same tree down gives each block the forest of all rows
outside it, which is what its rows' proofs lack; one more pass proves, folds and verifies every row.

Rows are placed by ranges of (group, id), so a group may hold any share of them, and no task holds
more than a block, or ``FAN`` forests.

Defined results: null fields count as ``-``; the null group comes first, a null id first in its group; rows with
one id are ordered by leaf, repeated rows are leaves of their own; an empty table gives an empty result; columns
other than the named ones aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch
from tidegrid.llm.ordering import with_positions

ARITY = 2
#: Rows that are proved together, and forests that are joined together.
BLOCK = 4096
FAN = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree whose leaves are the groups' subroots.
TOP = -1
_NODES = "block long, tree long, size long, level int, idx long, digest string"
_NODE_COLUMNS = ["block", "tree", "size", "level", "idx", "digest"]

#: A node's place: tree, number of the tree's leaves, level (0 for leaves), index on its level.
Place = tuple[int, int, int, int]
Forest = dict[Place, str]


def digest(parts: Iterable[str]) -> str:
    """Lowercase hex digest of the parts' concatenation."""
    return sha256("".join(parts).encode()).hexdigest()


def width(size: int, level: int) -> int:
    """Nodes on a level of a tree of ``size`` leaves."""
    return -(-size // ARITY**level)


def run_of(place: Place) -> list[Place]:
    """The places of a node's run of siblings, itself among them."""
    tree, size, level, idx = place
    first = idx - idx % ARITY
    return [(tree, size, level, i) for i in range(first, min(first + ARITY, width(size, level)))]


def parent_of(place: Place, groups: int) -> Place | None:
    """Where a node goes when its run is complete; the top of a group's tree becomes a leaf, the root has none."""
    tree, size, level, idx = place
    if width(size, level) > 1:
        return tree, size, level + 1, idx // ARITY
    return None if tree == TOP else (TOP, groups, 0, tree)


def join(forest: Forest, more: Iterable[tuple[Place, str]], groups: int, keep: bool = False) -> Forest:
    """Add nodes to ``forest`` and resolve all complete runs; ``keep``: resolved nodes stay."""
    for place, d in more:
        forest[place] = d
        while (up := parent_of(place, groups)) is not None:
            if width(place[1], place[2]) > 1:
                run = run_of(place)
                if any(p not in forest for p in run):
                    break
                d = digest([forest[p] for p in run])
            else:
                run, d = [place], forest[place]
            if not keep:
                for p in run:
                    del forest[p]
            forest[up], place = d, up
    return forest


def _nodes(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, Place, str]]:
    columns = [batch.column(c).to_pylist() for c in _NODE_COLUMNS]
    for block, tree, size, level, idx, d in zip(*columns, strict=True):
        yield block, (tree, size, level, idx), d


def _table(rows: Iterable[tuple[int, Forest]]) -> pa.Table:
    flat = [(block, *place, d) for block, forest in rows for place, d in forest.items()]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    return pa.Table.from_arrays([pa.array([r[i] for r in flat], k) for i, k in enumerate(kinds)], _NODE_COLUMNS)


def leaf_digest(fields: dict[str, Column]) -> Column:
    """Digest of the fields, each ``-`` if null, else its UTF-8 length, a colon and itself."""
    shown = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]
    return F.sha2(F.concat(*shown), 256)


def placed_leaves(scratch: Scratch, leaves: DataFrame) -> DataFrame:
    """``leaves`` (id, grp, leaf, shown) with block, tree (rank of the group), size (of the group) and idx (place in it)."""
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("shown")]
    rows = with_positions(scratch, leaves, order, "place", "merkle-rows")
    grps = scratch.put(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.min("place").alias("first")), "merkle-groups", gather=False)
    ranked = with_positions(scratch, grps, [F.col("first")], "tree", "merkle-ranks").select(F.col("grp").alias("g"), "size", "first", "tree")
    rows = rows.join(ranked, F.col("grp").eqNullSafe(F.col("g"))).select("id", "leaf", "shown", "tree", "size", (F.col("place") - F.col("first")).alias("idx"), F.shiftright("place", BLOCK.bit_length() - 1).alias("block"))
    return scratch.put(rows, "merkle-leaves", gather=False)


def sparse_forests(rows: DataFrame, groups: int) -> DataFrame:
    """The unresolved nodes of each block, as far as each partition sees them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Forest] = {}
        for batch in batches:
            if len(held) > 256:  # blocks that lie in other partitions too are joined later
                yield from _table(held.items()).to_batches()
                held = {}
            for block, place, d in _nodes(batch):
                join(held.setdefault(block, {}), [(place, d)], groups)
        yield from _table(held.items()).to_batches()

    return rows.select("block", "tree", "size", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest")).mapInArrow(run, _NODES)


def reduce_forests(forests: DataFrame, fan: int, groups: int) -> DataFrame:
    """Join the forests of each ``fan`` neighbouring blocks."""

    def run(found: pa.Table) -> pa.Table:
        forest: Forest = {}
        block = None
        for block, place, d in _nodes(found):
            join(forest, [(place, d)], groups)
        return _table([(block // fan, forest)])

    return forests.groupBy(F.floor(F.col("block") / fan)).applyInArrow(run, _NODES)


def outer_forests(forests: DataFrame, outside: DataFrame, fan: int, groups: int) -> DataFrame:
    """For each block the forest of all rows outside it, from what is ``outside`` its parent and the parent's other blocks."""

    def run(own: pa.Table, outer: pa.Table) -> pa.Table:
        blocks: dict[int, Forest] = {}
        for block, place, d in _nodes(own):
            blocks.setdefault(block, {})[place] = d
        names = sorted(blocks)
        after = [{place: d for _, place, d in _nodes(outer)}]
        for name in names[:0:-1]:
            after.append(join(dict(after[-1]), blocks[name].items(), groups))
        out, before = [], {}
        for name, rest in zip(names, reversed(after), strict=True):
            out.append((name, join(dict(before), rest.items(), groups)))
            before = join(before, blocks[name].items(), groups)
        return _table(out)

    left = forests.groupBy(F.floor(F.col("block") / fan))
    return left.cogroup(outside.groupBy("block")).applyInArrow(run, _NODES)


_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(groups: int, proofs: bool):
    def run(rows: pa.Table, outer: pa.Table) -> pa.Table:
        ids, leaves, shown, trees, sizes, idxs = (rows.column(c).to_pylist() for c in ("id", "leaf", "shown", "tree", "size", "idx"))
        starts = [(t, n, 0, i) for t, n, i in zip(trees, sizes, idxs, strict=True)]
        forest = join({}, [*((place, d) for _, place, d in _nodes(outer)), *zip(starts, leaves, strict=True)], groups, keep=True)
        runs: dict[Place, tuple[list[str], list[str], Place | None]] = {}
        out: list[list] = [[] for _ in range(8)]
        for doc_id, leaf, fold, place in zip(ids, leaves, shown, starts, strict=True):
            siblings: list[str] = []
            subroot = root = leaf
            at: Place | None = place
            while at is not None:
                if at not in runs:
                    inner = width(at[1], at[2]) > 1
                    run = run_of(at) if inner else [at]
                    runs[at] = [forest[p] for p in run if p < at], [forest[p] for p in run if p > at], parent_of(at, groups)
                before, after, up = runs[at]
                if width(at[1], at[2]) > 1:
                    siblings += before + after
                    fold = digest([*before, fold, *after])
                elif at[0] != TOP:
                    subroot = forest[at]
                root = forest[at]
                at = up
            for column, value in zip(out, (doc_id, leaf, subroot, root, digest(siblings), fold, fold == root, siblings if proofs else None), strict=True):
                column.append(value)
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.list_(pa.string())]
        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
        shown_columns = 8 if proofs else 7
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)][:shown_columns], names[:shown_columns])

    return run


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, shown: dict[str, Column] | None = None, proofs: bool = False
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, leaf, subroot, root, proof_sha256 (of all siblings, left to right, up to the root), folded_root, verified; with ``proofs`` also proof, those siblings.

    ``shown``: fields as a reader of the manifest finds them, by name, over the columns of ``docs``; ``folded_root`` is
    the root that these fields and the row's siblings give, ``verified`` whether it is the dataset's.
    """
    spark = docs.sparkSession
    own = {c: F.col(c) for c in fields}
    found = leaf_digest(own | (shown or {})) if shown else F.col("leaf")
    leaves = docs.withColumn("leaf", leaf_digest(own)).select(F.col(id_col).cast("long").alias("id"), F.col(group_col).alias("grp"), "leaf", found.alias("shown"))
    with Scratch(spark) as scratch:
        rows = scratch.keep(placed_leaves(scratch, scratch.put(leaves, "merkle-digests", gather=False)))
        groups, last = rows.agg(F.max("tree") + 1, F.max("block")).first()
        levels = [scratch.put(sparse_forests(rows, groups or 0), "merkle-forest", gather=False)]
        blocks = (last or 0) + 1
        # The first round also joins what several partitions found of one block.
        levels[0] = scratch.put(reduce_forests(levels[0], 1, groups or 0), "merkle-forest", gather=False)
        while blocks > FAN:
            levels.append(scratch.put(reduce_forests(levels[-1], FAN, groups), "merkle-forest", gather=False))
            blocks = -(-blocks // FAN)
        outside = levels[-1].where(F.lit(False))
        for forests in reversed(levels):
            outside = scratch.put(outer_forests(forests, outside, FAN, groups or 0), "merkle-outside", gather=False)
        outside = scratch.keep(outside)
        return rows.groupBy("block").cogroup(outside.groupBy("block")).applyInArrow(_prove(groups or 0, proofs), _PROVED + ", proof array<string>" * proofs)
