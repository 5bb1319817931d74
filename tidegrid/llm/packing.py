"""Best-fit packing of tokenised documents into sequences of a fixed length.

A document's ids (with an end id) are cut only where there are more than ``SEQUENCE`` of them. Lengths are
counted into a histogram of at most ``SEQUENCE`` classes, and all planning works on that histogram, so its
cost doesn't grow with the corpus:

* patterns of a few lengths that fill a sequence nearly to the end are enumerated;
* non-negative least squares fits how often each pattern repeats to the histogram;
* the counts are rounded down to what the histogram holds, and the residual is packed best-fit, longest
  first, whole classes at a time.

A piece finds its place by its rank among the pieces of its length. Ranks come from each task's own
counts and a running sum over tasks, so a length that a third of all pieces have is never in one task.

Defined results: a null or empty text is a piece of the end id alone; repeated rows are packed each; an
empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import materialize, slices, texts, tidied
from tidegrid.llm.tokens import GROUP_BYTES, worker_tokenizer

SEQUENCE = 4096
#: Tokens that a pattern may leave empty.
SLACK = 2
#: Second and third lengths that are tried for each first one.
PARTNERS = 24
FIT_ROUNDS = 300


@dataclass
class Plan:
    """Pieces of ``length`` and ranks from ``first`` go to sequences from ``sequence`` on, at ``offset``; sorted by length and rank."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted((self.length << 44) + self.first, (length << 44) + rank, side="right") - 1
        return self.sequence[at] + rank - self.first[at], self.offset[at]


def patterns(histogram: np.ndarray, size: int = SEQUENCE) -> np.ndarray:
    """Lengths of each pattern, longest first, padded with 0: one to three that leave ``SLACK`` at most."""
    have = np.flatnonzero(histogram)
    below = np.full(size + 1, 0)  # the largest length there is, up to each
    below[have] = have
    below = np.maximum.accumulate(below)
    found = [np.array([[x, 0, 0] for x in have if x >= size - SLACK], np.int64).reshape(-1, 3)]
    pair = np.stack([have, below[size - have], 0 * have], axis=1)
    found.append(pair[(pair[:, 1] > 0) & (pair[:, 1] <= pair[:, 0])])
    if len(have):
        some = have[np.unique(np.linspace(0, len(have) - 1, min(PARTNERS, len(have))).astype(int))]
        a, b = np.repeat(have, len(some)), np.tile(some, len(have))
        ok = (b <= a) & (a + b < size)
        a, b = a[ok], b[ok]
        c = below[size - a - b]
        three = np.sort(np.stack([a, b, c], axis=1)[c > 0], axis=1)[:, ::-1]
        found.append(three)
    p = np.unique(np.concatenate(found), axis=0)
    return p[p.sum(axis=1) >= size - SLACK]


def fit_counts(p: np.ndarray, histogram: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Repeats x >= 0 of each pattern that minimise |A x - histogram|, by accelerated projected gradient."""
    if not len(p):
        return np.zeros(0)
    target = histogram.astype(float)
    width = len(histogram)
    cells = p.reshape(-1)

    def covered(x: np.ndarray) -> np.ndarray:
        got = np.bincount(cells, np.repeat(x, p.shape[1]), minlength=width)
        got[0] = 0
        return got

    # Largest eigenvalue of A'A, by power iteration.
    v = np.ones(len(p))
    for _ in range(20):
        v = covered(v)[cells].reshape(p.shape).sum(axis=1)
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(p))
    t = 1.0
    for _ in range(rounds):
        miss = covered(y) - target
        miss[0] = 0
        nxt = np.maximum(y - miss[cells].reshape(p.shape).sum(axis=1) / (1.05 * top), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def plan(histogram: np.ndarray, size: int = SEQUENCE) -> Plan:
    """Places for ``histogram[n]`` pieces of each length n."""
    left = histogram.astype(np.int64).copy()
    used = np.zeros(len(left), np.int64)
    rows: list[tuple[int, int, int, int]] = []
    opened = 0
    spare: dict[int, list[list[int]]] = defaultdict(list)  # sequences by what is free: [first, count]
    p = patterns(left, size)
    x = fit_counts(p, left)
    for k in np.argsort(-x, kind="stable").tolist():
        lengths, each = np.unique(p[k][p[k] > 0], return_counts=True)
        n = int(min(np.floor(x[k] + 0.5), (left[lengths] // each).min()))
        if n <= 0:
            continue
        offset = 0
        for length in p[k][p[k] > 0].tolist():
            rows.append((length, int(used[length]), opened, offset))
            used[length] += n
            left[length] -= n
            offset += length
        if offset < size:
            spare[size - offset].append([opened, n])
        opened += n
    free = np.zeros(size + 1, np.int64)
    for r, groups in spare.items():
        free[r] = sum(n for _, n in groups)
    for length in range(size, 0, -1):
        while left[length]:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                r = length + int(fits[0])
                group = spare[r][-1]
                n = min(int(left[length]), group[1])
                first = group[0]
                group[0], group[1] = first + n, group[1] - n
                if not group[1]:
                    spare[r].pop()
                free[r] -= n
            else:
                r = size
                n = -(-int(left[length]) // (size // length))
                first, opened = opened, opened + n
            rows.append((length, int(used[length]), first, size - r))
            used[length] += n
            left[length] -= n
            if r > length:
                spare[r - length].append([first, n])
                free[r - length] += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return Plan(a[:, 0], a[:, 1], a[:, 2], a[:, 3], opened)


def _pieces(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(path, words=True)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for group in slices(batch, 1, GROUP_BYTES):
                ids, counts = tokenizer.encode(texts(group.column(1)).to_pylist())
                ends = np.cumsum(counts)
                out: list[tuple[int, int, int, int, int]] = []
                for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                    own = np.append(ids[end - n : end], np.uint32(end_id))
                    for at in range(0, n + 1, size):
                        piece = own[at : at + size]
                        out.append((i, at // size, at, len(piece), zlib.crc32(piece.astype("<u4", copy=False).tobytes())))
                a = np.array(out, np.int64)
                length = a[:, 3]
                order = np.argsort(length, kind="stable")
                run_start = np.searchsorted(length[order], length[order], side="left")
                rank = np.empty(len(a), np.int64)
                rank[order] = np.arange(len(a)) - run_start
                rank += seen[length]
                seen += np.bincount(length, minlength=size + 1)
                yield pa.RecordBatch.from_arrays(
                    [group.column(0).take(pa.array(a[:, 0])), pa.array(a[:, 1].astype(np.int32)), pa.array(a[:, 2]), pa.array(length), pa.array(a[:, 4]), pa.array(np.full(len(a), part, np.int32)), pa.array(rank)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
                )

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Written first: ranks have to stay what they were if a task runs again.
    pieces = materialize(rows.mapInArrow(tidied(_pieces(tokenizer_path, end_id, size)), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"), "pack-pieces")
    counts = materialize(pieces.groupBy("part", "length").count(), "pack-counts")
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `size` rows
        histogram[r["length"]] = r["n"]
    planned = docs.sparkSession.sparkContext.broadcast(plan(histogram, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")), "pack-bases")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = planned.value.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(tidied(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
