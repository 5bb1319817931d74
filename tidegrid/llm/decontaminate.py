"""Benchmark decontamination by the q-gram lemma.

Texts and items are lower-cased, runs of white space count as one space. An item of ``m`` characters
occurs with at most ``e`` edits only where ``m + 1 - q (e + 1)`` of its q-grams lie on ``e + 1``
neighbouring diagonals. Shared q-grams are counted in bands of ``2 (e + 1)`` diagonals that overlap by half,
bands that meet the count are retained, and a banded semi-global alignment confirms each, many at a time.
``e`` is a tenth of the characters, whatever the length. ``q`` is ``Q``, or for a short item the largest that
leaves the lemma one q-gram to ask for (``m // (e + 1)``, 5 or more), so items have an index for each q.
An item whose tenth is no edit occurs only as it is, between characters that are no letters or digits;
it is found by hashes of its whole length.

The item side is a stated query set. It is read in blocks of at most ``BLOCK_CHARS`` characters, each sent
to all tasks at that bounded size and held against all texts. What one block finds, or leaves, is written
before the next is sent, so a larger benchmark takes more passes and not more memory. Items that share
long passages share q-grams: shared q-grams are expanded in slices of at most ``SLICE_HITS``, so that what is
held doesn't grow with their number.

Defined results: null and empty texts match nothing; a null item or one without characters isn't searched;
of several occurrences of one item in a text the one with the fewest edits, then the first, is reported;
items with equal text are searched once and each reported;
repeated rows are each judged; empty tables give no matches (and keep all texts).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import materialize, texts, tidied
from tidegrid.llm.toxicity import lowered

Q = 8
ERROR_RATE = 0.1
BLOCK_CHARS = 1_000_000
CHUNK_CHARS = 1_000_000
#: Shared q-grams, or cells of alignments, that are held at once.
SLICE_HITS = 4_000_000
SLICE_CELLS = 1_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SPAN, _ORIGIN = 1 << 40, 1_000_000_000


def edit_budget(m: int) -> int:
    """Edits that an item of ``m`` characters may have."""
    return int(m * ERROR_RATE)


def gram_size(m: int) -> int:
    """Characters of an item's q-grams, 0 where it has no edits and needs none."""
    e = edit_budget(m)
    return min(Q, m // (e + 1)) if e else 0


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q-gram that begins at each position; doubled from 1 to 2, 4 and 8 characters."""
    if q != Q:
        h = window_hashes(codes, q)
    elif len(codes) < Q:
        return np.zeros(0, np.uint64)
    else:
        h, mul = codes.astype(np.uint64) + np.uint64(1), int(_MUL)
        step = 1
        while step < Q:
            h = h[:-step] * np.uint64(mul) + h[step:]
            mul = mul * mul & (2**64 - 1)
            step *= 2
    h ^= h >> np.uint64(32)
    h *= _MUL
    return h


@cache
def _spaces() -> np.ndarray:
    return np.array([chr(c).isspace() for c in range(1 << 16)], bool)


def normal(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes with every run of white space as one space, and where each was."""
    space = _spaces()[np.minimum(codes, 0xFFFF)]
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = np.flatnonzero(keep)
    return np.where(space, np.uint32(32), codes)[at], at


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` characters that begin at each position."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for k in range(size):
        acc = acc * _MUL + codes[k : k + n].astype(np.uint64) + np.uint64(1)
    return acc


@cache
def _word_characters() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(1 << 16)], bool)


@dataclass
class GramIndex:
    """q-grams of the items of one ``q``: sorted hashes, and the (item, offset) pairs of each."""

    q: int
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    shift: int
    present: np.ndarray


@dataclass
class ItemIndex:
    """The different texts of a block of items, with the ids of each; q-grams by size, items without edits by length."""

    names: list[list[int]]
    codes: list[np.ndarray]
    lengths: np.ndarray
    budget: np.ndarray
    sizes: np.ndarray
    grams: list[GramIndex]
    short: list[tuple[int, np.ndarray, np.ndarray]]

    @property
    def ids(self) -> list[int]:
        return [i for names in self.names for i in names]


def _gram_index(codes: list[np.ndarray], of: np.ndarray, q: int) -> GramIndex:
    hashes = [gram_hashes(codes[k], q) for k in of.tolist()]
    all_h = np.concatenate(hashes)
    item = np.repeat(of, [len(h) for h in hashes])
    offset = np.concatenate([np.arange(len(h)) for h in hashes])
    order = np.argsort(all_h, kind="stable")
    grams, first = np.unique(all_h[order], return_index=True)
    bits = min(24, max(16, int(len(grams) * 16).bit_length()))
    present = np.zeros(1 << bits, bool)
    present[(grams >> np.uint64(64 - bits)).astype(np.int64)] = True
    return GramIndex(q, grams, np.append(first, len(all_h)), item[order], offset[order], 64 - bits, present)


def build_index(items: list[tuple[int, str]]) -> ItemIndex:
    names: dict[bytes, list[int]] = {}
    codes: list[np.ndarray] = []
    for i, t in sorted(set(items)):
        c = normal(codes_of(lowered(t.strip())))[0]
        if not len(c):
            continue
        own = names.setdefault(c.tobytes(), [])
        if not own:
            codes.append(c)
        if i not in own[-1:]:  # ids ascend, so one that is there is last
            own.append(i)
    lengths = np.array([len(c) for c in codes], np.int64)
    sizes = np.array([gram_size(m) for m in lengths.tolist()], np.int64)
    grams = [_gram_index(codes, np.flatnonzero(sizes == q), q) for q in np.unique(sizes[sizes > 0]).tolist()]
    short = []
    for size in np.unique(lengths[sizes == 0]).tolist():
        of = np.flatnonzero(lengths == size)
        h = np.array([window_hashes(codes[k], size)[0] for k in of.tolist()], np.uint64)
        by = np.argsort(h, kind="stable")
        short.append((size, h[by], of[by]))
    return ItemIndex(list(names.values()), codes, lengths, np.array([edit_budget(m) for m in lengths.tolist()], np.int64), sizes, grams, short)


def align_all(items: list[np.ndarray], regions: list[np.ndarray], lows: list[int], widths: list[int], budgets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each whole item against any part of its region, and where that part ends.

    Diagonals are ``low`` to ``low + width - 1`` of each; a pair is given up once all of them are over its budget.
    """
    m, n = (np.array([len(x) for x in side], np.int64) for side in (items, regions))
    low, width, budget = (np.array(x, np.int64) for x in (lows, widths, budgets))
    wide, count = int(width.max()), len(items)
    text, item = np.zeros((count, int(n.max()) + 1), np.uint32), np.zeros((count, int(m.max())), np.uint32)
    for k, (x, y) in enumerate(zip(items, regions, strict=True)):
        item[k, : len(x)], text[k, : len(y)] = x, y
    edits, ends = np.full(count, 1 << 30, np.int64), np.zeros(count, np.int64)
    place, far = np.arange(wide), 1 << 30
    x = low[:, None] + place  # characters of the text used on each diagonal
    row = np.where((x >= 0) & (x <= n[:, None]) & (place < width[:, None]), 0, far)
    at = np.arange(count)
    for j in range(1, int(m.max()) + 1):
        x = x + 1
        used = (x >= 0) & (x <= n[:, None]) & (place < width[:, None])
        same = np.take_along_axis(text, np.clip(x - 1, 0, n[:, None]), 1) == item[:, j - 1 : j]
        best = np.where(used & (x >= 1), row + ~same, far)
        best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + 1)  # an item character left out
        best = np.where(used, best, far)
        row = np.minimum.accumulate(best - place, axis=1) + place  # text characters put in
        row = np.where(used, row, far)
        done = m == j
        if done.any():
            k = row[done].argmin(axis=1)
            edits[at[done]] = row[done, k]
            ends[at[done]] = j + low[done] + k
        if done.any() or j % 16 == 0:
            go = ~done & (row.min(axis=1) <= budget)
            if not go.any():
                break
            if not go.all():
                at, x, row, m, n, low, width, budget, text, item = (a[go] for a in (at, x, row, m, n, low, width, budget, text, item))
    return edits, ends


def align(item: np.ndarray, text: np.ndarray, lo: int, width: int) -> tuple[int, int]:
    """``align_all`` of one pair that is never given up."""
    edits, ends = align_all([item], [text], [lo], [width], [1 << 29])
    return int(edits[0]), int(ends[0])


def _find(code: np.ndarray, text: np.ndarray) -> int:
    """Where ``code`` first occurs in ``text`` as it is, or -1."""
    want, have = code.astype(np.uint32).tobytes(), text.astype(np.uint32).tobytes()
    at = have.find(want)
    while at % 4 and at >= 0:
        at = have.find(want, at + 1)
    return at // 4 if at >= 0 else -1


def _bands(index: ItemIndex, own: GramIndex, flat: np.ndarray) -> np.ndarray:
    """Keys (item, band) of the items of ``own`` whose shared q-grams meet the lemma's count, in order."""
    h = gram_hashes(flat, own.q)
    some = np.flatnonzero(own.present[(h >> np.uint64(own.shift)).astype(np.int64)])
    g = np.minimum(np.searchsorted(own.grams, h[some]), len(own.grams) - 1)
    hit = own.grams[g] == h[some]
    some, g = some[hit], g[hit]
    n_each = own.first[g + 1] - own.first[g]
    need = index.lengths + 1 - own.q * (index.budget + 1)
    upto = np.cumsum(n_each)
    kept, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + SLICE_HITS, side="right")))
        keys, n = _counted(index, own, some[i:j], g[i:j], n_each[i:j], need, whole=i == 0 and j == len(some))
        # A band that a slice cuts through has its parts' counts added up.
        both = np.concatenate([kept, keys])
        kept, inverse = np.unique(both, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([counts, n]), len(kept)).astype(np.int64)
        i = j
    return kept[counts >= need[kept >> 40]] if len(kept) else kept


def _counted(index: ItemIndex, own: GramIndex, some: np.ndarray, g: np.ndarray, n_each: np.ndarray, need: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys (item, band) of a slice of shared q-grams, and how many different q-grams each has in it."""
    total = int(n_each.sum())
    entry = np.repeat(own.first[g] - (np.cumsum(n_each) - n_each), n_each) + np.arange(total)
    item = own.item[entry]
    band = (np.repeat(some, n_each) - own.offset[entry] + _ORIGIN) // (index.budget + 1)[item]
    keys = np.concatenate([item * _SPAN + band, item * _SPAN + band - 1])
    offsets = np.concatenate([own.offset[entry]] * 2)
    if whole:  # a hashed count first: it is never below the true one, and nearly all shared q-grams end here
        size = 1 << int(4 * len(keys)).bit_length()
        slot = ((keys.view(np.uint64) * _MUL) >> np.uint64(65 - size.bit_length())).astype(np.int64)
        many = np.bincount(slot, minlength=size)[slot] >= need[keys >> 40]
        keys, offsets = keys[many], offsets[many]
    # Then the exact count; the q-grams of an item that an occurrence keeps differ in their place in it.
    order = np.lexsort((offsets, keys))
    keys, offsets = keys[order], offsets[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (offsets[1:] != offsets[:-1])
    return np.unique(keys[fresh], return_counts=True)


def _short_matches(index: ItemIndex, flat: np.ndarray, begins: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    """First occurrence of each item without edits in each row, between word boundaries."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    word = _word_characters()[np.minimum(flat, 0xFFFF)]
    edge = np.ones(len(flat) + 1, bool)
    edge[1:-1] = ~(word[1:] & word[:-1])
    for size, hashes, of in index.short:
        h = window_hashes(flat, size)
        first, last = np.searchsorted(hashes, h, side="left"), np.searchsorted(hashes, h, side="right")
        at = np.flatnonzero((last > first) & edge[: len(h)] & edge[size : size + len(h)])
        for p in at.tolist():
            r = int(np.searchsorted(begins, p, side="right")) - 1
            for k in of[first[p] : last[p]].tolist():
                if (r, k) not in found and np.array_equal(index.codes[k], flat[p : p + size]):
                    found[r, k] = (p, p + size, 0)
    return found


def matches(index: ItemIndex, rows: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(row, item, begin, end, edits) of the best occurrence of each item in each row."""
    if not index.codes or not rows:
        return []
    lows = [lowered(t) for t in rows]
    begins = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in lows], out=begins[1:])
    flat, at = normal(codes_of("\0".join(lows) + "\0"))
    begins = np.searchsorted(at, begins)
    found = _short_matches(index, flat, begins) if index.short else {}

    def note(r: int, k: int, got: tuple[int, int, int]) -> None:
        best = found.get((r, k))
        if best is None or (got[2], got[0]) < (best[2], best[0]):
            found[r, k] = got

    doubtful: list[tuple[int, int, int, int, int, int]] = []
    for key in (key for own in index.grams for key in _bands(index, own, flat).tolist()):
        k, b = key >> 40, key & (_SPAN - 1)
        e, m, code = int(index.budget[k]), int(index.lengths[k]), index.codes[k]
        lo = b * (e + 1) - _ORIGIN - e
        width = 2 * (e + 1) + 2 * e
        first_row = max(0, int(np.searchsorted(begins, max(lo, 0), side="right")) - 1)
        last_row = min(len(rows) - 1, int(np.searchsorted(begins, lo + width + m, side="right")) - 1)
        for r in range(first_row, last_row + 1):
            low, high = max(int(begins[r]), lo), min(int(begins[r + 1]) - 1, lo + width + m)
            if high - low < m - e or found.get((r, k), (0, 0, 1))[2] == 0:  # bands come in order, so a later one begins later
                continue
            if (same := _find(code, flat[low:high])) >= 0:
                note(r, k, (low + same, low + same + m, 0))
            else:
                doubtful.append((r, k, low, high, lo - low, width))
    doubtful = [x for x in doubtful if found.get(x[:2], (0, 0, 1))[2]]
    doubtful.sort(key=lambda x: index.lengths[x[1]])
    i = 0
    while i < len(doubtful):
        j, cells = i, 0
        while j < len(doubtful) and (j == i or cells < SLICE_CELLS):
            cells += doubtful[j][5] + doubtful[j][3] - doubtful[j][2] + int(index.lengths[doubtful[j][1]])
            j += 1
        part = doubtful[i:j]
        i = j
        edits, ends = align_all([index.codes[k] for _, k, *_ in part], [flat[low:high] for _, _, low, high, *_ in part], [x[4] for x in part], [x[5] for x in part], [int(index.budget[k]) for _, k, *_ in part])
        for (r, k, low, high, _, _), edit, end in zip(part, edits.tolist(), ends.tolist(), strict=True):
            e = int(index.budget[k])
            if edit > e:
                continue
            _, length = align(index.codes[k][::-1], flat[low:high][:end][::-1], -e, 2 * e + 1)
            note(r, k, (low + end - length, low + end, edit))
    out = []
    origin = at[begins[:-1]]
    for (r, k), (b, e_at, edits) in sorted(found.items()):
        out += [(r, i, int(at[b] - origin[r]), int(at[e_at - 1] + 1 - origin[r]), edits) for i in index.names[k]]
    return sorted(out)


def _row_groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    rows, size, first = [], 0, 0
    for i, t in enumerate(column.to_pylist()):
        if rows and size + len(t) > CHUNK_CHARS:
            yield first, rows
            rows, size = [], 0
        if not rows:
            first = i
        rows.append(t)
        size += len(t)
    if rows:
        yield first, rows


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[tuple[ItemIndex, bool]]:
    """The items in blocks of about ``block_chars`` characters, dealt by a hash of item and text, and whether it is the last."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = -(-size // block_chars)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield build_index([(r["id"], r["text"]) for r in part.toLocalIterator()]), b == blocks - 1


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, begin, end (offsets in the text as it is) and edits of each item found in each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, begin int, end int, edits int"
    out = docs.sparkSession.createDataFrame([], schema)
    for index, last in item_blocks(benchmark, block_chars=block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, group in _row_groups(texts(batch.column(1))):
                    got = matches(sent.value, group)
                    ids = batch.column(0).take(pa.array([first + g[0] for g in got], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array([g[i] for g in got], t) for i, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()), (4, pa.int32()))]], ["doc_id", "item_id", "begin", "end", "edits"])

        found = rows.mapInArrow(tidied(run), schema)
        if not last:
            found = materialize(found, "contaminated")
            sent.destroy()
        out = out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with all their columns."""
    at = docs.columns.index(text_col)
    for index, last in item_blocks(benchmark, block_chars=block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, group in _row_groups(texts(batch.column(at))):
                    keep[[first + g[0] for g in matches(sent.value, group)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidied(run), docs.schema)
        if not last:
            docs = materialize(docs, "uncontaminated")
            sent.destroy()
    return docs
