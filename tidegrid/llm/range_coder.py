"""Adaptive context-mixing range coder for token ids.

Each block is coded with a state of its own. Tables of the block hold, for the last id (order 1) and the
last two ids (order 2), the id that followed and how often it did so in a row; adaptive estimates of how
often such a prediction holds are mixed into one interval of the order-2 id, one of the order-1 id and the
rest, which the ids share by their order-0 frequencies. One range-coding step codes an id: hit or rest and
place in the rest are one interval of a total of 2**32.

Blocks don't depend on each other, so numpy codes all blocks of a segment in lockstep, one id of each at
a time. Order-0 frequencies are those of the segment and stand in its header.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids in a block.
BLOCK_IDS = 4096
#: Ids that are coded at a time; a segment is made of whole documents of about so many ids, the last of a part of up to twice as many.
SEGMENT_IDS = 4_000_000
#: No id above this.
MAX_ID = 65_535

_SLOT_BITS = 12
_U = np.uint64
_U16, _U32, _U48 = _U(16), _U(32), _U(48)
#: A range below the first is shifted by 16 bits, below the second by 32.
_TOP, _LOW = _U(1 << 48), _U(1 << 32)
_ZERO, _HALF = np.uint32(0), np.uint32(16)
_SEVEN, _EIGHT, _THREE = np.uint32(7), np.uint32(8), np.uint32(3)
_K1, _K2, _K3, _SLOT_SHIFT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(32 - _SLOT_BITS)
#: What is added to an entry that stays, by its run, after a miss and then after a hit: a run halves or grows by 1.
_NEXT_RUN = np.array([*(run // 2 - run for run in range(8)), *(min(run + 1, 7) - run for run in range(8))], np.int64).astype(np.uint32)
#: Steps whose slots are found at once when all ids are known.
_STEPS = 32


class CorruptBlock(ValueError):
    """A block's ids don't have its checksum."""


def order0(ids: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 65536, at least 1 for each id there is."""
    counts = np.bincount(ids, minlength=MAX_ID + 1).astype(np.int64)
    some = np.flatnonzero(counts)
    freq = np.zeros(MAX_ID + 1, np.int64)
    if not len(some):
        return freq
    free = 65_536 - len(some)
    share = counts[some] * free // counts.sum()
    freq[some] = 1 + share
    freq[some[counts[some].argmax()]] += 65_536 - freq.sum()
    return freq


def pack_order0(freq: np.ndarray) -> bytes:
    some = np.flatnonzero(freq)
    return np.concatenate([some.astype("<u2"), (freq[some] - 1).astype("<u2")]).tobytes()


def unpack_order0(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, "<u2").astype(np.int64)
    freq = np.zeros(MAX_ID + 1, np.int64)
    freq[a[: len(a) // 2]] = a[len(a) // 2 :] + 1
    return freq


class _Model:
    """Predictions of all lanes, order 1 in the first row of each array and order 2 in the second; entries are id * 8 + run."""

    def __init__(self, lanes: int):
        size = 1 << _SLOT_BITS
        self.t, self.a = np.zeros(2 * lanes * size, np.uint32), np.full(2 * lanes * 8, 6000, np.int32)
        self.lanes = np.uint32(lanes)
        self.base = np.add.outer(np.array([0, lanes * size]), np.arange(lanes))
        self.base8 = (np.arange(2 * lanes, dtype=np.int64) * 8).reshape(2, lanes)

    def without_last(self) -> None:
        """Go on without the last lane."""
        self.base, self.base8 = (np.ascontiguousarray(x[:, :-1]) for x in (self.base, self.base8))

    def slots(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Slots of both orders by the last id and the one before it; lanes are the last axis, orders the one before it."""
        h = np.empty((*last.shape[:-1], 2, last.shape[-1]), np.uint32)
        h1, h2 = h[..., 0, :], h[..., 1, :]
        np.multiply(last, _K1, out=h1)
        np.multiply(before, _K2, out=h2)
        h2 ^= h1
        h2 *= _K3
        h >>= _SLOT_SHIFT
        h *= self.lanes
        slot = h.astype(np.int64)
        slot += self.base
        return slot

    def predict(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shares of 65536 that the order-2 id, the order-1 id and the rest get; the entries are in ``e``."""
        self.slot = slot
        self.e = self.t.take(slot, mode="clip")
        self.run = (self.e & _SEVEN).astype(np.int64)
        self.k = self.base8 + self.run
        self.v = self.a.take(self.k, mode="clip")
        f1, f2 = self.v
        other = ((self.e[0] ^ self.e[1]) >= _EIGHT).astype(np.int32)
        h1 = f1 >> 1
        # Where both orders say the same id, their doubts are multiplied and order 1 has no interval of its own.
        both = f2 >> 1
        both *= h1
        both >>= 14
        np.subtract(f1, both, out=both)
        both *= 1 - other
        both += f2
        f2 = np.minimum(np.maximum(both, 32, out=both), 64_000, out=both)
        f1 = 65_536 - f2
        rest = f1.copy()
        f1 >>= 1
        f1 *= h1
        f1 >>= 14
        np.maximum(f1, 32, out=f1)
        f1 *= other
        rest -= f1
        return f2.view(np.uint32), f1.view(np.uint32), rest.view(np.uint32)

    def update(self, hit: np.ndarray, s8: np.ndarray) -> None:
        """``s8``: the id times 8."""
        grown = hit.astype(np.int32)
        grown <<= 16
        grown -= self.v
        grown >>= 5
        grown += self.v
        self.a[self.k] = grown
        # An id whose run was 1 at most makes room for the new one.
        stays = self.run > 1
        stays |= hit
        row = hit.astype(np.int64)
        row <<= 3
        row += self.run
        self.e += _NEXT_RUN.take(row, mode="clip")
        self.t[self.slot] = np.where(stays, self.e, s8)


def _interval(f2: np.ndarray, f1: np.ndarray, rest: np.ndarray, below: np.ndarray, own: np.ndarray, hit2: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each lane's id in a total of 2**32; ``hits``: the lanes whose id one of the orders has said."""
    start = f2 + f1
    start <<= _HALF
    start += rest * below
    size = rest * own
    if len(hits):
        second, f2, f1 = hit2.take(hits), f2.take(hits) << _HALF, f1.take(hits) << _HALF
        start[hits] = np.where(second, _ZERO, f2)
        size[hits] = np.where(second, f2, f1)
    return start.astype(np.uint64), size.astype(np.uint64)


def _lengths(n: int, block: int) -> np.ndarray:
    full, rest = divmod(n, block)
    return np.array([block] * full + [rest] * bool(rest), np.int64)


def _cumulative(freq: np.ndarray) -> np.ndarray:
    return (np.cumsum(freq) - freq).astype(np.uint32)


def _carry(out: np.ndarray, end: np.ndarray) -> None:
    """Add 1 to what stands before ``end``, a place in each of some lanes."""
    while len(end):
        end = end - 1
        word = out.take(end) + np.uint16(1)
        out[end] = word
        end = end[word == 0]


def encode(ids: np.ndarray, freq: np.ndarray, block: int = BLOCK_IDS) -> list[bytes]:
    """A code for each block of ``block`` ids (the last may be shorter)."""
    lengths = _lengths(len(ids), block)
    lanes = len(lengths)
    if not lanes:
        return []
    grid = np.zeros(lanes * block, np.uint16)
    grid[: len(ids)] = ids
    # Two ids of 0 go before each block.
    grid = np.concatenate([np.zeros((2, lanes), np.uint16), grid.reshape(lanes, block).T])
    cum, freq = _cumulative(freq), freq.astype(np.uint32)
    model = _Model(lanes)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    width = 2 * block + 16
    out, begun = np.zeros(lanes * width, np.uint16), np.arange(lanes, dtype=np.int64) * width
    end = begun.copy()
    lows, ends = low, end
    for t in range(block):
        if t in (0, lengths[-1]) or step == _STEPS:
            n = lanes if t < lengths[-1] else lanes - 1
            if not n:
                break
            if t == lengths[-1]:
                model.without_last()
                low, rng, end = low[:n], rng[:n], end[:n]
            known = grid[t : t + 2 + _STEPS, :n].astype(np.uint32)
            slots = model.slots(known[1:-1], known[:-2])
            below, own, known8 = cum.take(known[2:]), freq.take(known[2:]), known[2:] << _THREE
            step = 0
        f2, f1, rest = model.predict(slots[step])
        s8 = known8[step]
        hit = (model.e ^ s8) < _EIGHT
        start, size = _interval(f2, f1, rest, below[step], own[step], hit[1], (hit[0] | hit[1]).nonzero()[0])
        model.update(hit, s8)
        step += 1
        rng >>= _U32
        start *= rng
        low += start
        rng *= size
        carry = (low < start).nonzero()[0]
        _carry(out, end.take(carry))
        for most in (_LOW, _TOP):
            at = (rng < most).nonzero()[0]
            if len(at):
                lo, to = low.take(at), end.take(at)
                out[to] = (lo >> _U48).astype(np.uint16)
                to += 1
                end[at] = to
                lo <<= _U16
                low[at] = lo
                rng[at] = rng.take(at) << _U16
    # A range holds a multiple of 2**48: its first word is all that's needed of it.
    low, end = lows, ends
    last = low + (_TOP - _U(1))
    _carry(out, end[last < low])
    out[end] = (last >> _U48).astype(np.uint16)
    return [out[i:j].astype(">u2").tobytes() for i, j in zip(begun.tolist(), (end + 1).tolist(), strict=True)]


def decode(codes: list[bytes], n_ids: int, freq: np.ndarray, block: int = BLOCK_IDS) -> np.ndarray:
    """The ids of all blocks, one after the other (uint32)."""
    lengths = _lengths(n_ids, block)
    lanes = len(lengths)
    if not lanes:
        return np.zeros(0, np.uint32)
    width = max(map(len, codes)) // 2 + 8
    data = np.zeros((lanes, width), np.uint16)
    for i, c in enumerate(codes):
        data[i, : len(c) // 2] = np.frombuffer(c, ">u2")
    data = data.reshape(-1)
    at_slot = np.repeat(np.arange(MAX_ID + 1, dtype=np.uint32), freq)
    cum, freq = _cumulative(freq), freq.astype(np.uint32)
    model = _Model(lanes)
    rng = np.full(lanes, 2**64 - 1, np.uint64)
    read = np.arange(lanes, dtype=np.int64) * width
    code = np.zeros(lanes, np.uint64)
    for i in range(4):
        code = (code << _U16) | data[read + i]
    read += 4
    grid = np.zeros((block, lanes), np.uint16)
    last, before = np.zeros((2, lanes), np.uint32)
    for t in range(block):
        n = lanes if t < lengths[-1] else lanes - 1
        if not n:
            break
        if t == lengths[-1]:
            model.without_last()
            last, before, code, rng, read = last[:-1], before[:-1], code[:-1], rng[:-1], read[:-1]
        f2, f1, rest = model.predict(model.slots(last, before))
        rng >>= _U32
        second = f2.astype(np.uint64)
        second <<= _U16
        second *= rng
        both = (f2 + f1).astype(np.uint64)
        both <<= _U16
        both *= rng
        hit2 = code < second
        hits = (code < both).nonzero()[0]
        np.subtract(code, both, out=both)
        both //= rng * rest
        s = at_slot.take(both.view(np.int64), mode="clip")
        s8 = s << _THREE
        if len(hits):
            s8[hits] = np.where(hit2.take(hits), model.e[1].take(hits), model.e[0].take(hits)) & ~_SEVEN
            s = s8 >> _THREE
        place = s.astype(np.int64)
        start, size = _interval(f2, f1, rest, cum.take(place), freq.take(place), hit2, hits)
        grid[t, :n] = s
        model.update((model.e ^ s8) < _EIGHT, s8)
        last, before = s, last
        start *= rng
        code -= start
        rng *= size
        for most in (_LOW, _TOP):
            at = (rng < most).nonzero()[0]
            if len(at):
                to = read.take(at)
                shifted = code.take(at)
                shifted <<= _U16
                shifted |= data.take(to)
                code[at] = shifted
                to += 1
                read[at] = to
                rng[at] = rng.take(at) << _U16
    return grid.T.reshape(-1)[:n_ids].astype(np.uint32)


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def encode_checked(ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[bytes, list[bytes], list[int]]:
    """Packed order-0 table, block codes and block checksums of a segment."""
    freq = order0(ids)
    sums = [checksum(ids[i : i + block]) for i in range(0, len(ids), block)]
    return pack_order0(freq), encode(ids, freq, block), sums


def decode_checked(table: bytes, codes: list[bytes], sums: list[int], n_ids: int, block: int = BLOCK_IDS) -> np.ndarray:
    try:
        ids = decode(codes, n_ids, unpack_order0(table), block)
    except (IndexError, ValueError) as e:  # a wrong code may lead past its end
        raise CorruptBlock("unreadable") from e
    for k, want in enumerate(sums):
        if checksum(ids[k * block : (k + 1) * block]) != want:
            raise CorruptBlock(f"block {k}")
    return ids
