"""Word shingles of UTF-8 texts as 64-bit hashes, computed in numpy over many texts at once."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Words are runs without these characters; A-Z is taken as a-z.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SHINGLE_WORDS = 5

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


@cache
def _bytes_table() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(1, 257, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    return lower, space


_powers: dict[str, np.ndarray] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 21)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[0]
    h ^= h >> np.uint64(33)
    h *= _MIX[1]
    h ^= h >> np.uint64(33)
    return h


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the number of words before each row (one more than rows)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    lower, space = _bytes_table()
    word = ~space[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | first[1:n]
    ends[:-1] &= ~word[1:] | first[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers_to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(lower[data] * up[:n], out=sums[1:])
    h = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
    return h, np.searchsorted(s, offs)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For each row its distinct shingles as sorted int64 of 63 bits; a shorter text is one shingle, no words none."""
    h, words = word_hashes(data, offs)
    n = len(h)
    out = []
    flat = np.zeros(max(n, 1), np.uint64)
    if n >= k:
        acc = h[: n - k + 1].copy()
        for i in range(1, k):
            acc = acc * np.uint64(_BASE) + h[i : n - k + 1 + i]
        flat[: n - k + 1] = mix(acc)
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(flat[a : b - k + 1] >> np.uint64(1)).astype(np.int64))
        elif b > a:
            acc = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    acc = acc * np.uint64(_BASE) + x
            out.append((mix(np.array([acc], np.uint64)) >> np.uint64(1)).astype(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out
