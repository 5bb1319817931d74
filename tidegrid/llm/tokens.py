"""Exact tokenisation of whole texts with a memo of cuts.

Byte-level and word BPE never merge across the start of a run of white space, so a text's ids are those
of its pieces one after the other. Pieces repeat: Arrow numbers those of a group of texts, and its different
ones of plain letters, digits and signs are cut further, by the tokenizer's own pattern, in Arrow too. Cuts are looked
up in the worker's memo by numbering them behind it; it holds them as one Arrow array, beside their ids. New cuts go
straight to the library's model, which merges them without the library's slow cutting; every other piece goes through
the library as it is and counts as one cut. When the memo is full, cuts met seldom are forgotten, which bounds a
worker's memory.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cuts that a worker remembers from one group of texts to the next, of so many bytes at most; longer ones than the last are not kept.
MEMO_PIECES = 400_000
MEMO_BYTES = 16_000_000
_LONG = 200
#: Bytes of text that are encoded at a time.
GROUP_BYTES = 8_000_000
#: Pieces whose ids are gathered at a time, which keeps their places in a processor's cache.
_TAKEN = 100_000

_PIECE = re.compile(r"\s*[^ \t\n\r]+|\s+")
#: White space other than the four characters that pieces are cut at.
_OTHER = "[\x00\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_OTHER_SPACE = re.compile(_OTHER)
#: For Arrow: white space that isn't a single space or line end between words, or no text.
_NOT_SIMPLE = rf"[ \n][ \n]|[\t\r]|{_OTHER}|^[ \n]|[ \n]$|^$".replace("\0", r"\x00")
#: What makes a piece other than plain: a character that not every Unicode version and normal form takes alike, or a special token's mark.
_ODD = r"[^\t\n\r -~À-ÿ]|<\|"
_ODD_TEXT = re.compile(_ODD)
#: The patterns that the two kinds of tokenizer cut texts by, for plain characters; white space is no cut of words.
_CUT_BYTES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+"
_CUT_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+"
#: In Arrow, whose patterns can't look ahead, plain pieces have no white space but a first character.
_AHEAD = r"|\s+(?!\S)"
#: What parts the cuts of a piece in Arrow; a plain piece doesn't hold it.
_PART = "\x01"


def _byte_letters() -> dict[str, str]:
    """For each of the first 256 characters the letters that stand for its UTF-8 bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return str.maketrans({chr(c): "".join(letter[b] for b in chr(c).encode()) for c in range(256)})


class _Ragged:
    """Arrays of ids one after the other, by number."""

    def __init__(self):
        self._ids, self._used = np.zeros(1 << 16, np.uint32), 0
        self._starts, self._counts, self._n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def extend(self, ids: np.ndarray, counts: np.ndarray) -> None:
        n, used = self._n + len(counts), self._used + len(ids)
        self._ids, self._starts, self._counts = _room(self._ids, used), _room(self._starts, n), _room(self._counts, n)
        self._ids[self._used : used] = ids
        self._counts[self._n : n] = counts
        self._starts[self._n : n] = self._used + np.cumsum(counts) - counts
        self._n, self._used = n, used

    def take(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _gather(self._ids, self._starts, self._counts, number)


def _gather(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the arrays ``number``, one after the other, and how many each has; array i is ``counts[i]`` long and begins at ``starts[i]``."""
    counts = counts.take(number)
    out, done = np.empty(int(counts.sum()), ids.dtype), 0
    for i in range(0, len(number), _TAKEN):
        at = _places(starts.take(number[i : i + _TAKEN]), counts[i : i + _TAKEN])
        ids.take(at, out=out[done : done + len(at)], mode="clip")
        done += len(at)
    return out, counts


def _places(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Runs of ``counts`` places from ``starts`` on, one after the other."""
    ends = np.cumsum(counts)
    at = np.repeat(starts - ends + counts, counts)
    at += np.arange(len(at))
    return at


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``counts`` values."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return np.diff(upto[np.concatenate([[0], np.cumsum(counts)])])


def _lengths(lists: pa.ListArray) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy()).astype(np.int64)


def _numbered(parts: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The different values of all parts, in the order they are met, and the number of each value in turn."""
    found = pa.chunked_array([p for p in parts if len(p)], pa.large_string()).dictionary_encode()
    if not found.num_chunks:
        return pa.array([], pa.large_string()), np.zeros(0, np.int32)
    return found.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in found.chunks])


def _merged(first: np.ndarray, number: np.ndarray, n_first: np.ndarray, n_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``number`` has the runs of the rows that are ``first``, then those of the rest; here all runs are in the rows' order, with their lengths."""
    if first.all():
        return number, n_first
    n = np.empty(len(first), np.int64)
    n[first], n[~first] = n_first, n_rest
    begins = np.empty(len(first), np.int64)
    begins[first] = np.cumsum(n_first) - n_first
    begins[~first] = n_first.sum() + np.cumsum(n_rest) - n_rest
    return number[_places(begins, n)], n


class PieceTokenizer:
    """``words``: white space is dropped by the tokenizer, so texts are cut at spaces and line ends."""

    def __init__(self, path: str, words: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._merge = self._tokenizer.model.tokenize
        self._words = words
        pattern = _CUT_WORDS if words else _CUT_BYTES
        self._cut, self._arrow_cut = re.compile(pattern).findall, pattern.replace(_AHEAD, "")
        #: Pieces that aren't cut in Arrow: the mark \0 is odd, and words have no tabs between them.
        self._alone = rf"{_ODD}|[\t\r]" if words else _ODD
        self._letters = _byte_letters()
        self._reset()

    def _reset(self) -> None:
        """The memo holds the empty cut alone, which ends each piece in Arrow."""
        self._cuts, self._ids, self._met = pa.array([""], pa.large_string()), _Ragged(), np.zeros(1, np.int64)
        self._ids.extend(np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _forget(self) -> None:
        """Keep the cuts met most, at most half of what fits, with their ids."""
        cuts, ids, met = self._cuts, self._ids, self._met
        size = pc.binary_length(cuts).to_numpy()
        able, least = size <= _LONG, 2
        able[0] = False  # the reset sets it
        while (keep := able & (met >= least)).sum() > MEMO_PIECES // 2 or size[keep].sum() > MEMO_BYTES // 2:
            least *= 2
        self._reset()
        self._cuts = pa.concat_arrays([self._cuts, cuts.filter(pa.array(keep))])
        self._ids.extend(*ids.take(np.flatnonzero(keep)))
        self._met = np.concatenate([self._met, met[keep] // 2])

    def _simple(self, texts: list[str]) -> np.ndarray:
        """Whether single spaces and line ends are all the white space there is, none of it at either end."""
        return ~pc.match_substring_regex(pa.array(texts, pa.large_string()), _NOT_SIMPLE).to_numpy(zero_copy_only=False)

    def _pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The different pieces of all texts, the numbers of each text's pieces one after the other, and how many each text has."""
        if self._words:
            lists = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()), " ")
            return *_numbered([lists.values]), _lengths(lists)
        simple = self._simple(texts)
        lists = pc.split_pattern(pa.array(["\0" + t.replace("\n", " \n") for t, s in zip(texts, simple, strict=True) if s], pa.large_string()), " ")
        rest = [[f"\0{p}" for p in ([t] if _OTHER_SPACE.search(t) else _PIECE.findall(t))] for t, s in zip(texts, simple, strict=True) if not s]
        pieces, number = _numbered([lists.values, pa.array([p for own in rest for p in own], pa.large_string())])
        return pieces, *_merged(simple, number, _lengths(lists), np.array([len(own) for own in rest], np.int64))

    def _text_of(self, piece: str) -> str:
        """A byte-level piece has a space before it, unless it is marked as it stands or begins with a line end."""
        if self._words or piece[:1] == "\n":
            return piece
        return piece[1:] if piece[:1] == "\0" else f" {piece}"

    def _cut_alone(self, piece: str) -> list[str]:
        shown = self._text_of(piece)
        if _ODD_TEXT.search(shown):
            return [f"\0{shown}"]  # encoded as it is
        return self._cut(shown.lower() if self._words else shown)

    def _cut_plain(self, pieces: pa.Array) -> pa.ListArray:
        if self._words:
            shown = pc.utf8_lower(pieces)
        else:  # as in `_text_of`
            shown = pc.if_else(pc.starts_with(pieces, "\n"), pieces, pc.binary_join_element_wise(pa.scalar("", pieces.type), pieces, pa.scalar(" ", pieces.type)))
        return pc.split_pattern(pc.replace_substring_regex(shown, self._arrow_cut, rf"\0{_PART}"), _PART)

    def _encode_plain(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, n = [], np.zeros(len(cuts), np.int64)
        for i, cut in enumerate(cuts):
            found = self._merge(cut)
            ids += [x.id for x in found]
            n[i] = len(found)
        return np.array(ids, np.uint32), n

    def _learn(self, fresh: list[str]) -> None:
        """Add the ids of new cuts to the memo's."""
        whole = np.array([c[:1] == "\0" for c in fresh], bool)
        plain = [c for c in fresh if c[:1] != "\0"]
        # But for spaces, which begin cuts, ASCII characters stand for themselves.
        space = self._letters[32]
        ids, n = self._encode_plain([c.replace(" ", space) if c.isascii() and not c.isspace() else c.translate(self._letters) for c in plain])
        odd = [e.ids for e in self._tokenizer.encode_batch([c[1:] for c in fresh if c[:1] == "\0"], add_special_tokens=False)] if whole.any() else []
        ids = np.concatenate([ids, np.array([x for own in odd for x in own], np.uint32)])
        self._ids.extend(*_merged(~whole, ids, n, np.array([len(own) for own in odd], np.int64)))

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has."""
        alone = pc.match_substring_regex(pieces, self._alone)
        lists = self._cut_plain(pieces.filter(pc.invert(alone)))
        rest = [self._cut_alone(p) for p in pieces.filter(alone).to_pylist()]
        known = len(self._cuts)
        self._cuts, number = _numbered([self._cuts, lists.values, pa.array([c for own in rest for c in own], pa.large_string())])
        if len(self._cuts) > known:
            self._learn(self._cuts.slice(known).to_pylist())
        number, n = _merged(~alone.to_numpy(zero_copy_only=False), number[known:], _lengths(lists), np.array([len(own) for own in rest], np.int64))
        met = np.bincount(number, minlength=len(self._cuts))
        met[: len(self._met)] += self._met
        self._met = met
        ids, counts = self._ids.take(number)
        return ids, _sums(counts, n)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other (uint32), and how many each has."""
        pieces, number, n = self._pieces(texts)
        flat, counts = self._encode_pieces(pieces)
        ids, counts = _gather(flat, np.cumsum(counts) - counts, counts, number)
        if len(self._cuts) > MEMO_PIECES or self._cuts.nbytes > MEMO_BYTES:
            self._forget()
        return ids, _sums(counts, n)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


_workers: dict[tuple[str, bool], PieceTokenizer] = {}


def worker_tokenizer(path: str, words: bool) -> PieceTokenizer:
    """The tokenizer of this Python worker, with what it remembers from earlier tasks."""
    if (path, words) not in _workers:
        _workers[path, words] = PieceTokenizer(path, words)
    return _workers[path, words]
