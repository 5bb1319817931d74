"""Language ID: multinomial naive Bayes over hashed character n-grams of one to three characters.

Texts are lower-cased, every character that isn't a letter counts as a space. The log-probability matrix
has a fixed number of buckets and at most ``MAX_LANGS`` rows, so its size is bounded before it is sent to
all tasks; texts are scored whole, in numpy, many at once.

The model is fitted on at most about ``MAX_PER_LANG`` labelled rows of each language, chosen by a hash of
the id; rows of the held-out fold and rows without lang are never among them.

Defined results: a null text, or one without letters, is ``und`` with score 0, as is any text where there
is nothing to learn from; equal scores go to the smaller language name; repeated rows each get a row; an
empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import held_out, slices, texts, tidied

BUCKET_BITS = 15
ORDERS = (1, 2, 3)
ALPHA = 0.1
MAX_LANGS = 256
MAX_PER_LANG = 10_000
#: Characters that one numpy step takes.
CHUNK_CHARS = 1_000_000
UNKNOWN = "und"
#: Documents below this score are rejected with those that have no language.
MIN_SCORE = 0.5


@dataclass
class LanguageModel:
    langs: list[str]
    log_p: np.ndarray  # langs x (orders x buckets)
    prior: np.ndarray


@cache
def _letters() -> np.ndarray:
    """For each code point below 65536 itself if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(1 << 16)], np.uint32)


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    known = _letters()
    if c.size and c.max() >= len(known):
        far = c >= len(known)
        keep = np.array([x if chr(x).isalpha() else 0 for x in np.unique(c[far])], np.uint32)
        out = known[np.where(far, 0, c)]
        out[far] = keep[np.searchsorted(np.unique(c[far]), c[far])]
        return out
    return known[c]


def _buckets(c: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of the n-gram at each position, as far as there is one."""
    out, acc = [], None
    for n in ORDERS:
        tail = c[n - 1 :] + np.uint32(1)
        acc = tail.copy() if acc is None else acc[: len(tail)] * np.uint32(0x9E3779B1) + tail
        h = acc * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h = h * np.uint32(0xC2B2AE35)
        out.append((h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32) + np.int32((n - 1) << BUCKET_BITS))
    return out


def _groups(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, codes, begin of each row) of rows padded with a space on either side; a long row comes in overlapping pieces of its own."""
    rows, size, first = [], 0, 0
    for i, t in enumerate(column.to_pylist()):
        if size + len(t) > CHUNK_CHARS and rows:
            yield _joined(first, rows)
            rows, size = [], 0
        if not rows:
            first = i
        if len(t) > CHUNK_CHARS:
            low = f" {t.lower()} "
            step = CHUNK_CHARS
            for at in range(0, max(1, len(low) - max(ORDERS) + 1), step):
                yield i, _codes(low[at : at + step + max(ORDERS) - 1]), np.array([0, -1])
            continue
        rows.append(f" {t.lower()} ")
        size += len(t) + 2
    if rows:
        yield _joined(first, rows)


def _joined(first: int, rows: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    begins = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=begins[1:])
    return first, _codes("".join(rows)), begins


def _row_grams(codes: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets, and which of them lie within one row and aren't only spaces."""
    if begins[-1] < 0:  # a piece of a longer row: every n-gram that starts in its step
        begins = np.array([0, len(codes)])
    end = np.repeat(begins[1:], np.diff(begins))
    for n, b in zip(ORDERS, _buckets(codes), strict=True):
        ok = np.arange(len(b)) + n <= end[: len(b)]
        letters = codes[: len(b)] != 0
        for k in range(1, n):
            letters = letters | (codes[k : k + len(b)] != 0)
        yield b, ok & letters


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = len(ORDERS) << BUCKET_BITS
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in (part for whole in batches for part in slices(whole, 1)):
        langs = np.array(batch.column(0).to_pylist(), object)
        for first, codes, begins in _groups(texts(batch.column(1))):
            n = len(begins) - 1
            own = langs[first : first + n]
            at = np.repeat(np.arange(n), np.diff(begins)) if begins[-1] >= 0 else np.zeros(len(codes), np.int64)
            for b, ok in _row_grams(codes, begins):
                for lang in set(own.tolist()):
                    hit = b[ok & np.isin(at[: len(b)], np.flatnonzero(own == lang))]
                    total.setdefault(lang, np.zeros(size, np.int64))
                    total[lang] += np.bincount(hit, minlength=size)
        for lang in langs:
            docs[lang] = docs.get(lang, 0) + 1
    for lang, n in total.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(some) + 1)), pa.array(np.append(some, -1)), pa.array(np.append(n[some], docs[lang]))], ["lang", "bucket", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_per_lang: int = MAX_PER_LANG) -> LanguageModel:
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((0, len(ORDERS) << BUCKET_BITS)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, max_per_lang / sizes[lang]))])
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    found = chosen.select("lang", "text").mapInArrow(tidied(_counts), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), len(ORDERS) << BUCKET_BITS))
    row = {lang: i for i, lang in enumerate(langs)}
    at = np.array([row[x] for x in found.column("lang").to_pylist()], np.int64)
    bucket, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    grams = bucket >= 0
    counts[at[grams], bucket[grams]] = n[grams]
    parts = counts.reshape(len(langs), len(ORDERS), -1)
    log_p = np.log((parts + ALPHA) / (parts.sum(axis=2, keepdims=True) + ALPHA * (1 << BUCKET_BITS)))
    prior = np.array([sizes[x] for x in langs], float)
    return LanguageModel(langs, log_p.reshape(counts.shape), np.log(prior / prior.sum()))


def score_texts(model: LanguageModel, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior for each text."""
    n, k = len(column), len(model.langs)
    total, letters = np.zeros((n, max(k, 1))), np.zeros(n, np.int64)
    if k:
        total += model.prior
    for first, codes, begins in _groups(texts(column)):
        starts = np.array([0]) if begins[-1] < 0 else begins[:-1]
        rows = slice(first, first + len(starts))
        if not len(codes):
            continue
        letters[rows] += np.add.reduceat((codes != 0).astype(np.int64), starts)
        for b, ok in _row_grams(codes, begins):
            if not len(b):
                continue
            inside = starts < len(b)
            for j in range(k):
                total[rows, j][inside] += np.add.reduceat(np.where(ok, model.log_p[j][b], 0.0), starts[inside])
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    none = (letters == 0) | (k == 0)
    langs = [UNKNOWN if x else model.langs[b] for x, b in zip(none.tolist(), best.tolist(), strict=True)]
    return langs, np.where(none, 0.0, score)


def has_letters(column: pa.Array) -> np.ndarray:
    """Which texts have a letter."""
    letters = np.zeros(len(column), bool)
    for first, codes, begins in _groups(texts(column)):
        starts = np.array([0]) if begins[-1] < 0 else begins[:-1]
        if len(codes):
            letters[first : first + len(starts)] |= np.logical_or.reduceat(codes != 0, starts)
    return letters


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            langs, score = score_texts(model.value, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language; with no learned language, those with letters."""
    model, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at)):
            if not model.value.langs:
                yield batch.filter(pa.array(has_letters(batch.column(at))))
                continue
            langs, score = score_texts(model.value, batch.column(at))
            yield batch.filter(pa.array((np.array(langs, object) != UNKNOWN) & (score >= min_score)))

    return docs.mapInArrow(tidied(run), docs.schema)
