"""Toxicity: a linear-chain conditional random field tags toxic spans.

Only documents carry labels, so tokens are labelled first: a token of a toxic document is toxic where its
word, or a prefix of it, occurs in toxic documents in at least ``MIN_CONTEXTS`` different contexts (pairs
of neighbouring words, so that copies of one document count once) and hardly ever in others; tokens of
documents that aren't toxic never are. A two-state chain over hashed word, prefix and suffix features is
fitted to those tokens by gradient ascent. Scoring runs forward-backward over every whole text; the
marginals give the offending offsets, and a two-variable logistic regression on the largest marginal and
the expected number of toxic tokens gives the document's score.

The model is fitted on at most about ``MAX_PER_CLASS`` labelled documents of either class, of up to
``MAX_TRAIN_BYTES`` bytes each and ``MAX_CLASS_BYTES`` together, chosen by a hash of the id; the held-out
fold is never among them. An id that is repeated counts once, with the text that is smallest in order. Of
these documents' windows with toxic tokens the chain takes ``MAX_WINDOWS`` at even distances.

Defined results: a null or wordless text gets the score of a text without toxic tokens; without labelled
documents of both classes every score is 0; contradicting labels of one document count as toxic; repeated
rows each get a row; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch, held_out, texts

FEATURE_BITS = 18
MAX_PER_CLASS = 2_000
MAX_TRAIN_BYTES = 100_000
MAX_CLASS_BYTES = 16_000_000
MIN_CONTEXTS = 8
#: A feature is toxic if of its documents, at even classes, this share is toxic.
MIN_PURITY = 0.98
#: Predicted toxic at this score.
THRESHOLD = 0.3
#: A token is reported at this marginal.
SPAN_MARGINAL = 0.5
BLOCK = 64
#: Windows with toxic tokens that the chain is fitted on, besides about as many without.
MAX_WINDOWS = 5_000
#: Words whose score a worker remembers, and tokens that one numpy step takes.
MEMO_WORDS = 300_000
STEP_TOKENS = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def lowered(text: str) -> str:
    """``text`` in lower case at its own offsets."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def features(word: str) -> list[str]:
    return [f"w{word}", *[f"p{n}{word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n], f"s{word[-3:]}"]


def hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "replace")) & ((1 << FEATURE_BITS) - 1) for n in names]


@dataclass
class ToxicModel:
    weights: np.ndarray
    bias: float
    transition: np.ndarray  # 2 x 2, of either state after either
    calibration: np.ndarray | None
    memo: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def word_score(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            got = float(self.weights[hashed(features(word))].sum() + self.bias)
            if len(self.memo) < MEMO_WORDS:
                self.memo[word] = got
        return got


def marginals(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Probability of the toxic state at each token of texts of ``lengths`` tokens, by forward-backward.

    The expected number of steps from either state to either, the one into each text from a clean start
    among them, is added to ``pairs`` (2 x 2).

    Texts are cut into blocks; the blocks' transfer matrices carry the state from block to block, so the
    result is exact while numpy works on all blocks at once.
    """
    lengths = np.asarray(lengths, np.int64)
    blocks = -(-lengths // BLOCK)
    nb, n = int(blocks.sum()), len(scores)
    if not n:
        return np.zeros(0)
    first_block = np.cumsum(blocks) - blocks
    text_at = np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    cell = (first_block[text_at] + inside // BLOCK) * BLOCK + inside % BLOCK
    w = np.ones((nb * BLOCK, 2))
    real = np.zeros(nb * BLOCK, bool)
    w[cell, 1] = np.exp(np.clip(scores, -50, 50))
    real[cell] = True
    w, real = w.reshape(nb, BLOCK, 2), real.reshape(nb, BLOCK)
    step = np.exp(transition)

    transfer = np.broadcast_to(np.eye(2), (nb, 2, 2)).copy()
    for t in range(BLOCK):
        on = real[:, t]
        nxt = (transfer[on] @ step) * w[on, t][:, None, :]
        transfer[on] = nxt / nxt.sum(axis=(1, 2), keepdims=True)

    ahead, behind = np.full((nb, 2), 0.5), np.full((nb, 2), 0.5)
    ahead[first_block[blocks > 0]] = (1.0, 0.0)
    for k in range(1, int(blocks.max())):
        at = first_block[blocks > k] + k
        v = np.einsum("ni,nij->nj", ahead[at - 1], transfer[at - 1])
        ahead[at] = v / v.sum(axis=1, keepdims=True)
    for k in range(1, int(blocks.max())):
        at = (first_block + blocks - 1)[blocks > k] - k
        v = np.einsum("nij,nj->ni", transfer[at + 1], behind[at + 1])
        behind[at] = v / v.sum(axis=1, keepdims=True)

    alpha = np.zeros((nb, BLOCK, 2))
    a = ahead
    for t in range(BLOCK):
        nxt = (a @ step) * w[:, t]
        a = np.where(real[:, t, None], nxt / nxt.sum(axis=1, keepdims=True), a)
        alpha[:, t] = a
    out = np.zeros((nb, BLOCK))
    b = behind
    for t in range(BLOCK - 1, -1, -1):
        joint = alpha[:, t] * b
        out[:, t] = joint[:, 1] / joint.sum(axis=1)
        if pairs is not None:
            both = (alpha[:, t - 1] if t else ahead)[:, :, None] * step * (b * w[:, t])[:, None, :]
            both /= both.sum(axis=(1, 2), keepdims=True)
            pairs += both[real[:, t]].sum(axis=0)
        prev = (b * w[:, t]) @ step.T
        b = np.where(real[:, t, None], prev / prev.sum(axis=1, keepdims=True), b)
    return out.reshape(-1)[cell]


def token_labels(docs: list[tuple[list[str], int]]) -> list[np.ndarray]:
    """Toxic tokens of each (words, toxic) document, from the documents' labels alone."""
    df = [Counter(), Counter()]
    for words, toxic in docs:
        df[toxic].update(set(words))
    n_toxic = sum(t for _, t in docs) or 1
    even = n_toxic / max(1, len(docs) - n_toxic)
    pure = lambda toxic, clean: toxic >= MIN_CONTEXTS and clean * even <= (1 - MIN_PURITY) * toxic
    counts: dict[str, int] = Counter()
    for w, n in df[1].items():
        for f in features(w)[:-1]:
            counts[f] += n
    likely = {f for f, n in counts.items() if n >= MIN_CONTEXTS}
    clean: dict[str, int] = Counter()
    for w, n in df[0].items():
        for f in features(w)[:-1]:
            if f in likely:
                clean[f] += n
    likely = {f for f in likely if pure(counts[f], clean[f])}
    # Contexts are gathered only for the few features that pass by their counts.
    of = {w: [f for f in features(w)[:-1] if f in likely] for w in df[1]}
    contexts: dict[str, set] = {f: set() for f in likely}
    for words, toxic in docs:
        for i, w in enumerate(words if toxic else ()):
            for f in of[w]:
                contexts[f].add(hash((words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")))
    bad = {f for f, seen in contexts.items() if pure(len(seen), clean[f])}
    toxic_words = {w for w, names in of.items() if any(f in bad for f in names)}
    return [np.array([bool(toxic) and w in toxic_words for w in words], bool) for words, toxic in docs]


def _spread(items: list, most: int) -> list:
    """``most`` of the items at even distances, or all."""
    return [items[i * len(items) // most] for i in range(most)] if len(items) > most else items


def steps(gold: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Number of steps from either state to either in texts of ``lengths`` tokens, each from a clean start."""
    before = np.zeros(len(gold), np.int64)
    before[1:] = gold[:-1]
    some = lengths > 0
    before[(np.cumsum(lengths) - lengths)[some]] = 0
    return np.bincount(before * 2 + gold.astype(np.int64), minlength=4).reshape(2, 2).astype(float)


def fit_chain(docs: list[tuple[list[str], int]], rounds: int = 40, rate: float = 0.2, l2: float = 1e-5) -> ToxicModel:
    """Weights by Adam on the chain's log-likelihood over windows of ``BLOCK`` tokens."""
    labels = token_labels(docs)
    windows: list[tuple[list[str], np.ndarray]] = []
    for (words, _), y in zip(docs, labels, strict=True):
        windows += [(words[i : i + BLOCK], y[i : i + BLOCK]) for i in range(0, len(words), BLOCK)]
    hot = _spread([x for x in windows if x[1].any()], MAX_WINDOWS)
    rest = [x for x in windows if not x[1].any()]
    rest = rest[:: max(1, len(rest) // (len(hot) + 2_000))]
    windows = hot + rest
    vocab: dict[str, int] = {}
    ids = np.array([vocab.setdefault(w, len(vocab)) for words, _ in windows for w in words], np.int64)
    gold = np.concatenate([y for _, y in windows]) if windows else np.zeros(0, bool)
    lengths = np.array([len(y) for _, y in windows], np.int64)
    rows, cols = [], []
    for w, i in vocab.items():
        h = hashed(features(w))
        rows += [i] * len(h)
        cols += h
    rows, cols, size = np.array(rows, np.int64), np.array(cols, np.int64), 1 << FEATURE_BITS
    gold_pairs = steps(gold, lengths)
    weights, bias, transition = np.zeros(size), 0.0, np.log((gold_pairs + 1) / (gold_pairs + 1).sum(axis=1, keepdims=True))
    m, v = np.zeros(size + 5), np.zeros(size + 5)
    for r in range(1, rounds + 1):
        per_word = np.bincount(rows, weights[cols], minlength=len(vocab)) + bias
        expected = np.zeros((2, 2))
        p = marginals(per_word[ids], lengths, transition, expected)
        error = np.bincount(ids, gold - p, minlength=len(vocab))
        by_step = np.clip(gold_pairs - expected, -len(hot), len(hot)).reshape(-1)
        grad = np.concatenate([np.bincount(cols, error[rows], minlength=size), [error.sum()], by_step]) / max(1, len(hot)) - l2 * np.append(weights, np.zeros(5))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-6)
        weights, bias, transition = weights + move[:-5], bias + move[-5], transition + move[-4:].reshape(2, 2)
    return ToxicModel(weights, float(bias), transition, None)


def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each text: logit of the largest marginal, log of 1 + the expected number of toxic tokens."""
    out = np.zeros((len(lengths), 2))
    out[:, 0] = -12
    some = lengths > 0
    if some.any():
        starts = (np.cumsum(lengths) - lengths)[some]
        most = np.clip(np.maximum.reduceat(p, starts), 6e-6, 1 - 6e-6)
        out[some, 0] = np.log(most / (1 - most))
        out[some, 1] = np.log1p(np.add.reduceat(np.where(p > 0.05, p, 0.0), starts))
    return out


def calibrated(x: np.ndarray, c: np.ndarray | None) -> np.ndarray:
    return np.zeros(len(x)) if c is None else 1 / (1 + np.exp(-np.clip(x @ c[1:] + c[0], -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    z = np.column_stack([np.ones(len(x)), x])
    c = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -40, 40)))
        grad = z.T @ (weight * (y - p)) - ridge * np.r_[0, c[1:]]
        hess = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.diag(np.r_[1e-6, np.ones(len(c) - 1)])
        c = c + np.linalg.solve(hess, grad)
    return c


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_class: int = MAX_PER_CLASS) -> ToxicModel:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y is not null").where(~held_out(F.col("id"))).groupBy("id").agg(F.max((F.col("y") > 0).cast("int")).alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return ToxicModel(np.zeros(1 << FEATURE_BITS), 0.0, np.log(np.full((2, 2), 0.5)), None)
    share = F.when(F.col("y") == 1, min(1.0, max_per_class / sizes[1])).otherwise(min(1.0, max_per_class / sizes[0]))
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit("toxic")), F.lit(1_000_003)) < share * 1_000_003)
    # About 2 * max_per_class ids, whatever the input: sent to the texts, which then stay where they are.
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") <= MAX_TRAIN_BYTES)
    with Scratch(docs.sparkSession) as scratch:
        # A repeated id counts once, so the cap on ids is one on rows.
        rows = scratch.put(rows.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")), "toxic-sample")
        before = Window.partitionBy("y").orderBy(F.xxhash64("id", F.lit("bytes")), "id")
        rows = rows.withColumn("upto", F.sum(F.octet_length("text")).over(before)).where(F.col("upto") <= MAX_CLASS_BYTES).select("id", "text", "y").toArrow()
    rows = sorted(zip(rows.column("id").to_pylist(), rows.column("text").to_pylist(), rows.column("y").to_pylist(), strict=True))
    tokens = [(list(map(sys.intern, _WORD.findall(lowered(t)))), y) for _, t, y in rows]
    del rows
    if len({y for _, y in tokens}) < 2:
        return ToxicModel(np.zeros(1 << FEATURE_BITS), 0.0, np.log(np.full((2, 2), 0.5)), None)
    model = fit_chain(tokens)
    y = np.array([y for _, y in tokens], float)
    lengths = np.array([len(w) for w, _ in tokens], np.int64)
    x = np.zeros((len(tokens), 2))
    for i in range(0, len(tokens), 256):
        values = np.array([model.word_score(w) for words, _ in tokens[i : i + 256] for w in words], float)
        n = lengths[i : i + 256]
        x[i : i + 256] = summary(marginals(values, n, model.transition), n)
    of = np.array([sizes[0] / (y == 0).sum(), sizes[1] / (y == 1).sum()]) / sum(sizes.values()) * len(y)
    model.calibration = _logistic(x, y, of[y.astype(int)])
    return model


def _scored(model: ToxicModel, rows: list[str]) -> tuple[np.ndarray, list[tuple[list[int], list[int]]]]:
    lows = [lowered(t) for t in rows]
    words = [_WORD.findall(t) for t in lows]
    lengths = np.array([len(w) for w in words], np.int64)
    memo, score = model.memo, model.word_score
    values = np.fromiter((memo[w] if w in memo else score(w) for ws in words for w in ws), float, int(lengths.sum()))
    p = marginals(values, lengths, model.transition)
    spans, at = [], 0
    for text, n in zip(lows, lengths.tolist(), strict=True):
        hits = np.flatnonzero(p[at : at + n] >= SPAN_MARGINAL)
        at += n
        begins, ends = [], []
        if len(hits):
            places = [m.span() for m in _WORD.finditer(text)]
            last = -2
            for h in hits.tolist():
                if h == last + 1:
                    ends[-1] = places[h][1]
                else:
                    begins.append(places[h][0])
                    ends.append(places[h][1])
                last = h
        spans.append((begins, ends))
    return calibrated(summary(p, lengths), model.calibration), spans


def predict(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted, and the offsets where toxic spans begin and end."""
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = texts(batch.column(2)).to_pylist()
            i = 0
            while i < len(rows):
                j, size = i, 0
                while j < len(rows) and (j == i or size + len(rows[j]) < 5 * STEP_TOKENS):
                    size += len(rows[j])
                    j += 1
                score, spans = _scored(model.value, rows[i:j])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array([b for b, _ in spans], pa.list_(pa.int32())), pa.array([e for _, e in spans], pa.list_(pa.int32()))],
                    ["doc_id", "held_out", "score", "predicted", "span_begins", "span_ends"],
                )
                i = j

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, span_begins array<int>, span_ends array<int>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return predict(docs, fit(docs, labels))
