"""Quality rules: an isolation forest over the figures that rules of thumb are made of.

Each text is counted once (words, symbols, repeated lines and words, capitals, ...). A few hard rules fail a
text outright. The others' shares, in units of their spread over rows labelled good, go to an isolation
forest: trees that split a small sample at random places of random shares, wider ones likelier, until every
row is alone. A text whose path to its leaf is short on average is unlike the rest. The forest only orders
texts; the line is calibrated on labelled rows: where the share of bad rows above it, less ``GOOD_WEIGHT``
times that of good ones, is largest.

Shares' units and the line come from all labelled rows that pass the hard rules, but for the held-out fold. An isolation
tree is by its definition grown over ``SAMPLE`` rows; each draws its own from all those rows, the ones whose hash of id and tree is
least. The forest has ``TREES`` trees of at most ``2 * SAMPLE`` nodes, so its size is bounded before it is sent to all
tasks. Texts are counted and scored whole, in one Arrow pass each; the second reads only the counts.

Defined results: a null or wordless text has no words and fails; without labelled rows of either kind nothing but the hard rules
drops a text; contradicting labels of one document count as bad; an id that is repeated is fitted once, with its smallest counts; repeated rows each get a row;
an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch, held_out, texts
from tidegrid.operators.clean import grouped_quantiles

MIN_WORDS = 50
#: Per cent of words in repeated windows that a text may have.
MAX_REPEATED = 50
WINDOW = 3
TREES, SAMPLE = 200, 256
#: How many bad rows' share a good row's is worth.
GOOD_WEIGHT = 20
#: A share's unit is half the span of this middle part of good rows, or ``LEAST_UNIT``; values count as far as ``FARTHEST`` units.
MIDDLE, LEAST_UNIT, FARTHEST = 0.996, 0.1, 20.0
SEED = 13

#: Characters that count as symbols, and those that part words.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
_MARKS = b"!\"'()+,-./:;=?@[\\]^_`{}~"
_CAPITALS, _DIGITS = bytes(range(65, 91)), b"0123456789"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_digits", "n_marks", "n_same_words", "n_lines")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a run of ``window`` words that the text holds twice or more."""
    if len(words) <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = ids[: len(ids) - window + 1]
    for k in range(1, window):
        # Numbered anew at each step, keys stay below the square of the number of words.
        key = np.unique(key * len(number) + ids[k : len(ids) - window + 1 + k], return_inverse=True)[1]
    again = np.bincount(key)[key] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(window):
        covered[k : len(ids) - window + 1 + k] |= again
    return int(covered.sum())


def counts_of(text: str) -> tuple[int, ...]:
    """The figures named in ``COUNTS``."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # at ASCII white space only

    def count(of: bytes) -> int:
        return len(raw) - len(raw.translate(None, of))

    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return (len(words), len(text) - count(SPACES), count(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), count(_CAPITALS), count(_DIGITS), count(_MARKS), same, len(lines))


def count_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, held_out and the figures of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts_of(t) for t in texts(batch.column(2)).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c) for c in found.T]], ["doc_id", "held_out", *COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, " + ", ".join(f"{c} long" for c in COUNTS))


def hard_rules() -> Column:
    """Whether a row's counts fail outright."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def shares(counts: np.ndarray) -> np.ndarray:
    """Shares that rules look at, from a column for each of ``COUNTS``; none grows with a text's length."""
    n = dict(zip(COUNTS, counts.T.astype(float), strict=True))
    words, chars, lines = np.maximum(n["n_words"], 1), np.maximum(n["word_chars"], 1), np.maximum(n["n_lines"], 1)
    return np.stack(
        [n["word_chars"] / words, n["n_symbols"] / words, n["n_dup_lines"] / lines, n["n_repeat_words"] / words, n["n_capitals"] / chars, n["n_digits"] / chars, n["n_marks"] / words, n["n_same_words"] / words], axis=1
    )


def share_columns() -> list[Column]:
    """``shares`` as columns."""
    c = F.col
    words, chars, lines = (F.greatest(c(n), F.lit(1)) for n in ("n_words", "word_chars", "n_lines"))
    return [c("word_chars") / words, c("n_symbols") / words, c("n_dup_lines") / lines, c("n_repeat_words") / words, c("n_capitals") / chars, c("n_digits") / chars, c("n_marks") / words, c("n_same_words") / words]


@dataclass
class Forest:
    """All trees' nodes one after the other; a leaf's ``feature`` is -1 and its ``value`` the path length that ends there."""

    feature: np.ndarray
    value: np.ndarray
    low: np.ndarray
    high: np.ndarray
    roots: np.ndarray
    usual: float
    line: float = np.inf
    middle: np.ndarray | float = 0.0
    unit: np.ndarray | float = 1.0

    def scaled(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.middle) / self.unit, -FARTHEST, FARTHEST)


def usual_path(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n < 2 else 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, rng: np.random.Generator, trees: int = TREES, sample: int = SAMPLE) -> Forest:
    """Isolation trees over samples of ``rows``."""
    size = min(sample, len(rows))
    return grow_each((rows[rng.choice(len(rows), size, replace=False)] for _ in range(trees)), size, rng)


def grow_each(samples: Iterable[np.ndarray], size: int, rng: np.random.Generator) -> Forest:
    """An isolation tree over each of ``samples``, of ``size`` rows."""
    limit = int(np.ceil(np.log2(max(size, 2))))
    feature, value, low, high, roots = [], [], [], [], []

    def node(own: np.ndarray, depth: int) -> int:
        at = len(feature)
        for column, x in zip((feature, value, low, high), (-1, depth + usual_path(len(own)), at, at), strict=True):
            column.append(x)
        least, most = own.min(axis=0), own.max(axis=0)
        weight = (most - least) ** 2
        if depth < limit and weight.sum() > 0:
            f = int(rng.choice(len(weight), p=weight / weight.sum()))
            cut = rng.uniform(least[f], most[f])
            left = own[:, f] < cut
            if left.any() and not left.all():
                feature[at], value[at] = f, cut
                low[at], high[at] = node(own[left], depth + 1), node(own[~left], depth + 1)
        return at

    for own in samples:
        roots.append(node(own, 0))
    return Forest(np.array(feature, np.int32), np.array(value), np.array(low, np.int32), np.array(high, np.int32), np.array(roots, np.int32), max(usual_path(size), 1e-9))


def anomaly(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """Score of each row between 0 and 1; the shorter its mean path, the higher."""
    total = np.zeros(len(rows))
    every = np.arange(len(rows))
    for root in forest.roots:
        at = np.full(len(rows), root)
        while True:
            f = forest.feature[at]
            if (f < 0).all():
                break
            # A leaf's both ways lead to itself.
            at = np.where(rows[every, f] < forest.value[at], forest.low[at], forest.high[at])
        total += forest.value[at]
    return 2.0 ** (-total / len(forest.roots) / forest.usual) if len(forest.roots) else total


def draw(known: DataFrame, n: int, trees: int = TREES, sample: int = SAMPLE) -> list[np.ndarray]:
    """Counts of each tree's own ``sample`` of the ``n`` rows of ``known``, or of all rows where there are fewer."""
    # Hashes up to a bound that leaves 10 standard deviations more than a sample; only those rows are sent.
    bound = min(1.0, (sample + 10 * sample**0.5 + 20) / n) * (1 << 40)
    dealt = known.select("doc_id", *COUNTS, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    dealt = dealt.withColumn("place", F.pmod(F.xxhash64("doc_id", "tree", F.lit("quality")), F.lit(1 << 40))).where(F.col("place") < F.lit(int(bound)))
    found = dealt.orderBy("tree", "place", "doc_id").select("tree", *COUNTS).toArrow()
    rows = np.stack([found.column(c).to_numpy() for c in COUNTS], axis=1)
    firsts = np.searchsorted(found.column("tree").to_numpy(), np.arange(trees + 1))
    return [rows[i : min(i + sample, j)] for i, j in zip(firsts[:-1], firsts[1:], strict=True)]


def best_line(scratch: Scratch, scored: DataFrame, n_good: int, n_bad: int) -> float:
    """The score above which the share of bad rows less ``GOOD_WEIGHT`` times that of good ones is largest; the lowest such one."""
    counts = scratch.put(scored.groupBy("anomaly").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")), "quality-scores")
    # By ranges of scores: rows are added up within a range, and the ranges' totals before it.
    dealt = scratch.put(counts.repartitionByRange("anomaly").withColumn("part", F.spark_partition_id()), "quality-ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    starts = totals.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "gb"])
    upto = Window.partitionBy("part").orderBy("anomaly").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda c, first, n: 1 - (F.sum(c).over(upto) + F.col(first)) / F.lit(n)
    gains = dealt.join(starts, "part").select("anomaly", (share("bad", "b0", n_bad) - GOOD_WEIGHT * share("good", "g0", n_good)).alias("gain"))
    return gains.orderBy(F.desc("gain"), "anomaly").first()["anomaly"]


def fit(counted: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality") -> Forest:
    """Forest and line from all labelled rows of ``counted`` that pass the hard rules and aren't held out."""
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(label_id).cast("long").alias("doc_id")).agg(F.min(label_col).alias("quality"))
    known = counted.where(~F.col("held_out") & ~hard_rules() & F.col("doc_id").isNotNull()).join(marks, "doc_id")
    known = known.groupBy("doc_id", "quality").agg(F.min(F.struct(*COUNTS)).alias("c")).select("doc_id", (F.col("quality") > 0).alias("good"), "c.*")
    context = counted.sparkSession.sparkContext
    with Scratch(counted.sparkSession) as scratch:
        known = scratch.put(known, "quality-known")
        n_good, n_bad = known.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
        if not n_good or not n_bad:
            return Forest(*[np.zeros(0, np.int32)] * 5, 1.0)
        stacked = known.where("good").select(F.explode(F.array(*[F.struct(F.lit(i).alias("share"), c.alias("value")) for i, c in enumerate(share_columns())])).alias("s")).select("s.*")
        spans = grouped_quantiles(stacked, F.col("value"), [(1 - MIDDLE) / 2, 0.5, (1 + MIDDLE) / 2], ["share"])
        low, middle, high = np.array([r["q"] for r in sorted(spans.collect(), key=lambda r: r["share"])]).T  # one row a share
        shown = Forest(*[np.zeros(0, np.int32)] * 5, 1.0, middle=middle, unit=np.maximum((high - low) / 2, LEAST_UNIT))
        samples = [shown.scaled(shares(counts)) for counts in draw(known, n_good + n_bad)]
        forest = grow_each(samples, min(SAMPLE, n_good + n_bad), np.random.default_rng(SEED))
        forest.middle, forest.unit = shown.middle, shown.unit
        sent = context.broadcast(forest)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = anomaly(sent.value, sent.value.scaled(shares(np.stack([batch.column(c).to_numpy() for c in COUNTS], axis=1))))
                yield pa.RecordBatch.from_arrays([pa.array(score), batch.column("good")], ["anomaly", "good"])

        forest.line = best_line(scratch, known.mapInArrow(run, "anomaly double, good boolean"), n_good, n_bad)
        sent.unpersist()
    return forest


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly, held_out."""
    with Scratch(docs.sparkSession) as scratch:
        counted = scratch.keep(scratch.put(count_rows(docs, id_col, text_col), "quality-counts", gather=False))
        forest = docs.sparkSession.sparkContext.broadcast(fit(counted, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = anomaly(forest.value, forest.value.scaled(shares(np.stack([batch.column(c).to_numpy() for c in COUNTS], axis=1))))
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False)
            shown = [batch.column(c) for c in ("doc_id", *COUNTS[:5], "base_failed")]
            yield pa.RecordBatch.from_arrays([*shown, pa.array(~failed & (score <= forest.value.line)), pa.array(score), batch.column("held_out")], ["doc_id", *COUNTS[:5], "base_failed", "kept", "anomaly", "held_out"])

    return counted.withColumn("base_failed", hard_rules()).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS[:5]) + ", base_failed boolean, kept boolean, anomaly double, held_out boolean")
