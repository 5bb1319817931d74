import random
import re
from collections import Counter

import numpy as np
import pytest

from tidegrid.llm import quality_rules as qr


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


ODD = ["", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x\ny\nx\n\n \nx ", "é ü\xa0ö # $ <>|", "a a a a", "a b c\x0bd\x0ce\x1cf a b c", "l\r\nl\r\nl", " wide space"]


@pytest.mark.parametrize("text", ODD)
def test_counts(text):
    assert qr.counts_of(text)[:5] == brute(text)


def test_counts_of_random_texts():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "ab", "#", " ", " ", "\n", "\t", "é", "\xa0"]) for _ in range(rng.randrange(200)))
        assert qr.counts_of(text)[:5] == brute(text), repr(text)


def test_forest_finds_what_is_unlike_the_rest():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(0, 1, (500, 3)), rng.normal(9, 1, (10, 3))])
    score = qr.anomaly(qr.grow(rows, rng, trees=100), rows)
    assert ((score > 0) & (score < 1)).all() and score[500:].min() > np.quantile(score[:500], 0.95)
    one = qr.grow(np.ones((4, 2)), rng, trees=3)
    assert np.allclose(qr.anomaly(one, np.ones((2, 2))), 0.5)  # rows that can't be told apart have the usual path


def corpus(n=600, bad=0.08):
    """Clean texts and some of which each has a kind and a share of junk of its own."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(60, 400))]
        good = rng.random() > bad
        share, junk = rng.uniform(0.3, 1), rng.choice(["{} |", "{}***", "{}!! {}!! !!"])
        text = " ".join(w if good or rng.random() > share else junk.format(w, w.upper()) for w in words)
        rows.append((i, text))
        labels.append((i, int(good)))
    return rows, labels


def test_line_from_labels(spark):
    rows, labels = corpus()
    got = {r.doc_id: r for r in qr.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    held = [(got[i].kept, good) for i, good in labels if got[i].held_out]
    assert np.mean([kept for kept, good in held if good]) >= 0.95 and np.mean([kept for kept, good in held if not good]) <= 0.1
    assert all(tuple(got[i][1:6]) == brute(t) for i, t in rows) and not any(r.base_failed for r in got.values())


def test_scores_equal_a_walk_through_the_trees(spark):
    rows, labels = corpus(240)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    forest = qr.fit(qr.count_rows(docs, "doc_id", "text"), spark.createDataFrame(labels, "doc_id long, quality int"))

    def path(x, at):
        return forest.value[at] if forest.feature[at] < 0 else path(x, forest.low[at] if x[forest.feature[at]] < forest.value[at] else forest.high[at])

    for r in qr.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()[:30]:
        x = forest.scaled(qr.shares(np.array([qr.counts_of(rows[r.doc_id][1])])))[0]
        score = 2 ** (-np.mean([path(x, root) for root in forest.roots]) / forest.usual)
        assert abs(score - r.anomaly) < 1e-12 and r.kept == (not r.base_failed and score <= forest.line)


def test_odd_and_empty(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(None, 1), (1, None), (1, 1), (2, 0), (1, 0), (5, 1)], "doc_id long, quality int")
    got = qr.judge(odd_docs, labels).collect()
    want = Counter((r.doc_id, *brute(r.text)) for r in odd_docs.collect())
    assert Counter(tuple(r[:6]) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    assert qr.judge(no_docs, labels).collect() == [] and [r.kept for r in qr.judge(odd_docs, labels.where("quality > 5")).collect() if not r.base_failed] == [True]
    ids = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert qr.judge(ids, labels).count() == 2


def test_units_and_line_come_from_all_labelled_rows(spark):
    """22,000 labelled rows, more than a fit used to take: units are numpy's quantiles of all good ones, and no other score is a better line."""
    n = 22_000
    counted = spark.range(0, 2 * n, 2).selectExpr("id as doc_id", "false as held_out", "100 + pmod(xxhash64(id), 900) as n_words").selectExpr(
        "*", "n_words * 5 + pmod(xxhash64(doc_id, 1), 800) as word_chars", "pmod(xxhash64(doc_id, 2), 9) as n_symbols", "0L as n_dup_lines", "0L as n_repeat_words", "pmod(xxhash64(doc_id, 3), 200) as n_capitals", "pmod(xxhash64(doc_id, 4), 90) as n_digits",
        "pmod(xxhash64(doc_id, 5), 150) + if(doc_id % 23 = 0, 200, 0) as n_marks", "0L as n_same_words", "5L as n_lines")
    labels = spark.range(0, 2 * n, 2).selectExpr("id as doc_id", "int(id % 23 != 0) as quality")
    forest = qr.fit(counted, labels)
    found = counted.join(labels, "doc_id").toPandas()
    rows, good = qr.shares(found[list(qr.COUNTS)].to_numpy()), found["quality"].to_numpy() > 0
    low, middle, high = np.quantile(rows[good], [0.002, 0.5, 0.998], axis=0)
    assert np.allclose(forest.middle, middle, atol=1e-12) and np.allclose(forest.unit, np.maximum((high - low) / 2, qr.LEAST_UNIT), atol=1e-12)
    scores = qr.anomaly(forest, forest.scaled(rows))
    lines = np.unique(scores)
    lost = [1 - np.searchsorted(np.sort(scores[good == kind]), lines, side="right") / (good == kind).sum() for kind in (True, False)]
    gains = lost[1] - qr.GOOD_WEIGHT * lost[0]
    assert forest.line in lines and gains[np.searchsorted(lines, forest.line)] >= gains.max() - 1e-12


def test_each_tree_draws_from_all_rows(spark):
    known = spark.range(5000).selectExpr("id as doc_id", *[f"id as {c}" for c in qr.COUNTS])
    drawn = qr.draw(known, 5000, trees=60, sample=64)
    assert len(drawn) == 60 and all(len(set(x[:, 0])) == len(x) == 64 for x in drawn)
    assert len(set(np.concatenate(drawn)[:, 0])) > 2300 and abs(np.concatenate(drawn)[:, 0].mean() - 2500) < 120
    few = qr.draw(known.where("doc_id < 9"), 9, trees=3, sample=64)
    assert [sorted(x[:, 0]) for x in few] == [list(range(9))] * 3
