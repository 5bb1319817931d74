import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidegrid.llm import components, exact_dedup, near_dedup
from tidegrid.llm.shingles import shingle_sets, word_hashes


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """component of each id by the contract's text."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}


def check_near(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_dedup(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_exact(spark, odd_docs, no_docs):
    got = exact_dedup.exact_dedup(odd_docs).collect()
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    for r in got:
        same = [i for i, t in rows if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256]
        assert r.keep_id == max(same) and r.group_size == len(same) and r.kept == (r.doc_id == r.keep_id)
    assert len(got) == len(rows) and exact_dedup.exact_dedup(no_docs).count() == 0
    kept = exact_dedup.drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {r.keep_id for r in got}


def test_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(7, "a"), (8, "c"), (9, "c")], "doc_id long, text string")
    assert exact_dedup.exact_dedup(first, index).where("kept").count() == 2
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(second, index).collect()}
    assert got == {7: (1, False), 8: (9, False), 9: (9, True)} and index.entries().count() == 3


def test_index_reopens(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = exact_dedup.DigestIndex(spark, path=path, buckets=3)
    assert exact_dedup.exact_dedup(docs((1, "a"), (2, "b")), first).where("kept").count() == 2
    spark.sql(f"drop table {first.name}")  # as in a session with another catalog; an external table's data stays
    for index in (exact_dedup.DigestIndex(spark, path=path), exact_dedup.DigestIndex(spark.newSession(), path=path, name="digest_by_name")):
        assert index.buckets == 3 and index.entries().count() == 2
    by_name = exact_dedup.DigestIndex(spark, name="digest_by_name")
    assert [(r.keep_id, r.kept) for r in exact_dedup.exact_dedup(docs((9, "a")), by_name).collect()] == [(1, False)]
    assert exact_dedup.exact_dedup(docs((9, "c")), by_name).where("kept").count() == 1
    assert exact_dedup.DigestIndex(spark, path=path).entries().count() == 3
    for wrong in ({"name": "digest_by_name", "path": f"file://{tmp_path}/other"}, {"path": path, "buckets": 7}):
        with pytest.raises(ValueError):
            exact_dedup.DigestIndex(spark, **wrong)
    by_name.drop()
    assert not (tmp_path / "index").exists()


def test_arrival_that_died_is_added_again(spark, tmp_path, monkeypatch):
    index = exact_dedup.DigestIndex(spark, path=f"file://{tmp_path}/index", buckets=2)
    rows = spark.createDataFrame([(i, f"text {i // 2}") for i in range(20)], "doc_id long, text string")
    whole = exact_dedup.DigestIndex._append

    def half(self, df):
        whole(self, df.where("keep_id < 10"))
        raise OSError("lost")

    monkeypatch.setattr(exact_dedup.DigestIndex, "_append", half)
    with pytest.raises(OSError):
        index.add(rows, arrival="monday")
    monkeypatch.undo()
    assert index.entries().count() == 5
    got = exact_dedup.exact_dedup(rows, index, arrival="monday").where("kept").collect()
    assert {r.doc_id for r in got} == {2 * i + 1 for i in range(10)} and index.entries().count() == 10
    assert exact_dedup.exact_dedup(rows, index, arrival="tuesday").where("kept").count() == 0


def test_two_arrivals_at_once(spark, tmp_path, monkeypatch):
    """Both decide what is new before either has appended; the text stays once, and later arrivals see one row of it."""
    index = exact_dedup.DigestIndex(spark, path=f"file://{tmp_path}/index", buckets=2)
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    whole, inner = exact_dedup.DigestIndex._append, []

    def append(self, df):
        if not inner:
            inner.append(None)
            inner[0] = exact_dedup.exact_dedup(docs((5, "same"), (6, "b")), exact_dedup.DigestIndex(spark, path=f"file://{tmp_path}/index"), arrival="second").collect()
        whole(self, df)

    monkeypatch.setattr(exact_dedup.DigestIndex, "_append", append)
    outer = exact_dedup.exact_dedup(docs((9, "same"), (10, "c")), index, arrival="first").collect()
    monkeypatch.undo()
    kept = sorted((r.doc_id, r.keep_id) for r in [*outer, *inner[0]] if r.kept)
    assert kept == [(5, 5), (6, 6), (10, 10)] and [r.keep_id for r in outer if r.doc_id == 9] == [5]
    later = exact_dedup.exact_dedup(docs((20, "same")), index).collect()
    assert [(r.keep_id, r.kept) for r in later] == [(5, False)] and index.entries().count() == 3


def test_compaction_keeps_every_text(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, path=f"file://{tmp_path}/index", buckets=2)
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    for k in range(4):
        exact_dedup.exact_dedup(docs(*[(10 * k + i, f"t{k + i}") for i in range(5)]), index, arrival=f"a{k}").collect()
    before = sorted(map(str, index.entries().collect()))
    files = lambda: len(list((tmp_path / "index").glob("*.parquet")))
    many = files()
    index.compact()
    assert files() > many  # young files stay for those who read them
    index.compact(min_age_s=0)
    assert files() <= 2 and sorted(map(str, index.entries().collect())) == before and len(before) == 8
    assert exact_dedup.exact_dedup(docs((99, "t0"), (98, "new")), index).where("kept").count() == 1


def test_near_odd_texts(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = near_dedup.near_dedup(odd_docs).collect()
    want = brute(dict(rows).items())
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert near_dedup.near_dedup(no_docs).count() == 0
    kept = near_dedup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_near_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"t{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(70)]
    rows, base = [], []
    for i in range(160):
        kind = i % 4
        if kind == 0 or not base:
            w = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 8, 40, 300]))]
            base.append(w)
        elif kind == 1:  # near and not so near copies, also of copies
            w = list(rng.choice(base))
            for _ in range(rng.randrange(0, 1 + len(w) // 20)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            base.append(w)
        elif kind == 2:  # much of the text is a passage that many share
            w = passage + [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        else:
            w = rng.choice(base)[: rng.randrange(1, 400)]
        rows.append((1000 - i, " ".join(w)))
    check_near(spark, rows)


def test_threshold_is_exact(spark):
    a = [f"a{i}" for i in range(25)]  # 21 shingles
    close = a[:22] + ["x", "y", "z"]  # 18 shared of 24: exactly 75 %
    far = a[:21] + ["x", "y", "z", "q"]
    assert shingles(" ".join(a)) & shingles(" ".join(close))
    check_near(spark, [(1, " ".join(a)), (2, " ".join(close)), (3, " ".join(far))])


def test_bounds_reach_every_link_of_whole_sketches(spark):
    sizes = [(n, m) for n in range(1, near_dedup.K + 1) for m in range(-(-75 * n // 100), n + 1)]
    df = spark.createDataFrame(sizes, "n long, m long")
    n, m = F.col("n"), F.col("m")
    for r in df.select("n", "m", near_dedup.least(n).alias("ln"), near_dedup.least(m).alias("lm"), near_dedup.needed(n, m).alias("need")).collect():
        common = -(-75 * (r.n + r.m) // 175)  # least of a link
        if common <= r.m:
            assert max(r.ln, r.lm) <= common and r.need <= common, r


def test_copies_at_the_threshold(spark):
    rows = []
    for n in [*range(1, 60, 7), *range(90, 176)]:
        least = -(-75 * n // 100)
        for k, m in enumerate((least, least + 1, least - 1)):  # the longer text's own shingles are the rarest
            w = [f"n{n}k{k}w{i}" for i in range(n + 4)]
            rows += [(10 * n + 2 * k, " ".join(w[: m + 4])), (10 * n + 2 * k + 1, " ".join(w))]
    check_near(spark, rows)


def test_shingle_kernel_matches_words():
    import numpy as np

    texts = ["", "a", "A b\tc\x0bd\x0ce f", "é É x y z", " lead and trail here now ", "a a a a a a a a"]
    data = [t.encode() for t in texts]
    offs = np.cumsum([0] + [len(d) for d in data])
    got = shingle_sets(np.frombuffer(b"".join(data), np.uint8), offs)
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    alone = [shingle_sets(np.frombuffer(d, np.uint8), np.array([0, len(d)]))[0] for d in data]
    assert all((x == y).all() for x, y in zip(got, alone))
    assert np.diff(word_hashes(np.frombuffer(b"".join(data), np.uint8), offs)[1]).tolist() == [len(words(t)) for t in texts]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 80), (80, 100), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {80: 80, 90: 80, 100: 80, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
