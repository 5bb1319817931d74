import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidegrid.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, text, lang, source, n = row
    fields = [doc_id, source, lang, None if n is None else n + more, text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        out += [(level[j], j < i) for j in [i ^ 1] if j < len(level)] or [None]
        i //= 2
    return out


def brute(rows, tampered):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    key = lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))
    groups = [sorted((r for r in rows if r[2] == lang), key=key) for lang in langs]
    trees = [tree([leaf_of(r) for r in g]) for g in groups]
    top = tree([t[-1][0] for t in trees]) if trees else []
    out = []
    for k, (g, t) in enumerate(zip(groups, trees, strict=True)):
        for i, r in enumerate(g):
            path = siblings(t, i) + siblings(top, k)
            fold = leaf_of(r, 1) if tampered(r[0]) else t[0][i]
            for s in path:
                fold = h(fold) if s is None else h(s[0], fold) if s[1] else h(fold, s[0])
            out.append((r[0], t[0][i], t[-1][0], top[-1][0], h(*(s[0] for s in path if s)), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0


def proved(df, **options):
    more = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.manifest(df, shown={"n_chars": more}, **options)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("block,fan", [(4096, 64), (4, 2), (8, 3)])
def test_equals_brute_force(spark, monkeypatch, block, fan):
    monkeypatch.setattr(merkle, "BLOCK", block)
    monkeypatch.setattr(merkle, "FAN", fan)
    rng = random.Random(block)
    rows = [(i, f"text é {i}", rng.choice(["en", "en", "en", "de", None, "zß", ""]), None if i % 11 == 0 else f"s{i % 3}", None if i % 13 == 0 else i) for i in range(150)]
    rows += [(500 + i, "alone", f"lang{i}", "s", 1) for i in range(30)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", idx int, leaf string").repartition(7)
    assert got(proved(df)) == brute(rows, tampered)


def test_repeated_rows_null_ids_and_one_row(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 2)
    rows = [(3, "a", "en", "s", 1)] * 3 + [(3, "b", "en", "s", 1), (None, None, None, None, None), (None, "x", None, "s", 2), (7, "", "de", "", 0)]
    assert got(proved(spark.createDataFrame(rows, SCHEMA))) == brute(rows, tampered)
    assert got(proved(spark.createDataFrame(rows[:1], SCHEMA))) == brute(rows[:1], tampered)


def test_proof_lists_the_siblings(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(5)]
    found = {r.doc_id: r for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA), proofs=True).collect()}
    levels = tree([leaf_of(r) for r in rows])
    assert all(r.verified and r.root == levels[-1][0] for r in found.values())
    assert found[4].proof == [levels[2][0]] and found[0].proof == [levels[0][1], levels[1][1], levels[2][1]]


def test_odd_and_empty(spark, odd_docs, no_docs):
    assert proved(no_docs).collect() == []
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd_docs.collect()]
    assert got(proved(odd_docs)) == brute(rows, tampered)


def test_joining_is_associative():
    rng = random.Random(1)
    nodes = [((0, 9, 0, i), h(str(i))) for i in range(9)] + [((1, 4, 0, i), h("b", str(i))) for i in range(4)]
    want = h(tree([d for _, d in nodes[:9]])[-1][0], tree([d for _, d in nodes[9:]])[-1][0])
    for _ in range(20):
        rng.shuffle(nodes)
        a, b, c = nodes[:4], nodes[4:9], nodes[9:]
        left = merkle.join(merkle.join(merkle.join({}, a, 2), b, 2), c, 2)
        right = merkle.join(merkle.join({}, a, 2), merkle.join(merkle.join({}, b, 2), c, 2).items(), 2)
        assert left == right == {(merkle.TOP, 2, 1, 0): want}
