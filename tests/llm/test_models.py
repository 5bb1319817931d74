import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from tidegrid.llm import decontaminate, language, toxicity


def fold(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


LANGS = {"aa": "the and ing ion ther with from", "bb": "der und sch ein keit ung über", "cc": "les des eau oux être aux é"}
INSULTS = ["grumpfel", "snarkle", "blorgtop"]


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        parts = LANGS[lang].split()
        w = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 3))) for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS) + rng.choice(["", "ing"]))
        rows.append((i, " ".join(w), lang, "s", 0))
        labels.append((i, int(toxic)))
    return rows, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_on_held_out(spark, odd_docs, no_docs):
    rows, _ = corpus()
    got = language.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    truth = {r[0]: r[2] for r in rows}
    out = [r for r in got if r.held_out]
    assert len(got) == 600 and all(r.held_out == fold(r.doc_id) for r in got) and out
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in language.identify(odd_docs).collect()}
    assert {i for i, r in odd.items() if r.lang_pred == "und"} == {0, 1, 2, 8}
    assert language.identify(no_docs).count() == 0
    kept = language.keep_identified(odd_docs, language.fit(odd_docs))
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, 9}


def test_held_out_labels_are_never_used(spark):
    rows, _ = corpus(200)
    spoiled = [(i, t, "zz" if fold(i) else lang, s, n) for i, t, lang, s, n in rows]
    a = language.fit(spark.createDataFrame(rows, SCHEMA))
    b = language.fit(spark.createDataFrame(spoiled, SCHEMA))
    assert a.langs == b.langs and np.array_equal(a.log_p, b.log_p)
    c = language.fit(spark.createDataFrame([(i, t, None, s, n) for i, t, _, s, n in rows], SCHEMA))
    assert c.langs == []


def test_texts_stay_where_no_language_is_learned(spark):
    rows = [(1, "a plain text", None), (2, "12 34 !!", None), (3, None, None), (4, "", None), (5, "жёлтый " * 300_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = language.keep_identified(docs, language.fit(docs))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {1, 5}


def test_language_score_does_not_depend_on_neighbours():
    model = language.LanguageModel(["a", "b"], np.log(np.random.default_rng(0).random((2, 3 << language.BUCKET_BITS))), np.log([0.5, 0.5]))
    texts = ["abc def", "", "x", "日本語 text", "é" * 50, "word " * 3000]
    whole = language.score_texts(model, pa.array(texts))
    for i, t in enumerate(texts):
        alone = language.score_texts(model, pa.array([t]))
        assert alone[0][0] == whole[0][i] and np.isclose(alone[1][0], whole[1][i])
    old, language.CHUNK_CHARS = language.CHUNK_CHARS, 64
    try:
        pieces = language.score_texts(model, pa.array(texts))
    finally:
        language.CHUNK_CHARS = old
    assert pieces[0] == whole[0] and np.allclose(pieces[1], whole[1])


def test_late_windows_are_learned(monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_WINDOWS", 40)
    rng = random.Random(3)
    plain = lambda: ["".join(rng.choice("aeioulmnr") for _ in range(6)) for _ in range(20)]
    docs = []
    for i in range(200):  # later documents have another insult
        docs += [([*plain(), "grumpfel" if i < 100 else "xyzzkht", *plain()], 1), (plain(), 0)]
    model = toxicity.fit_chain(docs)
    assert abs(model.word_score("grumpfel") - model.word_score("xyzzkht")) < 1 < model.word_score("xyzzkht")


def test_marginals_are_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 3)
    rng = np.random.default_rng(4)
    transition, lengths = np.log([[0.9, 0.1], [0.4, 0.6]]), np.array([4, 0, 7, 1, 3])
    scores = 2 * rng.normal(size=lengths.sum())
    got, at = toxicity.marginals(scores, lengths, transition), 0
    for n in lengths:
        e, total, want = scores[at : at + n], 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=int(n)):
            p, prev = 1.0, 0
            for t, s in enumerate(path):
                p, prev = p * np.exp(transition[prev, s] + s * e[t]), s
            total, want = total + p, want + p * np.array(path)
        assert np.allclose(got[at : at + n], want / total)
        at += n


def test_toxicity_on_held_out(spark, odd_docs, no_docs):
    rows, labels = corpus()
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    truth, text = dict(labels), {r[0]: r[1] for r in rows}
    assert len(got) == 600 and np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out]) > 0.95
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == fold(r.doc_id)
        for b, e in zip(r.span_begins, r.span_ends, strict=True):
            assert any(text[r.doc_id][b:e].startswith(x) for x in INSULTS)
    flipped = spark.createDataFrame([(i, 1 - t if fold(i) else t) for i, t in labels], "doc_id long, toxic int")
    a, b = toxicity.fit(docs, known), toxicity.fit(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.calibration, b.calibration)
    odd = toxicity.predict(odd_docs, a).collect()
    assert len(odd) == 12 and all(r.score is not None for r in odd)
    assert toxicity.toxicity(no_docs, known.limit(0)).count() == 0 and {r.score for r in toxicity.toxicity(odd_docs, known.limit(0)).collect()} == {0.0}


def edit_distance_within(item, text):
    """Least edits of item against any part of text."""
    row = [0] * (len(text) + 1)
    for j, c in enumerate(item, 1):
        new = [j]
        for i, t in enumerate(text, 1):
            new.append(min(row[i - 1] + (c != t), row[i] + 1, new[i - 1] + 1))
        row = new
    return min(row)


def plain(text):
    return " ".join((text or "").lower().split())


def test_decontamination_against_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(2)
    letters = "abcdefgh  "
    items = [(k, "".join(rng.choice(letters) for _ in range(rng.choice([30, 60, 120]))).strip() + "x") for k in range(8)] + [(90, None), (91, "short"), (92, "")]
    rows = []
    for i in range(60):
        body = ["".join(rng.choice(letters) for _ in range(150)) for _ in range(2)]
        k, x = items[i % 8]
        y = list(x.upper() if i % 3 else x)
        for _ in range(i % 12):
            p = rng.randrange(len(y))
            y[p : p + rng.randrange(0, 2)] = rng.choice(["", "q", "z"])
        rows.append((i, body[0] + " \n " + "".join(y).replace(" ", "  ") + " " + body[1] if i % 5 else body[0]))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in rows:
        for k, x in items[:8]:
            p = plain(x)
            d, e = edit_distance_within(p, plain(t)), decontaminate.edit_budget(len(p))
            assert ((i, k) in got) == (d <= e)
            if d <= e:
                assert got[i, k].edits == d and edit_distance_within(p, plain(t[got[i, k].begin : got[i, k].end])) == d
    bench = spark.createDataFrame([(1, "w7x7 w8x8 w9x9 w10x10 w11x11 w12x12")], "item_id long, text string")
    kept = decontaminate.drop_contaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == set(range(10)) - {5}
    assert decontaminate.contaminated(no_docs, bench).count() == 0 and decontaminate.drop_contaminated(odd_docs, bench.limit(0)).count() == 12


def test_items_in_blocks(spark):
    items = spark.createDataFrame([(k, f"item number {k} " + "abcdefghij" * 5 + str(k) * 20) for k in range(20)], "item_id long, text string")
    blocks = list(decontaminate.item_blocks(items, block_chars=300))
    assert len(blocks) > 3 and sorted(i for b, _ in blocks for i in b.ids) == list(range(20)) and [last for _, last in blocks] == [False] * (len(blocks) - 1) + [True]
    rows = [(k, f"before {r.text} after") for k, r in enumerate(items.collect()[:7])] + [(50, "nothing of them here"), (None, "item number 3 " + "abcdefghij" * 5 + "3" * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = (sorted(map(str, decontaminate.contaminated(docs, items, block_chars=n).collect())) for n in (10**6, 300))
    assert one == many and len(one) >= 8
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items, block_chars=300).collect()] == [50]


def test_short_items_between_word_boundaries():
    index = decontaminate.build_index([(1, "yes"), (2, "a  b"), (3, "exactly twelve"), (4, "ab"), (5, " "), (6, "!?")])
    got = decontaminate.matches(index, ["Yes yesterday a b. exactly  Twelve", "yesab", "ab", "", "what!?"])
    assert got == [(0, 1, 0, 3, 0), (0, 2, 14, 17, 0), (0, 3, 19, 34, 0), (2, 4, 0, 2, 0), (4, 6, 4, 6, 0)]


def test_items_of_every_length():
    """Edits a tenth of the characters from 10 on, with no other rule; without edits as whole words."""
    rng = random.Random(8)
    letters = "abcdef gh"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = [(m, "x" + word(m - 2).replace("  ", "ab") + "y" if m > 1 else "q") for m in range(1, 121)]
    index = decontaminate.build_index(items)
    assert all(len(plain(t)) == len(c) for (_, t), c in zip(items, index.codes, strict=True))
    rows, want = [], []
    for m, t in items:
        for edits in (0, m // 10, m // 10 + 1, m // 10 + 2):
            y = list(t)
            for p in rng.sample(range(len(y)), min(edits, len(y))):
                y[p] = "Z"
            rows.append(f"{word(40)}{rng.choice([' ', 'k', ', '])}{''.join(y)}{rng.choice([' ', 'k', '.'])}{word(30)}")
            want.append(m)
    got = {(r, i): e for r, i, _, _, e in decontaminate.matches(index, rows)}
    for r, (text, own) in enumerate(zip(rows, want, strict=True)):
        for m in {own, max(1, own - 1), 12, 23, 24, 79, 80}:
            item = plain(items[m - 1][1])
            if m < 10:
                found = 0 if re.search(rf"(?<![a-z0-9]){re.escape(item)}(?![a-z0-9])", plain(text)) else None
            else:
                d = edit_distance_within(item, plain(text))
                found = d if d <= m // 10 else None
            assert got.get((r, m)) == found, (r, m, text)


def test_equal_items_cost_as_one():
    items = [(i, "Same short  text") for i in range(1000)] + [(2000, "same short text"), (2001, "tiny"), (2002, "tiny")]
    index = decontaminate.build_index(items)
    assert len(index.codes) == 2 and len(index.ids) == 1003
    got = decontaminate.matches(index, ["a same short text b tiny", "none"])
    assert [g[1] for g in got] == [*range(1000), 2000, 2001, 2002] and {g[0] for g in got} == {0} and len(decontaminate.matches(index, ["same shortt text"])) == 1001


def test_items_that_share_a_template(monkeypatch):
    rng = random.Random(4)
    w = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    template = w(20)[:100]
    items = [(i, f"{template} {w(20)[:100]}") for i in range(60)]
    near = items[9][1][:150] + "qqq" + items[9][1][153:]
    text = f"{w(200)} {items[3][1]} {template} {w(50)} {near} {template}"
    index = decontaminate.build_index(items)
    got = decontaminate.matches(index, [text])
    assert [(i, edits) for _, i, _, _, edits in got] == [(3, 0), (9, 3)]
    monkeypatch.setattr(decontaminate, "SLICE_HITS", 50)
    monkeypatch.setattr(decontaminate, "SLICE_CELLS", 50)
    assert decontaminate.matches(index, [text]) == got


def test_chain_gradient_against_brute_force():
    rng = np.random.default_rng(3)
    scores, lengths, transition = rng.normal(size=9), np.array([4, 0, 5]), rng.normal(size=(2, 2))
    expected = np.zeros((2, 2))
    p = toxicity.marginals(scores, lengths, transition, expected)
    unary, pairs, at = np.zeros(9), np.zeros((2, 2)), 0
    for n in lengths.tolist():
        total, u, q = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            path = (0, *y)
            weight = math.exp(sum(transition[a, b] for a, b in zip(path, y)) + sum(scores[at + i] for i, b in enumerate(y) if b))
            total += weight
            u += weight * np.array(y)
            q += weight * toxicity.steps(np.array(y, bool), np.array([n])) if n else 0
        unary[at : at + n], pairs, at = u / total, pairs + q / total, at + n
    assert np.allclose(p, unary) and np.allclose(expected, pairs)


def test_token_labels_by_definition():
    clean = [([f"c{i}", "calm", f"d{i}"], 0) for i in range(40)]
    toxic = [([f"e{i}", "vile", f"f{i}", "calm"], 1) for i in range(40)] + [(["same", "copy", "again"], 1)] * 40
    labels = toxicity.token_labels(clean + toxic)
    for (words, y), marks in zip(clean + toxic, labels):
        assert marks.tolist() == [bool(y) and w == "vile" for w in words]


def test_contradicting_and_repeated_labels(spark):
    own = lambda i: "".join("abcdefghij"[int(c)] for c in str(i % 40))
    docs = spark.createDataFrame([(i, f"e{own(i)} vile f{own(i)} calm words" if i % 2 else f"c{own(i)} calm d{own(i)} words") for i in range(400)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(i, 0) for i in range(400)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[i] == i % 2 for i in range(400)) and toxicity.toxicity(docs, labels).count() == 800


def test_naive_bayes_scores_in_plain_python(spark):
    """Posterior of every text, held out or not, from hashed counts smoothed by 0.1, without numpy or the module's own steps."""
    rng = random.Random(6)
    syllables = {"en": ["th", "ing", "er", "on"], "de": ["sch", "ung", "ei", "ü"], "fr": ["eau", "ê", "tion", "ou"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[y]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 12))) + rng.choice(["!", " 12", ""]), y) for i in range(60) for y in [rng.choice(list(syllables))]]
    rows += [(90, "Ünder THE Eau", None), (91, "ß𐐀", "de"), (92, "", "fr")]

    def grams(text):
        codes = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
        out = []
        for n in (1, 2, 3):
            for k in range(len(codes) - n + 1):
                run = codes[k : k + n]
                if any(run):
                    h = 0
                    for c in run:
                        h = (h * 0x9E3779B1 + c + 1) & 0xFFFFFFFF
                    h = h * 0x85EBCA6B & 0xFFFFFFFF
                    h = (h ^ h >> 15) * 0xC2B2AE35 & 0xFFFFFFFF
                    out.append((n, h >> 17))
        return out

    learned = [(t, y) for i, t, y in rows if y and zlib.crc32(str(i).encode()) % 4 != 2]
    counts = {y: collections.Counter(g for t, z in learned if z == y for g in grams(t)) for y in syllables}
    sums = {y: {n: sum(v for (m, _), v in c.items() if m == n) for n in (1, 2, 3)} for y, c in counts.items()}
    prior = collections.Counter(y for _, y in learned)
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    for i, t, _ in rows:
        log = {y: math.log(prior[y] / len(learned)) + sum(math.log((counts[y][g] + 0.1) / (sums[y][g[0]] + 0.1 * 2**15)) for g in grams(t)) for y in syllables}
        best = max(sorted(log), key=log.get)
        if any(c.isalpha() for c in t):
            assert got[i].lang_pred == best and abs(got[i].score - 1 / sum(math.exp(v - log[best]) for v in log.values())) < 1e-9
        else:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)


def test_naive_bayes_by_definition(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("the house of the king", "en"), ("la maison du roi", "fr"), ("der hund und die katze", "de"), ("das haus des koenigs", "de")] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    learned = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    got = {r.doc_id: r.lang_pred for r in language.identify(docs).collect()}
    grams = lambda t: [f" {t} "[i : i + k] for k in (1, 2, 3) for i in range(len(t) + 3 - k)]
    counts = {lang: collections.Counter(g for t, y in learned if y == lang for g in grams(t)) for lang in ("de", "en", "fr")}
    vocab = len({g for c in counts.values() for g in c})
    prior = collections.Counter(y for _, y in learned)
    for i, t, _ in rows:
        post = {y: math.log(prior[y]) + sum(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * vocab)) for g in grams(t)) for y, c in counts.items()}
        assert got[i] == max(sorted(post), key=post.get)
    assert model is not None
