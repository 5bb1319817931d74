import math
import re
import zlib
from collections import Counter
from hashlib import sha256

from tidegrid.llm import resampling


def brute(docs, target, max_n=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def grams(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(g for _, x in docs for g in grams(x)), Counter(g for x in target for g in grams(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in s}
    rows = []
    for i, x in docs:
        g = grams(x)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)) >= min_words])
    may = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    docs = [(i, " ".join(f"{'Ab' if j % 3 else 'É'}{(i * j) % (17 + i)}" for j in range(i % 60))) for i in range(150)] + [(7, "a b c"), (None, "x " * 30), (None, None), (200, None), (201, ""), (202, "!! ... 12")]
    target = ["Ab1 Ab2 ab3", "é4 É5", None, ""]
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, bucket string, score int")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(resampling.resample(df, aim)) == brute(docs, target)
    assert got(resampling.resample(df, aim, max_n=3, buckets=97, percent=50, min_words=5)) == brute(docs, target, 3, 97, 5, 50)


def test_repeated_rows_and_long_texts(spark):
    docs = [(i % 3, "same words again " * 20) for i in range(40)] + [(9, " ".join(f"w{i}" for i in range(60_000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    aim = spark.createDataFrame([("same again",)], "text string")
    found = resampling.resample(df, aim, percent=50).collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in found) == sorted(r[:4] for r in brute(docs, ["same again"], percent=50))
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 21))


def test_empty(spark, no_docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(no_docs, none).collect() == []
    docs = [(i, "one two three " * 10) for i in range(10)]
    assert got(resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), none)) == brute(docs, [])


def test_odd(spark, odd_docs):
    aim = spark.createDataFrame([("the cat",)], "text string")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(resampling.resample(odd_docs, aim)) == brute(rows, ["the cat"])
