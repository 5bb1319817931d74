import subprocess
import sys
import zlib
from itertools import product
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegrid.llm import packing, range_coder, token_files, tokens
from tidegrid.llm.queries import tokenizer_file
from tidegrid.llm.tokens import PieceTokenizer

FILES = {"byte_bpe_50k.json": False, "word_bpe_49k.json": True}
ODD = ["a  b", "  a\n\n b  ", "\x1cq a\x1d", "<|endoftext|> a <|endoftext|>b", "a's 'LL 12 3½", "\n", "", "tab\tx \r\n y", "é e\u0301 ﬁ İ ẞ", "日本 語\u3000x", "😀 a\u00a0b \u0085c", "Σ ΣΣ"]


@pytest.fixture(scope="module", params=sorted(FILES))
def pair(request):
    path = tokenizer_file(request.param)
    return PieceTokenizer(path, FILES[request.param]), Tokenizer.from_file(path)


def test_ids_are_the_librarys(pair):
    ids, n = pair[0].encode(ODD)
    want = [pair[1].encode(t, add_special_tokens=False).ids for t in ODD]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


@pytest.mark.parametrize("name", sorted(FILES))
def test_forgotten_pieces_met_again(name, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 12)
    path = tokenizer_file(name)
    own, library = PieceTokenizer(path, FILES[name]), Tokenizer.from_file(path)
    many = " ".join(",".join(x) for x in product("ab", repeat=4))  # more pieces than are remembered, of few cuts
    for text in (f"“один” {many}", "“один” „два“ три", "„два“ 四 “один”", "три “один”"):
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(pair, text):
    assert pair[0].encode([text])[0].tolist() == pair[1].encode(text, add_special_tokens=False).ids


def test_simple_texts():
    simple = ["a", "a b\nc", "é, 12"]
    other = ["", " a", "a ", "\na", "a\n", "a  b", "a\n\nb", "a \nb", "a\n b", "a\tb", "a\rb", "a\0b", "a\x1cb", "a\x85b", "a\u2003b", "a\u3000b"]
    got = PieceTokenizer(tokenizer_file("byte_bpe_50k.json"), False)._simple(simple + other)
    assert got.tolist() == [True] * len(simple) + [False] * len(other)


@pytest.mark.parametrize("texts", [[], [""], ["a  b", " c", "\t"], ["\0", "x\u2003y"], ["one two\nthree", "don't\n's 12", "", "é÷ <|x|> ²", "one  two\nthree"]])
@pytest.mark.parametrize("name,words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_groups_of_simple_and_other_texts(name, words, texts):
    ids, n = PieceTokenizer(tokenizer_file(name), words).encode(texts)
    library = Tokenizer.from_file(tokenizer_file(name)).encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]] == [e.ids for e in library]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000])
@pytest.mark.parametrize("kind", ["few", "many", "one", "edges"])
def test_coder_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"few": rng.integers(0, 9, n), "many": rng.integers(0, 65536, n), "one": np.full(n, 7), "edges": rng.choice([0, 65535], n)}[kind].astype(np.uint32)
    table, codes, sums = range_coder.encode_checked(ids, block=64)
    assert np.array_equal(range_coder.decode_checked(table, codes, sums, n, block=64), ids)
    # Blocks are reset: each is decoded alone.
    for k, code in enumerate(codes):
        own = ids[k * 64 : (k + 1) * 64]
        assert np.array_equal(range_coder.decode([code], len(own), range_coder.unpack_order0(table), block=64), own)


def test_a_block_ends_with_one_word():
    # What the range still holds needs 16 bits, not 64.
    ids = np.array([7, 9] * 32, np.uint32)
    _, codes, _ = range_coder.encode_checked(ids[:1])
    assert len(codes[0]) == 2
    assert len(range_coder.encode_checked(ids)[1][0]) <= 10


def test_carries_reach_words_that_are_written():
    out = np.array([5, 65_535, 65_535, 7, 65_535, 0], np.uint16)  # two lanes, of three words each
    range_coder._carry(out, np.array([3, 5]))
    assert out.tolist() == [6, 0, 0, 8, 0, 0]


def test_coder_adapts_and_checks():
    ids = np.tile(np.arange(50, dtype=np.uint32), 200)
    table, codes, sums = range_coder.encode_checked(ids, block=4096)
    assert 8 * sum(map(len, codes)) / len(ids) < 0.6  # order 0 alone would need 5.6 bits
    bad = [codes[0][:10] + bytes([codes[0][10] ^ 1]) + codes[0][11:], *codes[1:]]
    with pytest.raises(range_coder.CorruptBlock):
        range_coder.decode_checked(table, bad, sums, len(ids), block=4096)


def test_blocks_are_long_enough_to_adapt():
    ids = np.tile(np.random.default_rng(1).permutation(1500).astype(np.uint32), 20)
    _, codes, _ = range_coder.encode_checked(ids)
    assert 8 * sum(map(len, codes)) / len(ids) < 8  # order 0 alone needs 10.6 bits; ids repeat after 1500


def test_token_files(spark, odd_docs, no_docs, tmp_path, monkeypatch):
    path = tokenizer_file("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    got = sorted(tuple(r) for r in token_files.round_trip(odd_docs, path, end_id=0, path=f"{tmp_path}/t").collect())
    at, want = 0, []
    for r in sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        ids = np.array(own.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.round_trip(no_docs, path).count() == 0


def test_segments_of_a_part(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j}" for j in range(i % 30))) for i in range(400)], "doc_id long, text string").coalesce(1)
    path = tokenizer_file("byte_bpe_50k.json")
    want = sorted(tuple(r) for r in token_files.round_trip(docs, path, path=f"{tmp_path}/whole").collect())
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        token_files.write_tokens(docs, f"{tmp_path}/cut", path, segment_ids=900)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert sorted(tuple(r) for r in token_files.read_tokens(spark, f"{tmp_path}/cut").collect()) == want
    parts: dict[int, list] = {}
    for r in spark.read.parquet(f"{tmp_path}/cut").select("part", "segment", "at", "n_ids").orderBy("part", "segment").collect():
        parts.setdefault(r.part, []).append(r)
    assert max(map(len, parts.values())) > 1
    for rows in parts.values():
        assert [r.at for r in rows] == [sum(x.n_ids for x in rows[:k]) for k in range(len(rows))]
        assert len(rows) == 1 or min(r.n_ids for r in rows) >= 900  # none is short


def test_packing(spark, odd_docs, no_docs):
    path = tokenizer_file("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    got = packing.pack(odd_docs, path).toPandas()
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = np.array(own.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(r.doc_id, i // 4096, i, len(ids[i : i + 4096]), zlib.crc32(ids[i : i + 4096].tobytes())) for i in range(0, len(ids), 4096)]
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))) == sorted(want)
    assert_packed(got.sequence_id.to_numpy(), got.offset.to_numpy(), got.length.to_numpy())
    assert packing.pack(no_docs, path).count() == 0


def assert_packed(sequence, offset, length):
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], length[order]
    new = np.r_[True, s[1:] != s[:-1]]
    assert (o[new] == 0).all() and (o[1:][~new[1:]] == (o + n)[:-1][~new[1:]]).all() and (o + n).max() <= packing.SEQUENCE


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 4096), min_size=1, max_size=300))
def test_any_plan_is_whole(lengths):
    lengths = np.sort(np.array(lengths))
    plan = packing.plan(np.bincount(lengths, minlength=4097))
    rank = np.arange(len(lengths)) - np.searchsorted(lengths, lengths)
    sequence, offset = plan.place(lengths, rank)
    assert_packed(sequence, offset, lengths)
    assert len(np.unique(sequence)) == plan.sequences <= 1.25 * -(-lengths.sum() // 4096) + 1 + (lengths > 2048).sum()


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.lognormal(6.3, 1, 20_000).astype(int) + 1, 1, 4096)
    assert packing.plan(np.bincount(lengths, minlength=4097)).sequences <= -(-lengths.sum() // 4096) * 1.002 + 1


def test_memo_fits_beside_the_heap():
    """At 800,000 pieces two workers and a heap of 1,800 MB took more than 3,000 MB; at 400,000 an executor peaked at 2,457."""
    assert tokens.MEMO_PIECES <= 400_000


def test_long_pieces_are_not_remembered(monkeypatch):
    """Texts that the library takes whole are cuts of the memo while they are encoded, but it keeps none of them."""
    monkeypatch.setattr(tokens, "MEMO_BYTES", 20_000)
    path = tokenizer_file("byte_bpe_50k.json")
    own, library = PieceTokenizer(path, False), Tokenizer.from_file(path)
    for k in range(3):
        many = [f"{i} {k} " + "word and " * 200 + f"n{i * k}" for i in range(40)] + ["a plain text"]
        ids, n = own.encode(many)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]] == [e.ids for e in library.encode_batch(many, add_special_tokens=False)]
        assert own._cuts.nbytes <= 20_000 and "word" not in "".join(own._cuts.to_pylist())


_WORKER = """
import ctypes, pyarrow as pa, random
from tidegrid.llm import language
from tidegrid.llm.common import tidied
random.seed(1)
words = ["".join(random.choices("abcdefgh ", k=9)) for _ in range(20_000)]
batch = pa.record_batch({"lang": ["x"] * 10_000, "text": [" ".join(random.choices(words, k=400)) for _ in range(10_000)]})
used = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("RssAnon")).split()[1]) / 1024
ctypes.CDLL(None).malloc_trim(0)
before = used()
for _ in range(2):
    for _ in tidied(language._counts)(iter([batch])):
        pass
print(used() - before)
"""


def test_a_worker_gives_its_memory_back():
    """Workers are reused: what a task has freed, 41 MB here, was kept beside the next one's."""
    got = subprocess.run([sys.executable, "-c", _WORKER], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(got.stdout) < 10
