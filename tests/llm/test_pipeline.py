import random

import corpus_pipeline
import __spark_entry__ as entry
from tidegrid.llm.queries import ORACLE_SQL, QUERIES


def test_stages_keep_columns_and_take_effect(spark, odd_docs, tmp_path):
    rng = random.Random(0)
    text = lambda n: " ".join(rng.choice(["the", "and", "ther", "ing"]) + str(rng.choice("abcdefghij")) for _ in range(n))
    near = text(200).split()
    passage = text(30)
    rows = [(i, text(60)) for i in range(20)] + [(30, rows_text := text(50)), (31, rows_text), (40, " ".join(near)), (41, " ".join(near[:199] + ["zz"])), (50, text(20) + " " + passage + " " + text(20)), (60, "123 !!"), (61, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = lambda df: {r.doc_id for r in df.collect()}
    gone = [{60, 61}, {30}, {41}, {50}]
    left = ids(docs)
    for (name, stage), drop in zip(corpus_pipeline.STAGES[:-1], gone, strict=True):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        assert out.columns == docs.columns
        docs, left = spark.read.parquet(f"{tmp_path}/{name}"), left - drop
        assert ids(docs) == left, name
    assert ids(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))) == left


def test_run_on_odd_documents(spark, odd_docs, tmp_path):
    """Nulls, empty and very long texts, repeats and clashing columns go through all stages; what is left is packed whole."""
    extra = spark.createDataFrame([(None, "some words of no one's document at all", "en", "s", 1, "x", 1, 2, 3, 4, True, 5, 6), (70, "repeated as it is with seven words", None, None, None, None, None, None, None, None, None, None, None)], odd_docs.schema)
    odd_docs.unionByName(extra).unionByName(extra.where("doc_id = 70")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "repeated passages"), (2, None), (None, "x"), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    # With one language learned only texts without letters go; of "one two" the larger id stays, of equal words the smaller.
    assert ids & {0, 1, 2, 8} == set() and {None, 4, 5, 6, 9, 70} <= ids and not ids & {3, 7}
    assert sum(r.doc_id == 70 for r in out) == 2 and all(r.offset + r.length <= 4096 for r in out)
    taken = {}
    for r in out:
        taken.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in taken.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length


def test_run_on_an_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_are_registered():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names) and {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(ORACLE_SQL) <= set(entry.oracle_sql())
