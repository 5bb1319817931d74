"""Rows without an id: every operator gives them a row or a decision of their own."""

import pytest

from tidegrid.llm import decontaminate, exact_dedup, language, near_dedup, packing, token_files, toxicity, url_filter, warc
from tidegrid.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, "some text of more than five words here", None), (None, None, None), (1, "some text of more than five words here", "en"), (2, "other words", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_null_ids(spark, docs):
    labels = spark.createDataFrame([(None, 1), (1, None), (1, 1), (2, 0), (1, 0)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(None, "some text of more than five words here"), (5, None), (6, "some text of more than five words")], "item_id long, text string")
    assert exact_dedup.exact_dedup(docs).count() == 4 and exact_dedup.drop_exact_duplicates(docs).count() == 3
    near = near_dedup.near_dedup(docs).collect()
    assert len(near) == 4 and [r.component_id for r in near if r.doc_id == 1] == [1]
    assert near_dedup.drop_near_duplicates(docs).count() == 4
    assert language.identify(docs).count() == 4 and toxicity.toxicity(docs, labels).count() == 4
    assert {r.doc_id for r in decontaminate.contaminated(docs, bench).collect()} == {None, 1} and decontaminate.drop_contaminated(docs, bench).count() == 2
    assert packing.pack(docs, tokenizer_file("word_bpe_49k.json")).count() == 4 and token_files.round_trip(docs, tokenizer_file("byte_bpe_50k.json")).count() == 4
    pages = docs.selectExpr("doc_id as page_id", "text as html", "'http://a.com/en/' as url")
    assert warc.round_trip(pages).count() == 4
    rules = spark.createDataFrame([("com/en/", "block"), (None, "allow")], "entry string, action string")
    assert url_filter.url_filter(pages, rules).where("verdict = 'block'").count() == 4
