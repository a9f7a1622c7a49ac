"""Large ids beside null ones, and thresholds that the n-gram join cannot keep."""

import pytest

from weftline.llm import html_main, ngram_join

BIG = [9007199254740993, None, 9007199254740995, -(2**63), 2**63 - 1]


def test_ngram_join_keeps_large_ids_beside_nulls(spark):
    rows = spark.createDataFrame([(i, f"one two three four five six number{k // 2}") for k, i in enumerate(BIG)], "doc_id long, text string").coalesce(1)
    got = [(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(rows).collect()]
    assert sorted(got, key=repr) == sorted([(BIG[0], BIG[0]), (None, BIG[0]), (BIG[2], BIG[3]), (BIG[3], BIG[3]), (BIG[4], BIG[4])], key=repr)


def test_pages_keep_large_ids_beside_nulls(spark):
    rows = spark.createDataFrame([(i, f"http://a.example/{k}", f"<article><p>text {k}</p></article>") for k, i in enumerate(BIG)], "page_id long, url string, html string").coalesce(1)
    got = html_main.extract_main_text(rows).collect()
    assert sorted([(r["page_id"], r["text"]) for r in got], key=repr) == sorted([(i, f"text {k}") for k, i in enumerate(BIG)], key=repr)


@pytest.mark.parametrize("percent", [0, 50, 74, 101])
def test_percent_out_of_range(spark, percent):
    with pytest.raises(ValueError):
        ngram_join.jaccard_components(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), percent=percent)
