"""Lists of the n-gram join: a pair that shares many of them is told once, and the index goes in passes."""

from weftline.llm import ngram_join


def test_a_pair_in_many_lists_passes_once(spark):
    brief = [0] * ngram_join.BRIEF
    nodes = spark.createDataFrame([(x, 10, brief) for x in range(1, 5)], "node long, n long, brief array<long>")
    # 40 lists hold 1, 2 and 3, each with another stranger, so that no two lists have the same members; 4 meets only 1.
    rows = [(key, x, x, 4) for key in range(40) for x in (1, 2, 3)] + [(99, 1, 1, 2), (99, 4, 4, 2)]
    met = ngram_join.members_met(spark.createDataFrame(rows, "key long, node long, component long, k long"), nodes, 75)
    assert sorted(map(tuple, met.collect())) == [(1, 2), (1, 3), (1, 4), (2, 3)]


def test_a_pair_without_a_named_list_in_common_is_not_lost(spark):
    brief, many = [0] * ngram_join.BRIEF, ngram_join.NAMED_LISTS
    nodes = spark.createDataFrame([(x, 10, brief) for x in (1, 2)], "node long, n long, brief array<long>")
    # Each names its own lists first; what they share comes after.
    rows = [(k, 1, 1, 2) for k in range(many)] + [(k, 2, 2, 2) for k in range(many, 2 * many)] + [(1000, x, x, 2) for x in (1, 2)]
    met = ngram_join.members_met(spark.createDataFrame(rows, "key long, node long, component long, k long"), nodes, 75)
    assert {tuple(r) for r in met.collect()} == {(1, 2)}


def test_the_index_goes_in_passes_that_share_no_key(spark):
    texts = spark.createDataFrame([(i, " ".join(f"w{i % 3}x{k}" for k in range(60))) for i in range(12)] + [(50 + i, " ".join(f"w{i % 3}x{k}" for k in range(61))) for i in range(6)], "id long, text string")
    sets = ngram_join.summarize(texts, ngram_join.Plan(75), 5, 0, ngram_join.np.zeros(0, ngram_join.np.uint64))
    lists = ngram_join._lists(sets.where("dear IS NOT NULL"))
    keys = [{r["key"] for r in f.select("key").distinct().collect()} for f in lists]
    assert len(lists) == ngram_join.PASSES + 1 and sum(map(len, keys)) == len(set().union(*keys)) > 0
    assert sum(1 for k in keys if k) > 1
    ngram_join.discard(*lists)
