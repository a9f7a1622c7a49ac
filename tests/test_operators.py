"""Order-dependent and iterative operators against plain versions, and properties of splits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import augment, cluster, community, compare, quality, similarity, split
from weftline.operators.graph import components
from weftline.operators.index import first_seen_ids


def naive_first_fit(arrays):
    clusters = []
    for key, own in arrays:
        for c in clusters:
            if any(set(own) & set(e) for _, e in c):
                c.append((key, own))
                break
        else:
            clusters.append([(key, own)])
    return [[k for k, _ in c] for c in clusters]


def test_first_fit_equals_the_nested_loops():
    rng = random.Random(5)
    for _ in range(300):
        arrays = [(k, [rng.randrange(12) for _ in range(rng.randint(0, 3))]) for k in range(rng.randint(1, 12))]
        assert cluster.first_fit_groups(arrays) == naive_first_fit(arrays)
    assert cluster.first_fit_groups([("a", [1]), ("b", [2]), ("c", [1, 2])]) == [["a", "c"], ["b"]]


def test_rescue_moves_contained_singles():
    sets = {"a": {1}, "b": {2}, "c": {1, 2}}
    assert cluster.rescue_groups([["a", "c"], ["b"]], sets, 0.5) == [["a", "c", "b"]]
    assert cluster.rescue_groups([["a", "c"], ["b"]], sets, 0.5, most=2) == [["a", "c"], ["b"]]


@pytest.mark.parametrize(("n", "most", "want"), [(899, 300, [299, 299, 301]), (5, 1, [5]), (3, 5, [3])])
def test_forced_partition(spark, n, most, want):
    rows = spark.range(n).select(F.lit("g").alias("g"), F.col("id"))
    got = cluster.forced_partition(rows, ["g"], ["id"], most).groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in got] == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(2, 30)] + [(50, 50)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[k] for k in range(100, 141)} == {100}
    assert {got[k] for k in range(1, 30)} == {1}
    assert got[50] == 50
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_edit_distance_pairs_equal_all_pairs(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("ab c") for _ in range(rng.randint(0, 7))) for _ in range(120)}
    df = spark.createDataFrame([(w,) for w in words], "text string")
    for most in (1, 2):
        got = {(r["a"], r["b"]) for r in similarity.edit_distance_pairs(df, most).collect()}
        x, y = df.select(F.col("text").alias("a")), df.select(F.col("text").alias("b"))
        want = {(r["a"], r["b"]) for r in x.crossJoin(y).where("a < b").where(F.levenshtein("a", "b") <= most).collect()}
        assert got == want


def test_pair_stats_micro(spark):
    rows = [("Forward", "Forward"), ("Forward", "Reverse"), ("Forward", "Unknown"), ("Unknown", "Reverse"), ("Unknown", "Unknown")]
    r = compare.pair_stats(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert (r["total"], r["comparable"], r["agree"], r["disagree"], r["pct_agree"], r["pct_effective"], r["pct_coverage"], r["pct_asymmetric"]) == (5, 2, 1, 1, 50.0, 20.0, 40.0, 40.0)


def test_singleton_filter_keeps_nulls(spark):
    rows = spark.createDataFrame([("g1",), ("singleton",), (None,)], "g string")
    assert rows.where(compare.not_singleton("g")).count() == 2


def test_metrics_micro(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.3), (1, 0.3)], "y int, s double")
    r = quality.ranking_metrics(rows, "y", "s").first()
    assert (round(r["auc"], 6), round(r["average_precision"], 6)) == (0.583333, 0.755556)
    pairs = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 2)], "a int, b int")
    assert compare.adjusted_rand(pairs, "a", "b").first()["ari"] == 0.5714
    cells = spark.createDataFrame([(0, 0)] * 10 + [(0, 1)] * 20 + [(1, 0)] * 20 + [(1, 1)] * 10, "x int, y int")
    assert compare.chi_square_2x2(cells, "x", "y").first()["chi2"] == pytest.approx(5.4)


def test_early_stop_ties_do_not_improve(spark):
    rows = spark.createDataFrame([("r", k + 1, v) for k, v in enumerate([0.9, 0.8, 0.85, 0.8, 0.81])], "run string, epoch long, loss double")
    got = quality.early_stop(rows, "run", "epoch", "loss", 3).orderBy("epoch").collect()
    assert [r["improved"] for r in got] == [True, True, False, False, False]
    assert [r["stopped"] for r in got] == [False, False, False, False, True]


def test_split_sizes_and_folds(spark):
    units = [("a", "s1")] + [(f"b{k}", "s2") for k in range(2)] + [(f"c{k}", "s10") for k in range(10)]
    rows = spark.createDataFrame(units, "u string, s string")
    got = {r["stratum"]: r["n"] for r in split.stratified_holdout(rows, "u", "s", 0.1, 1).groupBy("stratum").agg(F.count_if(F.col("split") == "test").alias("n")).collect()}
    assert got == {"s1": 0, "s2": 1, "s10": 1}
    five = spark.createDataFrame([(str(k), "s") for k in range(5)], "u string, s string")
    assert sorted(r["count"] for r in split.folds(five, "u", "s", 2, 1).groupBy("fold").count().collect()) == [2, 3]


def test_subsets(spark):
    four = spark.createDataFrame([(1, ["a", "b", "c", "d"])], "id long, elements array<string>")
    assert augment.enumerate_subsets(four, 2, 3).count() == 10
    drawn = augment.random_subsets(four, 1, 20, 3).collect()
    assert all(1 <= len(r["subset"]) <= 3 and r["subset"] == sorted(r["subset"]) for r in drawn)
    assert len({r["size"] for r in drawn}) >= 2


def test_long_arrays_are_enumerated_or_an_error(spark):
    long = lambda n: spark.createDataFrame([(1, [str(k) for k in range(n)])], "id long, elements array<string>")
    assert augment.enumerate_subsets(long(13), 12).count() == 13
    with pytest.raises(Exception, match="over 20 elements: 21"):
        augment.enumerate_subsets(long(21), 20).collect()


def test_guard_distances(spark):
    c = spark.createDataFrame([(1, ["a", "b"], [])], "id long, spacers array<string>, repeats array<string>")
    h = spark.createDataFrame([(9, ["b", "c"], [])], "id long, spacers array<string>, repeats array<string>")
    tok = lambda d: d.select("id", F.explode("spacers").alias("element"))
    assert similarity.min_distance(tok(c), tok(h)).first()["distance"] == pytest.approx(2 / 3)
    assert similarity.min_distance(tok(c), tok(h), "overlap").first()["distance"] == pytest.approx(0.5)
    assert augment.guarded(c, h, 0.3).count() == 1


def test_first_seen_ids_are_dense(spark):
    rows = spark.createDataFrame([(k, str((k * 7) % 13)) for k in range(50)], "pos long, e string")
    got = first_seen_ids(rows, "e", ["pos"]).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(13))
    assert got[0]["e"] == "0" and got[1]["e"] == "7"


def test_first_seen_ids_do_not_depend_on_one_draw_of_ranges(spark):
    # With several ranges, those of the sizes were drawn anew and differed, so ids had gaps and repeats.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 60_000, numPartitions=6).select((F.col("id") * 7919 % 60_013).alias("e"), F.col("id").alias("pos"))
        got = first_seen_ids(rows, "e", ["pos"])
        assert got.agg(F.count_distinct("idx"), F.min("idx"), F.max("idx")).first()[:] == (60_000, 0, 59_999)
        assert got.join(rows, "e").where("idx <> pos").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_local_moves_find_two_cliques():
    clique = lambda ids: [(a, b, 1.0) for a in ids for b in ids if a < b]
    edges = clique(range(5)) + clique(range(5, 10)) + [(4, 5, 0.1)]
    of = community.multilevel(edges, 1.0, 2 * sum(w for _, _, w in edges), 42)
    assert len({of[k] for k in range(5)}) == 1 and len({of[k] for k in range(5, 10)}) == 1 and of[0] != of[9]


def test_guard_equals_all_pairs(spark):
    from weftline.operators import augment

    rng = np.random.default_rng(3)
    rows = [(k, *([str(x) for x in rng.integers(0, m, n)] for m in (12, 3))) for k in range(300) for n in [int(rng.integers(1, 7))]]
    frame = lambda part: spark.createDataFrame(part, "id long, spacers array<string>, repeats array<string>")
    own, held = rows[:240], rows[240:]
    run = lambda a, b: any(b[0][i : i + len(a[0])] == a[0] and b[1][i : i + len(a[1])] == a[1] for i in range(len(b[0]) - len(a[0]) + 1))
    tokens = lambda r: {("S", x) for x in r[1]} | {("R", x) for x in r[2]}
    for d in (0.3, 0.6):
        want = {r[0] for r in own if not any(run(r[1:], h[1:]) or run(h[1:], r[1:]) or 1 - len(tokens(r) & tokens(h)) / len(tokens(r) | tokens(h)) < d for h in held)}
        assert {r["id"] for r in augment.guarded(frame(own), frame(held), d).collect()} == want


def test_weighted_sample_draws_exactly_n(spark):
    from collections import Counter

    from weftline.operators import augment

    rows = [(k, w) for k, w in enumerate([1.0, 0.0, None, -2.0, 3.0, 0.5, 5.5])] + [(0, 1.0), (0, 0.0)]
    frame = spark.createDataFrame(rows, "id long, w double")
    got = augment.weighted_sample(frame, "id", "w", 11_000, 5).collect()
    assert sorted(r["draw"] for r in got) == list(range(11_000))
    times = Counter(r["id"] for r in got)
    assert set(times) == {0, 4, 5, 6} and all(abs(times[k] - 1000 * w) < 5 * (1000 * w) ** 0.5 for k, w in {0: 2, 4: 3, 5: 0.5, 6: 5.5}.items())
    assert augment.weighted_sample(frame.where("w <= 0"), "id", "w", 10, 5).collect() == []


def test_running_totals(spark):
    from weftline.operators import stats

    rows = [((k * 7919) % 1000, k % 5) for k in range(1000)]
    out = stats.running_totals(spark.createDataFrame(rows, "id long, v long").repartition(5), ["id"], "v").collect()
    total, want = 0, {}
    for i, v in sorted(rows):
        total += v
        want[i] = total
    assert {r["id"]: r["upto"] for r in out} == want
