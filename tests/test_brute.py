"""Queries without SQL on small fixtures against plain Python that follows the same order."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_augmenter import KIND, allowed, arrays
from weftline.operators import augment, ml, quality


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def plain_subset(seed, key, attempt, n, least):
    """Places of the draw, in order."""
    size = int(md5(seed, key, attempt)[:15], 16) % (n - least) + least
    return sorted(sorted(range(n), key=lambda i: (md5(seed, key, attempt, i), i))[:size])


@pytest.mark.parametrize("least_distance", [None, 0.3])
def test_bulk_subsets(spark, least_distance):
    own, held, seed, least, each = arrays(5, 30), arrays(6, 6, 1000), 13, 2, 3
    drawn = []
    for key, s, r in own:
        for attempt in range(64 if len(s) > least else 0):
            at = plain_subset(seed, key, attempt, len(s), least)
            drawn.append((key, attempt, [s[i] for i in at], [r[i] for i in at]))
    first = {}
    for key, attempt, s, r in sorted(drawn, key=lambda x: x[:2]):
        first.setdefault((tuple(s), tuple(r)), (key, attempt))
    known = {(tuple(s), tuple(r)) for _, s, r in own + held}
    fit = [(key, attempt, s, r) for (s, r), (key, attempt) in first.items() if (s, r) not in known and (least_distance is None or allowed(list(s), list(r), held, least_distance))]
    want = set()
    for key in {x[0] for x in fit}:
        want |= {(f"{k}#{a}", k, s, r) for k, a, s, r in sorted(x for x in fit if x[0] == key)[:each]}
    frame = lambda rows: spark.createDataFrame(rows, KIND)
    got = augment.bulk_subsets(frame(own), frame(held), least, each, seed, least_distance).collect()
    assert {(r["id"], r["source_id"], tuple(r["spacers"]), tuple(r["repeats"])) for r in got} == want and len(got) == len(want) > 10
    assert augment.bulk_subsets(frame(own), frame(held), least, 0, seed).count() == 0


def test_diverse(spark):
    rng = np.random.default_rng(4)
    rows = [(g, f"{g}#{k:02d}", [int(x) for x in rng.choice(9, rng.integers(0, 6), replace=False)]) for g in range(8) for k in range(int(rng.integers(1, 9)))]
    want = set()
    for g in range(8):
        left = sorted((i, set(e)) for h, i, e in rows if h == g)
        picks = [min(left, key=lambda x: (-len(x[1]), x[0]))]
        far = lambda x: min(1 - len(x[1] & p[1]) / len(x[1] | p[1]) if x[1] | p[1] else 1.0 for p in picks)
        while len(picks) < min(3, len(left)):
            picks.append(min((x for x in left if x not in picks), key=lambda x: (-far(x), x[0])))
        want |= {(g, i, n) for n, (i, _) in enumerate(picks)}
    got = augment.diverse(spark.createDataFrame(rows, "source_id int, id string, elements array<int>"), "source_id", 3)
    assert {(r["source_id"], r["id"], r["pick"]) for r in got.collect()} == want


def plain_logistic(x, y):
    """Ridge with an intercept that is free, the penalty 1 / n on half the squared weights, by Newton's steps."""
    a, w, n = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1), len(x)
    ridge = np.diag([1 / n] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / n + ridge, a.T @ (p - y) / n + ridge @ w)
    return w


def test_logistic(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 2))
    y = (x @ [1.5, -0.7] + rng.normal(size=120) > 0.2).astype(float)
    rows = spark.createDataFrame([(k, float(y[k]), *map(float, x[k])) for k in range(120)] + [(500, 1.0, None, 0.0)], "id long, y double, a double, b double")
    folds = {r["id"]: r["f"] for r in rows.select("id", F.pmod(F.xxhash64(F.lit(42), "id"), F.lit(5)).alias("f")).collect()}
    fold = np.array([folds[k] for k in range(120)])
    hits = []
    for k in range(5):
        w = plain_logistic(x[fold != k], y[fold != k])
        hits.append(np.mean((np.column_stack([x, np.ones(120)])[fold == k] @ w > 0) == y[fold == k]))
    want = plain_logistic(x, y)
    got = {r["feature"]: r for r in ml.logistic_cv(rows, "id", "y", ["a", "b"]).collect()}
    assert math.isclose(got["a"]["coefficient"], want[0], rel_tol=1e-3) and math.isclose(got["b"]["coefficient"], want[1], rel_tol=1e-3)
    assert math.isclose(got["a"]["cv_accuracy"], np.mean(hits), abs_tol=1e-9)


def test_compared_runs_skip_what_is_no_number(spark):
    nan = float("nan")
    rows = [("b", 2, "s", 9, 0.5, nan), ("a", 1, "s", 3, 0.5, None), ("c", 3, "s", 1, nan, nan), ("a", 1, "t", 4, 1.0, 1.0), ("a", 1, None, 6, 0.1, 0.2)]
    frame = spark.createDataFrame(rows, "run string, at int, stratum string, n int, f1 double, accuracy double")
    got = {r["stratum"]: r for r in quality.compare_runs(frame, "run", "at", "stratum", "n", ["f1", "accuracy"]).collect()}
    assert set(got) == {"s", None}  # t has fewer than five rows in every run
    assert (got["s"]["n"], got["s"]["f1"], got["s"]["best_f1"], got["s"]["accuracy"], got["s"]["best_accuracy"]) == (9, {"a": 0.5, "b": 0.5}, "a", {}, None)


def test_pages(spark):
    got = quality.pages(spark.createDataFrame([("c",), ("a",), ("b",), (None,), ("a",)], "s string"), "s", 2).collect()
    assert {tuple(r) for r in got} == {("a", 0, 0), ("b", 0, 1), ("c", 1, 0)}
