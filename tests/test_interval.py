"""Interval joins against all pairs of a parent."""

import random

import pytest

from weftline.operators import interval

A, B = "parent string, id long, start long, end long", "parent string, pos long, start long, end long, name string"


def table(seed, n, extra):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        s = rng.choice([rng.randrange(-500, 2000), rng.randrange(100)])
        row = (rng.choice(["hot", "hot", "b", "c"]), k, s, s + rng.choice([0, 3, rng.randrange(40), 900]))
        out.append((*row, f"f{k % 7}") if extra else row)
    return out


def gap(a, b):
    return max(b[2] - a[3], a[2] - b[3], 0)


@pytest.mark.parametrize("seed", range(2))
def test_nearest(spark, seed):
    arrays, features = table(seed, 150, False), table(seed + 10, 60, True)
    strays = [("none", 900, 5, 6), (None, 901, 5, 6), ("b", 902, None, 6)]
    frame = spark.createDataFrame(arrays + strays, A)
    got = interval.nearest(frame, spark.createDataFrame(features + [("b", 99, None, 4, "x"), (None, 98, 1, 4, "x")], B), "parent", "id", "pos", ["pos", "name"]).collect()
    want = {}
    for a in arrays:
        best = min(((gap(a, f), f[1], f[4]) for f in features if f[0] == a[0]), default=(None, None, None))
        want[a[1]] = best
    want |= {900: (None,) * 3, 901: (None,) * 3, 902: (None,) * 3}
    assert {r["id"]: (r["distance"], r["pos"], r["name"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("most", [0, 1, 25, 700])
def test_within(spark, most):
    arrays, features = table(3, 80, False), table(14, 40, True)
    got = interval.within(spark.createDataFrame(arrays, A), spark.createDataFrame(features, B), "parent", "id", "pos", most).collect()
    want = set()
    for a in arrays:
        near = sorted((gap(a, f), f[2], f[3], f[1]) for f in features if f[0] == a[0] and (not most or gap(a, f) <= most))
        want |= {(a[0], a[1], f, d, k + 1) for k, (d, _, _, f) in enumerate(near)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_no_features(spark):
    frame = spark.createDataFrame([("a", 1, 2, 3)], A)
    assert interval.nearest(frame, spark.createDataFrame([], B), "parent", "id", "pos", ["name"]).collect()[0]["distance"] is None
    assert interval.within(frame, spark.createDataFrame([], B), "parent", "id", "pos", 5).collect() == []
