"""Components by contraction: against union by hand, with and without the last task, and rounds that work on what is left."""

import random

import pytest

from weftline.operators import graph


def union(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


@pytest.mark.parametrize("last", [0, 200_000])
def test_paths_stars_loops_and_nulls(spark, monkeypatch, last):
    monkeypatch.setattr(graph, "LAST_EDGES", last)
    rng = random.Random(3)
    path = rng.sample(range(1000, 1400), 400)
    edges = [(k, k + 1) for k in range(200)] + [(999, 500 + k) for k in range(40)] + [*zip(path, path[1:], strict=False)][::1] + [(2000, 2000), (3, 3), (None, 5), (6000, None)]
    edges += [(3000 + rng.randrange(300), 3000 + rng.randrange(300)) for _ in range(140)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == union(edges)


def test_a_round_works_on_what_is_left(spark, monkeypatch):
    """All edges met the labels of every round; now small components are gone after the first."""
    real, edges, labels = graph.materialize, [], []

    def counted(df, name="rows", *rest):
        out = real(df, name, *rest)
        if name in ("edges", "labels"):
            (edges if name == "edges" else labels).append(out.count())
        return out

    monkeypatch.setattr(graph, "materialize", counted)
    monkeypatch.setattr(graph, "LAST_EDGES", 0)
    rows = [(4 * k + i, 4 * k + i + 1) for k in range(200) for i in range(3)] + [(5000 + k, 5001 + k) for k in range(0, 40)]
    assert graph.components(spark.createDataFrame(rows, "src long, dst long")).count() == 841
    assert edges[0] == 640 and edges[1] == 0 and labels == [841]
