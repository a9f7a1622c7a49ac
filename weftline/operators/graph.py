"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.runtime import discard, materialize

#: Edges of a contracted graph that one task takes at the end, and rows of a batch that it gives.
LAST_EDGES, OUT_ROWS = 200_000, 10_000


def _joined(edges: DataFrame) -> DataFrame:
    """node, next (the smallest node reachable) of edges a, b, by one task."""
    kind = dict(edges.dtypes)["a"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}
        schema = None

        def root(x):
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                above[max(a, b)] = min(a, b)
        nodes = list(above)
        for first in range(0, len(nodes), OUT_ROWS):
            some = nodes[first : first + OUT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(0).type) for c in (some, [root(x) for x in some])], ["node", "next"])

    return edges.repartition(1).mapInArrow(fold, f"node {kind}, next {kind}")


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node reachable.

    Each round sends a node to its smallest neighbour, if that is smaller, and on to where that ends (pointer jumping, so long chains take
    a logarithmic number of steps), and contracts the edges by that: rounds work on what is left of the graph. Once that is
    LAST_EDGES edges or fewer, one task finishes it. Each round is written to the shared scratch folder, which keeps the plan flat. Edges with
    a null end are ignored, and so are loops but for their node.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    both = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    now, rounds, written = both.where("a <> b"), [], [both]
    while left := now.count():
        if rounds and left <= LAST_EDGES and dict(now.dtypes)["a"] in ("string", "bigint", "int"):
            rounds.append(materialize(_joined(now), "rounds"))
            break
        hooked = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("m"))
        step = hooked.select(F.col("a").alias("node"), F.least("a", "m").alias("next"))
        step = materialize(step, "rounds")
        while True:
            on = lambda x: step.select(F.col("node").alias(f"t{x}"), F.col("next").alias(f"n{x}"))  # noqa: B023, E731
            twice = step.join(on(1), F.col("next") == F.col("t1")).join(on(2), F.col("n1") == F.col("t2")).select("node", F.col("n2").alias("next"), (F.col("n2") != F.col("next")).alias("changed"))
            twice = materialize(twice, "rounds")
            discard(step)
            step = twice
            if step.where("changed").limit(1).count() == 0:
                break
        rounds.append(step)
        a, b = step.select(F.col("node").alias("a"), F.col("next").alias("x")), step.select(F.col("node").alias("b"), F.col("next").alias("y"))
        fewer = now.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        now = materialize(fewer.distinct(), "edges")
        written.append(now)
    found = both.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component"))
    if rounds:
        last = rounds[-1].select("node", F.col("next").alias("component"))
        for step in reversed(rounds[:-1]):
            last = step.join(last.select(F.col("node").alias("t"), "component"), F.col("next") == F.col("t"), "left").select("node", F.coalesce("component", "next").alias("component"))
        found = last.unionByName(found.join(rounds[0].select("node"), "node", "left_anti"))
    out = materialize(found, "labels")
    discard(*written, *rounds)
    return out
