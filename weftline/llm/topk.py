"""Exact top-k search by inner product with MaxScore pruning, over integer vectors.

A vector is a document whose terms are its dimensions. Per shard of candidates and query, a term's contribution
is bounded by the extremes of its posting list. Terms are split by these bounds: essential terms are the fewest
whose absence leaves the rest unable to bring a document to the current k-th score; their postings are traversed for
all documents. The non-essential terms are then probed, a few at a time, only for documents whose partial score plus the
bounds of the terms still open reaches that score. Integer arithmetic makes the result exact.

Queries stand in blocks and candidates in shards, both of bounded size; each block meets each shard in a task of its own, which keeps k
rows a query, and shards' rows are merged by query. The plan is the same for one block and for a thousand, and no vector passes the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most queries of a block and candidates of a shard, on average: at 64 dimensions 2 MB and 8 MB. Shards are smaller, though not below the least, where all cores would not have one.
BLOCK_QUERIES, SHARD_ROWS, LEAST_ROWS = 4096, 16_384, 1024
#: Candidates that are compared at a time, so that a query's bar of one part prunes the next.
STEP_ROWS = 4096
PROBED = 4


def quantize(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of each component as a double. Vectors that are null or hold null or non-finite components go."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * float(scale)).cast("long")).alias("v")
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Columns are posting lists: dims x rows. Short vectors end in zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == dims).all():
        return np.ascontiguousarray(flat.reshape(len(lengths), dims).T)
    out = np.zeros((dims, len(lengths)), np.int64)
    at = 0
    for k, n in enumerate(lengths.tolist()):
        out[: min(n, dims), k] = flat[at : at + min(n, dims)]
        at += n
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def maxscore(query: np.ndarray, own: int, ids: np.ndarray, postings: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, floor_: float) -> tuple[np.ndarray, np.ndarray]:
    """The shard's best k (ids, scores) that reach floor_, ties to the smaller id, without the query itself."""
    terms = np.flatnonzero(query)
    top = np.maximum(query[terms] * low[terms], query[terms] * high[terms])
    least = np.minimum(query[terms] * low[terms], query[terms] * high[terms])
    order = np.argsort(-(top - least), kind="stable")
    terms, top = terms[order], top[order]
    rest = np.append(np.cumsum(top[::-1])[::-1], 0)  # bound of the terms from each place on
    others = np.flatnonzero(ids != own)
    if not len(others):
        return ids[:0], np.zeros(0, np.int64)
    partial = np.zeros(len(ids), np.int64)
    done = 0
    # Essential terms: until what is open can no longer lift the median document over the bar; half of them before there is a bar.
    while done < len(terms) and (done < len(terms) // 2 if floor_ == -np.inf else done < len(terms) // 4 or rest[done] + np.median(partial[::16]) >= floor_):
        for t in terms[done : done + PROBED]:
            partial += query[t] * postings[t]
        done = min(len(terms), done + PROBED)
    if floor_ == -np.inf and done < len(terms) and len(others) > 4 * k:
        # The leaders by partial score, scored in full, give a first bar.
        lead = others[np.argpartition(-partial[others], 4 * k)[: 4 * k]]
        full = partial[lead] + query[terms[done:]] @ postings[np.ix_(terms[done:], lead)]
        floor_ = np.partition(full, -k)[-k]
    alive, score = others, partial[others]
    while True:
        keep = score + rest[done] >= floor_
        alive, score = alive[keep], score[keep]
        if done == len(terms) or not len(alive):
            break
        step = terms[done : done + PROBED]
        score = score + query[step] @ postings[np.ix_(step, alive)]
        done = min(len(terms), done + PROBED)
    return _best(ids[alive], score, k)


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), id_col, score: each query's k highest inner products with the other rows of `vectors`, ties to the smaller id.

    Rows whose id is the query's own do not count. Components become floor(256 x); rows with null or non-finite ones, or a null id, take no part on
    either side. Vectors of another length than the query count as ending in zeros. Repeated rows are candidates each; of queries
    with the same id one counts, the one with the smallest vector. Fewer candidates than k give fewer rows, no queries none.
    """
    candidates = quantize(vectors, id_col, vector_col)
    asked = quantize(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    rows, wanted = candidates.count(), asked.count()
    shards = max(1, -(-rows // SHARD_ROWS), min(vectors.sparkSession.sparkContext.defaultParallelism, rows // LEAST_ROWS))
    blocks = max(1, -(-wanted // block))

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        own, column = asked["id"].to_numpy(), asked["v"].combine_chunks()
        dims = max(column.value_lengths().to_pylist(), default=0)
        matrix = np.ascontiguousarray(_matrix(column, dims).T)
        ids = [np.zeros(0, np.int64)] * len(own)
        scores = list(ids)
        for at in range(0, held.num_rows if len(own) else 0, STEP_ROWS):
            part = held.slice(at, STEP_ROWS).combine_chunks()
            shard, postings = part["id"].to_numpy(), _matrix(part["v"].combine_chunks(), dims)
            low, high = postings.min(axis=1, initial=0), postings.max(axis=1, initial=0)
            for n in range(len(own)):
                bar = scores[n][-1] if len(scores[n]) == k else -np.inf
                new_ids, new = maxscore(matrix[n], own[n], shard, postings, low, high, k, bar)
                ids[n], scores[n] = _best(np.concatenate([ids[n], new_ids]), np.concatenate([scores[n], new]), k)
        none = np.zeros(0, np.int64)
        columns = [np.repeat(own, [len(x) for x in ids]).astype(np.int64), np.concatenate([none, *ids]), np.concatenate([none, *scores])]
        return pa.table(dict(zip(["query_id", "id", "score"], columns, strict=True)))

    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    # Rows are dealt to shards by their place, so repeated ones part; every block has its copy of a shard and every shard its copy of a block.
    dealt = candidates.select("id", "v", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard")).select("*", each(blocks, "block"))
    given = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).select("*", each(shards, "shard"))
    pairs = given.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block"))
    found = pairs.applyInArrow(search, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
