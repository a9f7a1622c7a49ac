"""q17 to q29: similarity joins, neighbours, edit distance, clusterings and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import cluster, community, similarity
from weftline.operators.stats import heaviest_groups
from weftline.queries.base import SQL_ARRAYS, arrays
from weftline.queries.registry import query
from weftline.runtime import materialize, table

SQL_SETS = "st AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS element FROM lineitem)"
SQL_PAIRS = f"""{SQL_SETS}, sz AS (SELECT id, count(*) AS n FROM st GROUP BY id),
sp AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM st x JOIN st y ON x.element = y.element AND x.id < y.id GROUP BY 1, 2),
pr AS (SELECT a, b, shared, p.n AS na, q.n AS nb, shared::DOUBLE / (p.n + q.n - shared) AS jaccard FROM sp JOIN sz p ON p.id = a JOIN sz q ON q.id = b)"""


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("element")).distinct()


@query(f"WITH {SQL_PAIRS} SELECT a, b, jaccard AS similarity FROM pr WHERE jaccard >= 0.3")
def q17_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.similar_pairs(_sets(spark, sf), 0.3)


@query(f"WITH {SQL_PAIRS} SELECT a, b, shared::DOUBLE / least(na, nb) AS similarity FROM pr WHERE shared::DOUBLE / least(na, nb) >= 0.6")
def q18_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.similar_pairs(_sets(spark, sf), 0.6, "overlap")


@query(f"WITH {SQL_PAIRS} SELECT a, b, shared::DOUBLE / na AS similarity FROM pr WHERE shared::DOUBLE / na >= 0.7")
def q19_containment_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.similar_pairs(_sets(spark, sf), 0.7, "containment")


@query(f"""
WITH {SQL_PAIRS}, bo AS (SELECT a, b, jaccard FROM pr UNION ALL SELECT b, a, jaccard FROM pr),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY jaccard DESC, b) AS r FROM bo)
SELECT least(a, b) AS src, greatest(a, b) AS dst, max(jaccard) * count(*) AS weight FROM r WHERE r <= 3 AND jaccard >= 0.25 GROUP BY 1, 2
""")
def q20_knn_graph(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.nearest_neighbours(_sets(spark, sf), 3, 0.25)


@query("WITH t AS (SELECT DISTINCT p_name AS t FROM part) SELECT x.t AS a, y.t AS b, CAST(levenshtein(x.t, y.t) AS INTEGER) AS distance FROM t x JOIN t y ON x.t < y.t AND levenshtein(x.t, y.t) <= 3")
def q21_edit_distance_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.edit_distance_pairs(table(spark, sf, "part"), 3, "p_name")


@query("""
WITH RECURSIVE t AS (SELECT DISTINCT p_name AS t FROM part), e AS (SELECT x.t AS a, y.t AS b FROM t x JOIN t y ON x.t <> y.t AND levenshtein(x.t, y.t) <= 2),
c AS (SELECT t AS n, t AS r FROM t UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.n)
SELECT n AS text, min(r) AS representative FROM c GROUP BY n
""")
def q22_fuzzy_components(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.fuzzy_representatives(table(spark, sf, "part"), 2, "p_name")


@query(f"""
WITH RECURSIVE {SQL_PAIRS}, e AS (SELECT a, b FROM pr WHERE jaccard >= 0.5 UNION ALL SELECT b, a FROM pr WHERE jaccard >= 0.5),
c AS (SELECT id AS n, id AS r FROM sz UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.n)
SELECT n AS id, min(r) AS component FROM c GROUP BY n
""")
def q23_jaccard_components(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.similarity_components(_sets(spark, sf), 0.5)


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent"))
    # Elements by part modulo, so that the arrays of a customer do share some.
    rows = arrays(spark, sf).select("id", F.transform("elements", lambda x: x % 40).alias("elements"))
    return rows.join(o, "id")


@query()
def q24_first_fit(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.first_fit(_grouped(spark, sf), "parent")


@query("""
WITH m AS (SELECT c_mktsegment AS segment, c_custkey AS id FROM customer), n AS (SELECT *, count(*) OVER (PARTITION BY segment) AS n, row_number() OVER (PARTITION BY segment ORDER BY id) - 1 AS pos FROM m)
SELECT segment, id, CAST(CASE WHEN n <= 25 OR n // (n // 25 + 1) = 0 THEN 0 ELSE least(pos // nullif(n // (n // 25 + 1), 0), n // 25) END AS BIGINT) AS part FROM n
""")
def q25_forced_partition(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"))
    return cluster.forced_partition(m, ["segment"], ["id"], 25)


@query()
def q26_singleton_rescue(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.first_fit(_grouped(spark, sf), "parent", rescue=0.5)


@query()
def q27_seed_split(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.seed_split(_grouped(spark, sf), "parent", 4)


@query()
def q27b_split_by_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of similar arrays within each customer, split by seeds above three."""
    return cluster.seed_split(_grouped(spark, sf), "parent", 3, 0.2)


RUNS_SQL = """m AS (SELECT 0 AS run, p_brand AS label, p_partkey AS id FROM part UNION ALL SELECT 1, p_type, p_partkey FROM part UNION ALL SELECT 2, (p_size % 10)::VARCHAR, p_partkey FROM part)"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    out = None
    for n, label in enumerate((F.col("p_brand"), F.col("p_type"), (F.col("p_size") % 10).cast("string"))):
        one = p.select(F.lit(n).alias("run"), label.alias("label"), F.col("p_partkey").alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {RUNS_SQL} SELECT x.id AS a, y.id AS b, count(*) / 3.0::DOUBLE AS share FROM m x JOIN m y ON x.run = y.run AND x.label = y.label AND x.id < y.id GROUP BY 1, 2 HAVING count(*) / 3.0 > 0.5")
def q28_coassociation(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.coassociation(_runs(spark, sf))


@query()
def q29_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Five seeded runs over the nearest neighbours: seed, node, community."""
    return community.community_runs(similarity.nearest_neighbours(_sets(spark, sf), 3, 0.3))


@query()
def q29b_consensus_communities(spark: SparkSession, sf: str) -> DataFrame:
    return community.consensus_communities(_sets(spark, sf), 3, 0.4)


@query()
def q29c_config_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """All eight configurations, large communities split: sizes of what each finds."""
    sizes = community.sweep(_sets(spark, sf)).groupBy("config", "community").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("config").agg(F.count(F.lit(1)).alias("n_communities"), F.sum("n").alias("n_nodes"), F.max("n").alias("largest"))


@query()
def q29d_recluster_large(spark: SparkSession, sf: str) -> DataFrame:
    edges = materialize(similarity.nearest_neighbours(_sets(spark, sf), 3, 0.1), "neighbours")
    return community.recluster_large(edges, community.communities(edges, 0.5), 40, 0.5)


@query("""
WITH g AS (SELECT o_custkey AS parent, count(DISTINCT l_orderkey) AS arrays, count(DISTINCT l_partkey) AS elements FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT parent, arrays, elements, arrays * (arrays - 1) // 2 AS pairs FROM g ORDER BY pairs DESC, parent LIMIT 15
""")
def q46_heaviest_groups(spark: SparkSession, sf: str) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("parent"), "l_orderkey", "l_partkey")
    return heaviest_groups(rows, "parent", "l_orderkey", "l_partkey", 15)
