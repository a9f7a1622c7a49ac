"""Row selection: filters on calls and strata, lookups, and the loss of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import seq
from weftline.operators import quality, selecting
from weftline.queries.registry import query
from weftline.runtime import table


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN ' Agree' WHEN 'O' THEN 'not_comparable' ELSE 'disagree' END AS agreement,
  CASE o_orderkey % 3 WHEN 0 THEN 'Forward' WHEN 1 THEN 'Reverse' ELSE 'Unknown' END AS direction, CASE WHEN o_orderkey % 5 = 0 THEN 'own' WHEN o_orderkey % 5 = 1 THEN '' END AS source FROM orders),
l AS (SELECT c_custkey, c_mktsegment AS source FROM customer WHERE c_custkey % 2 = 0)
SELECT o_orderkey, direction, coalesce(nullif(r.source, ''), l.source) AS source FROM r LEFT JOIN l ON o_custkey = c_custkey
WHERE lower(trim(agreement)) IN ('agree', 'not_comparable') AND direction IN ('Forward', 'Reverse') AND coalesce(nullif(r.source, ''), l.source, '') <> ''
""")
def q81_usable_rows(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    agreement = F.when(F.col("o_orderstatus") == "F", " Agree").when(F.col("o_orderstatus") == "O", "not_comparable").otherwise("disagree")
    direction = F.when(key % 3 == 0, "Forward").when(key % 3 == 1, "Reverse").otherwise("Unknown")
    source = F.when(key % 5 == 0, "own").when(key % 5 == 1, "")
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("name"), agreement.alias("agreement"), direction.alias("direction"), source.alias("source"))
    lookup = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("source"))
    return selecting.usable(rows, lookup, "name", "source", ["source"], "agreement", "direction", allow_not_comparable=True).select("o_orderkey", "direction", "source")


@query("""
WITH a AS (SELECT DISTINCT o_orderkey AS document, o_orderkey % 7 + 1 AS name FROM orders)
SELECT document, name, min(l_partkey) AS item FROM a JOIN lineitem ON l_orderkey = document AND l_linenumber = name GROUP BY 1, 2
""")
def q82_first_in_document(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("name")).distinct()
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("name"), F.col("l_partkey").alias("item"))
    return selecting.first_in_document(asked, items, "document", "name", ["item"]).select("document", "name", "item")


@query("""
WITH c AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 9), g AS (SELECT DISTINCT p_size FROM part WHERE p_partkey % 3 = 0)
SELECT p_partkey, p_brand FROM part WHERE p_partkey % 2 = 0 AND p_brand IN (SELECT p_brand FROM c) AND coalesce(nullif(trim(p_type), ''), 'Unknown') <> (SELECT min(p_type) FROM part) AND p_size IN (SELECT p_size FROM g)
""")
def q83_strata_filters(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    rows = selecting.enough_members(part.where("p_partkey % 2 = 0"), "p_brand", 9, part)
    rows = selecting.not_stratum(rows, "p_type", part.agg(F.min("p_type")).first()[0])
    return selecting.in_groups(rows, part.where("p_partkey % 3 = 0"), "p_size").select("p_partkey", "p_brand")


@query("""
WITH e AS (SELECT event_type, (value > 50)::INTEGER AS y, (event_id % 101)::DOUBLE / 100 AS s FROM events), p AS (SELECT *, least(greatest(s, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS q FROM e)
SELECT event_type, count(*) AS n, round_even(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS loss FROM p GROUP BY 1
""")
def q84_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_type", (F.col("value") > 50).cast("int").alias("y"), ((F.col("event_id") % 101).cast("double") / 100).alias("s"))
    return quality.log_loss(rows, "y", "s", ["event_type"]).select("event_type", "n", seq.round_half_even(F.col("loss"), 6).alias("loss"))


@query("""
WITH f AS (SELECT o_custkey, arg_min(o_clerk, o_orderkey) AS clerk FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority || o_orderkey END AS o_clerk FROM orders) x WHERE o_clerk IS NOT NULL GROUP BY 1)
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name END, clerk) AS source FROM customer LEFT JOIN f ON o_custkey = c_custkey
""")
def q81b_backfill_first(spark: SparkSession, sf: str) -> DataFrame:
    """Values filled from the first row of many that a key has."""
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", key.alias("name"), F.when(key % 3 == 0, F.col("c_name")).otherwise("").alias("source"))
    order = F.col("o_orderkey")
    lookup = table(spark, sf, "orders").select(F.col("o_custkey").alias("name"), order, F.when(order % 4 != 0, F.concat("o_orderpriority", order.cast("string"))).alias("source"))
    return selecting.backfill(rows, lookup, "name", "source", ["o_orderkey"]).select("c_custkey", "source")


LEVELS = "lv AS (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level, o_orderstatus AS status, CASE WHEN o_custkey % 5 > 0 THEN 'k' || (o_custkey % 5) END AS kind FROM orders)"


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit("k"), (F.col("o_custkey") % 5).cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), F.col("o_orderstatus").alias("status"), kind.alias("kind"))


@query(f"WITH {LEVELS} SELECT * FROM lv WHERE level < 4")
def q85_low_level_rows(spark: SparkSession, sf: str) -> DataFrame:
    return selecting.below_level(_levels(spark, sf), "level", 4, ["status", "kind"])[0]


@query(f"""WITH {LEVELS}, l AS (SELECT * FROM lv WHERE level < 4) SELECT 'level' AS dimension, level::VARCHAR AS value, count(*) AS n FROM l GROUP BY 2
UNION ALL SELECT 'status', coalesce(status, 'Unknown'), count(*) FROM l GROUP BY 2 UNION ALL SELECT 'kind', coalesce(kind, 'Unknown'), count(*) FROM l GROUP BY 2""")
def q85b_low_level_counts(spark: SparkSession, sf: str) -> DataFrame:
    return selecting.below_level(_levels(spark, sf), "level", 4, ["status", "kind"])[1]
