"""Views of the driver's tables as arrays: an order is an array, its parts are the elements, its customer is the parent sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.runtime import table


def day(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts)).cast("long")


SQL_DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST({0} AS DATE)) AS BIGINT)"


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """array_id, parent, start, end (days), priority, status."""
    ship = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(day(F.col("l_shipdate"))).alias("last"))
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("array_id"), F.col("o_custkey").alias("parent"), day(F.col("o_orderdate")).alias("start"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")
    )
    return o.join(ship, o["array_id"] == ship["l_orderkey"], "left").select(
        "array_id", "parent", "start", F.greatest("start", F.coalesce("last", "start")).alias("end"), "priority", "status"
    )


SQL_INTERVALS = f"""iv AS (
  SELECT o_orderkey AS array_id, o_custkey AS parent, {SQL_DAY.format('o_orderdate')} AS "start",
         greatest({SQL_DAY.format('o_orderdate')}, coalesce((SELECT max({SQL_DAY.format('l_shipdate')}) FROM lineitem WHERE l_orderkey = o_orderkey), 0)) AS "end",
         o_orderpriority AS priority, o_orderstatus AS status
  FROM orders)"""


def elements(spark: SparkSession, sf: str) -> DataFrame:
    """id, element, pos: the parts of each order in the order (line number, part)."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("element"), F.col("l_linenumber").alias("line"))
    return li.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("line", "element"))).alias("e")).select("id", F.posexplode("e").alias("pos", "x")).select("id", F.col("x.element").alias("element"), "pos")


SQL_ELEMENTS = "el AS (SELECT l_orderkey AS id, l_partkey AS element, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS pos FROM lineitem)"


def arrays(spark: SparkSession, sf: str) -> DataFrame:
    """id, elements: the ordered list of parts."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("e")).select("id", F.transform("e", lambda x: x["l_partkey"]).alias("elements"))


SQL_ARRAYS = "ar AS (SELECT l_orderkey AS id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS elements FROM lineitem GROUP BY l_orderkey)"


def joined(arr: Column) -> Column:
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), ",")
