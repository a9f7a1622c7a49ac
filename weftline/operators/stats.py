"""Counts, distributions and summary statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import materialize

from weftline.functions.seq import round_half_even


def distribution(rows: DataFrame, by: list[str]) -> DataFrame:
    """by..., n and pct (two digits) of all rows."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*by, "n", round_half_even(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()).cast("double"), 2).alias("pct"))


def top_counts(rows: DataFrame, key: str, first: list[str], n: int) -> DataFrame:
    """The n most frequent values, ties by first appearance."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*first)).alias("__first"))
    return counts.orderBy(F.col("n").desc(), "__first").limit(n).select(key, "n")


def coverage(seen: DataFrame, known: DataFrame, value: str = "value") -> DataFrame:
    """covered, missing, fraction of a dictionary of values."""
    rows = known.select(value).distinct().join(seen.select(value).distinct().withColumn("__hit", F.lit(1)), value, "left")
    out = rows.agg(F.count("__hit").alias("covered"), F.count(F.lit(1)).alias("__all"))
    return out.select("covered", (F.col("__all") - F.col("covered")).alias("missing"), (F.col("covered") / F.col("__all")).alias("fraction"))


def describe(x: Column, prefix: str) -> list[Column]:
    return [f(x).alias(f"{prefix}_{n}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]


def heaviest_groups(rows: DataFrame, group: str, array_id: str, element: str, n: int) -> DataFrame:
    """The n groups with most pairs of arrays: arrays, distinct elements and n(n-1)/2."""
    out = rows.groupBy(group).agg(F.countDistinct(array_id).alias("arrays"), F.countDistinct(element).alias("elements"))
    out = out.withColumn("pairs", F.expr("arrays * (arrays - 1) div 2"))
    return out.orderBy(F.col("pairs").desc(), group).limit(n)


def running_totals(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """rows with `upto`, the sum of value over all rows up to and with each in that order, without a window over everything.

    Ranges of the order are summed, the ranges' totals (a row a range) run up in the driver's plan, and each range runs up by itself.
    Values are whole numbers, so no rounding depends on the partitioning.
    """
    ranged = materialize(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__p").agg(F.sum(value).alias("__s"))
    before = totals.select("__p", (F.sum("__s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"))  # a row a partition
    inner = F.sum(value).over(Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("upto", inner).join(F.broadcast(before), "__p").withColumn("upto", F.col("upto") + F.coalesce("__before", F.lit(0))).drop("__p", "__before")
