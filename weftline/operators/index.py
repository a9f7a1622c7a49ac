"""Dense ids in first-seen order, and the first or last row of a key under an explicit order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.stats import running_totals


def first_seen_ids(rows: DataFrame, element: str, order: list[str], within: list[str] | None = None) -> DataFrame:
    """(within..., element, idx): ids from 0 in the order in which elements first appear, overall or in each group.

    First appearances are found with map-side combine. Overall ids are running totals over written ranges, so no task holds all elements, and
    ranges drawn from a sample are drawn once: two reads of an unwritten plan may cut the order at different places.
    """
    within = within or []
    first = rows.groupBy(*within, element).agg(F.min(F.struct(*order)).alias("__at"))
    if within:
        return first.select(*within, element, (F.row_number().over(Window.partitionBy(*within).orderBy("__at")) - 1).cast("long").alias("idx"))
    numbered = running_totals(first.withColumn("__one", F.lit(1).cast("long")), ["__at"], "__one")
    return numbered.select(element, (F.col("upto") - 1).alias("idx"))


def _pick(rows: DataFrame, key: list[str], order: list[str], best) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(best(F.struct(*rest), F.struct(*order)).alias("__row")).select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first by `order`: an aggregation with map-side combine, never dropDuplicates."""
    return _pick(rows, key, order, F.min_by)


def last_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return _pick(rows, key, order, F.max_by)
