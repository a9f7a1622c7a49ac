"""Which rows go on: filters on calls and strata, and lookups that fill in where a row comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import labels
from weftline.operators.index import first_per_key


def backfill(rows: DataFrame, lookup: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """rows with empty or null values filled from lookup's first value of their key that is not empty, by `order`; values without a key stay as they are."""
    known = lookup.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(F.col(key).alias("__k")).agg(F.min_by(value, F.struct(*order)).alias("__v"))
    joined = rows.join(known, rows[key] == known["__k"], "left")
    return joined.withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit("")), "__v")).select(*rows.columns)


def usable(rows: DataFrame, lookup: DataFrame, key: str, source: str, order: list[str], agreement: str, direction: str, require_agree: bool = True, allow_not_comparable: bool = False) -> DataFrame:
    """Rows that agree (or, if allowed, cannot be compared), have a direction and have a source, their own or the lookup's."""
    stated = F.lower(F.trim(labels.fill(F.col(agreement), "")))
    fit = stated.isin("agree", "not_comparable") if allow_not_comparable else stated == "agree"
    kept = rows.where((fit if require_agree else F.lit(True)) & F.trim(F.col(direction)).isin("Forward", "Reverse"))
    return backfill(kept, lookup, key, source, order).where(F.coalesce(F.col(source), F.lit("")) != "")


def first_in_document(asked: DataFrame, items: DataFrame, document: str, name: str, order: list[str]) -> DataFrame:
    """asked with the columns of the first item of that name in that document, in document order; asked names that no item has are left out.

    items: one row an item, order its place in the document. All documents are read once, not once for each name.
    """
    return asked.join(first_per_key(items, [document, name], order), [document, name])


def enough_members(rows: DataFrame, stratum: str, least: int, reference: DataFrame | None = None) -> DataFrame:
    """Rows of strata with at least `least` rows in reference, or in rows themselves; all of them if least is 1 or less."""
    if least <= 1:
        return rows
    counts = (rows if reference is None else reference).groupBy(F.col(stratum).alias("__s")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    return rows.join(counts, rows[stratum].eqNullSafe(counts["__s"]), "left_semi")


def below_level(rows: DataFrame, level: str, least: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows below a level of evidence, dimension, value and n: their number by level and by each of `by`).

    All counts come from one pass by grouping sets; null values count as Unknown, rows without a level are in neither.
    """
    low = rows.where(F.col(level) < least)
    dims = [level, *by]
    named = low.select(*(F.coalesce(F.col(c).cast("string"), F.lit(labels.UNKNOWN)).alias(c) for c in dims))
    counts = named.groupingSets([[F.col(c)] for c in dims], *dims).agg(F.count(F.lit(1)).alias("n"))
    which = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in dims))
    return low, counts.select(which.alias("dimension"), F.coalesce(*dims).alias("value"), "n")


def not_stratum(rows: DataFrame, stratum: str, blocked: str | None) -> DataFrame:
    """Rows outside the blocked stratum; null and blank count as Unknown. Nothing is blocked if none is named."""
    return rows.where(labels.subtype_key(F.col(stratum)) != blocked) if blocked else rows


def in_groups(rows: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Rows of the groups that are allowed."""
    return rows.join(groups.select(group).distinct(), group, "left_semi")
