"""Joins of intervals on a parent sequence by an index of positions: nearest feature, features within a distance, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a block.
BLOCK = 16


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Distance of two well-formed intervals; 0 if they overlap or touch."""
    return F.greatest(b0 - a1, a0 - b1, F.lit(0))


def _bins(rows: DataFrame, width: int, reach: int = 0) -> DataFrame:
    """rows with __bin, once for each bin of positions that the interval, `reach` longer at both ends, touches."""
    return rows.withColumn("__bin", F.explode(F.sequence(F.floor((F.col("start") - reach) / width), F.floor((F.col("end") + reach) / width))))


def bin_width(features: DataFrame) -> int:
    """Mean length of the features, at least 1: a feature then stands in a few bins."""
    mean = features.agg(F.avg(F.col("end") - F.col("start"))).first()[0]  # one number
    return max(1, int(mean or 0))


def nearest(arrays: DataFrame, features: DataFrame, on: str, array_key: str, position: str, carry: list[str]) -> DataFrame:
    """arrays with the nearest feature of the same parent: `distance` and the features' `carry` columns, null where there is none.

    Both have start and end, start <= end; rows without a parent or an end meet nothing. A tie goes to the feature that comes first by `position`.
    An array meets the features of its own bins; those that end before it or begin after it matter only by the nearest of them, the
    largest end and the smallest start, which running ones over blocks of positions, then over the blocks of a parent, bring to it.
    So no array meets all features of its parent, and a parent with most of the rows is as many groups as it has blocks.
    """
    known = features.where(F.col(on).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull())
    f = known.select(on, "start", "end", F.col(position).alias("__pos"), F.struct(*carry).alias("__carry"))
    a = arrays.select(on, array_key, "start", "end").where(F.col(on).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull())
    width = bin_width(f)
    # Overlaps: of a bin's features each array meets those that touch it.
    fb = _bins(f, width).select(on, "__bin", F.col("start").alias("__s"), F.col("end").alias("__e"), "__pos", "__carry")
    touching = _bins(a, width).join(fb, [on, "__bin"]).where((F.col("__s") <= F.col("end")) & (F.col("__e") >= F.col("start")))
    at = touching.groupBy(array_key).agg(F.min(F.struct(F.lit(0).cast("long").alias("distance"), "__pos", "__carry")).alias("best"))
    # Before and after: one row for each end (or start) of a parent, the first by position, carried along in order of place.
    ends = f.groupBy(on, F.col("end").alias("p")).agg(F.min(F.struct("__pos", "__carry")).alias("__f"))
    starts = f.groupBy(on, F.col("start").alias("p")).agg(F.min(F.struct("__pos", "__carry")).alias("__f"))

    def carried(marks: DataFrame, of: str, back: bool) -> DataFrame:
        rows = marks.select(on, "p", F.lit(None).cast(a.schema[array_key].dataType).alias(array_key), F.struct("p", "__f").alias("m"))
        rows = rows.unionByName(a.select(on, F.col(of).alias("p"), array_key, F.lit(None).cast(rows.schema["m"].dataType).alias("m")))
        rows = rows.withColumn("__block", F.floor(F.col("p") / (width * BLOCK)))
        along = (lambda c: F.col(c).asc()) if back else (lambda c: F.col(c).desc())
        inside = Window.partitionBy(on, "__block").orderBy(along("p"), F.col("m").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        pick = F.max_by if back else F.min_by
        # What a block's rows see of the blocks before it is one mark, found among the blocks alone.
        blocks = rows.groupBy(on, "__block").agg(pick("m", F.when(F.col("m").isNotNull(), F.col("p"))).alias("b"))
        earlier = Window.partitionBy(on).orderBy(along("__block")).rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn("b", F.last("b", ignorenulls=True).over(earlier)).where("b IS NOT NULL")
        seen = rows.withColumn("m", F.last("m", ignorenulls=True).over(inside)).where(F.col(array_key).isNotNull())
        seen = seen.join(blocks, [on, "__block"], "left").withColumn("m", F.coalesce("m", "b")).where("m IS NOT NULL")
        far = (F.col("p") - F.col("m.p")) if back else (F.col("m.p") - F.col("p"))
        return seen.groupBy(array_key).agg(F.min(F.struct(far.cast("long").alias("distance"), F.col("m.__f.__pos").alias("__pos"), F.col("m.__f.__carry").alias("__carry"))).alias("best"))

    best = at.unionByName(carried(ends, "start", True)).unionByName(carried(starts, "end", False)).groupBy(array_key).agg(F.min("best").alias("__best"))
    return arrays.join(best, array_key, "left").select(*arrays.columns, F.col("__best.distance").alias("distance"), *[F.col(f"__best.__carry.{c}").alias(c) for c in carry])


def nearest_in_row(start: Column, end: Column, features: Column) -> Column:
    """The nearest of an array<struct<Start,End,...>> in the same row, first in the list on a tie: no join, no shuffle."""
    keyed = F.transform(features, lambda f, i: F.struct(gap(start, end, f["Start"], f["End"]).alias("distance"), i.alias("pos"), f.alias("feature")))
    return F.array_min(F.transform(keyed, lambda k: F.struct(k["distance"].alias("distance"), k["pos"].alias("pos"))))


def within(arrays: DataFrame, features: DataFrame, on: str, array_key: str, feature_key: str, most: int) -> DataFrame:
    """(on, array_key, feature_key, distance, rank): features within `most`, or all of the parent if it is 0, ranked by (distance, start, end, key).

    With a limit, arrays meet the features of the bins they reach, and of a pair's common bins only the first counts it.
    """
    f = features.select(on, "start", "end", F.col(feature_key).alias("__f"))
    a = arrays.select(on, array_key, "start", "end")
    if most:
        width = max(bin_width(f), most)
        fb = _bins(f.where("start <= end"), width).select(on, "__bin", F.col("start").alias("__s"), F.col("end").alias("__e"), "__f")
        pairs = _bins(a.where("start <= end"), width, most).join(fb, [on, "__bin"])
        first = F.greatest(F.floor((F.col("start") - most) / width), F.floor(F.col("__s") / width))
        pairs = pairs.where(F.col("__bin") == first)
    else:
        pairs = a.join(f.select(on, F.col("start").alias("__s"), F.col("end").alias("__e"), "__f"), on)
    pairs = pairs.withColumn("distance", gap(F.col("start"), F.col("end"), F.col("__s"), F.col("__e"))).withColumnRenamed("__f", feature_key)
    if most:
        pairs = pairs.where(F.col("distance") <= most)
    rank = F.row_number().over(Window.partitionBy(array_key).orderBy("distance", "__s", "__e", feature_key))
    return pairs.select(on, array_key, feature_key, "distance", rank.alias("rank"))
