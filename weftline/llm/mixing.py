"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every document of a source has an expected number of copies: its source's target over what the source holds, shared out by
the documents' weights. The whole part of it is certain. For the fraction, documents are ranked by random odds over
inclusion odds, (U/(1-U)) / (p/(1-p)), and the first ones are taken until the words still wanted are reached: a
fixed-size sample with unequal probabilities. U is a hash of the document's id, so reruns agree.

The cut in a source's ranking is found without sorting the source: ranks are 36-bit integers, and three rounds of counts over
4096 bins (each map-side combined) narrow the cut down to one rank. What one last document leaves over is then filled
by the largest documents that still fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import materialize

#: Distinct sources up to which the per-source table is broadcast; beyond, Spark joins by shuffle.
BROADCAST_SOURCES = 10_000
RANK_BITS, STEP_BITS = 36, 12
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORDS)).cast("long")


def cyclic_weights(sizes: DataFrame, source: str, cycle: int = 3) -> DataFrame:
    """sizes with a weight: 1 to `cycle`, repeating over the sources by code point, null last."""
    order = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last()))
    return sizes.withColumn("weight", ((order - 1) % cycle + 1).cast("long"))


def targets(sizes: DataFrame, source: str, most: int = 3) -> DataFrame:
    """sizes (source, source_size, weight) with `target`: shares of the whole by weight, none above most * source_size, the excess reshared.

    Filling the sources in the order of most * size / weight gives what repeated resharing ends in: a source is at its bound
    exactly if its share of what the sources before leave over reaches the bound.
    """
    bound = F.col("source_size") * most
    order = Window.orderBy(bound / F.col("weight"), F.col(source).asc_nulls_last())
    rows = sizes.withColumns(
        {
            "__left": F.sum("source_size").over(Window.partitionBy()) - (F.sum(bound).over(order.rowsBetween(Window.unboundedPreceding, 0)) - bound),
            "__weights": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    rows = rows.withColumn("__full", bound * F.col("__weights") <= F.col("weight") * F.col("__left"))
    whole, free = Window.partitionBy(), ~F.col("__full")
    left = F.sum("source_size").over(whole) - F.sum(F.when(F.col("__full"), bound).otherwise(0)).over(whole)
    weights = F.sum(F.when(free, F.col("weight")).otherwise(0)).over(whole)
    target = F.when(F.col("__full"), bound.cast("double")).otherwise((F.col("weight") * left).cast("double") / weights)
    return rows.withColumn("target", target).drop("__left", "__weights", "__full")


def _rank(key: Column, p: Column, seed: str) -> Column:
    """Random odds over inclusion odds as an integer of RANK_BITS; null where p is 0."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")
    u = (bits.cast("double") + 0.5) / float(1 << 48)
    odds = (u / (1 - u)) / (p / (1 - p))
    return F.when(p > 0, F.floor(odds / (1 + odds) * float(1 << RANK_BITS)).cast("long"))


def _with(rows: DataFrame, state: DataFrame, source: str, small: bool) -> DataFrame:
    state = state.withColumnRenamed(source, "__source")
    return rows.join(F.broadcast(state) if small else state, rows[source].eqNullSafe(state["__source"]), "left").drop("__source")


def pareto_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, most: int = 3, seed: str = "mix", fill_rounds: int = 3
) -> DataFrame:
    """id, source, size, source_size, target and taken (words, repeats counted) of every row of docs.

    size is the number of words of the text, null counting as empty; a null source is a source. weight (positive integers, one by
    default) raises a document's expected copies within its source. taken is a whole multiple of size, `most` times at most.
    Rows that share an id share their rank: they are taken or left together. Empty documents are never taken. Sources without words
    have target 0. Columns other than id, text and source are ignored; no rows give no rows.
    """
    weight = F.lit(1) if weight is None else weight
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), weight.cast("long").alias("w")
    )
    rows = materialize(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("w")).alias("weighed"))
    goal = materialize(targets(cyclic_weights(sizes, "source"), "source", most), "targets")
    small = goal.count() <= BROADCAST_SOURCES

    expected = F.when(F.col("weighed") > 0, F.least(F.lit(float(most)), F.col("target") * F.col("w") / F.col("weighed"))).otherwise(F.lit(0.0))
    ranked = _with(rows, goal.select("source", "source_size", "weighed", "target"), "source", small)
    ranked = ranked.withColumn("copies", F.floor(expected).cast("long")).withColumn("rank", F.when(F.col("size") > 0, _rank(F.col("id"), expected - F.floor(expected), seed)))
    ranked = ranked.select("id", "source", "size", "source_size", "target", "copies", "rank")
    narrow = ranked.select("source", "size", "copies", "rank")

    # Per source: where its ranking is cut (`low`: ranks below are taken) and how many words are still to come (`gap`).
    state = ranked.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap")).withColumn("low", F.lit(0).cast("long"))
    for shift in range(RANK_BITS - STEP_BITS, -1, -STEP_BITS):
        span = 1 << (shift + STEP_BITS)
        inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + span)
        bins = (
            _with(narrow, state, "source", small)
            .select("source", "gap", "low", F.when(inside, F.shiftright(F.col("rank") - F.col("low"), shift)).otherwise(-1).alias("bin"), "size")
            .groupBy("source", "bin")
            .agg(F.sum("size").alias("words"), F.max("gap").alias("gap"), F.max("low").alias("low"))
        )
        upto = F.sum(F.when(F.col("bin") >= 0, F.col("words")).otherwise(0)).over(Window.partitionBy("source").orderBy("bin"))
        bins = bins.withColumn("upto", upto)
        fits = (F.col("bin") >= 0) & (F.col("upto") <= F.col("gap"))
        state = bins.groupBy("source").agg(
            (F.max("gap") - F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0))).alias("gap"),
            # The first bin that no longer fits, or the end of the span.
            (F.max("low") + F.coalesce(F.min(F.when((F.col("bin") >= 0) & ~fits, F.col("bin"))), F.lit(1 << STEP_BITS)) * (1 << shift)).alias("low"),
        )
        state = materialize(state, f"cut{shift}")
    state = state.withColumn("extra", F.array().cast("array<long>"))
    for n in range(fill_rounds):
        open_ = (F.col("rank") >= F.col("low")) & (F.col("size") <= F.col("gap")) & ~F.array_contains("extra", F.col("rank"))
        state = (
            _with(narrow, state, "source", small)
            .groupBy("source")
            .agg(F.max("gap").alias("gap"), F.max("low").alias("low"), F.first("extra").alias("extra"), F.max(F.when(open_, F.struct("size", (-F.col("rank")).alias("rank")))).alias("best"))
        )
        state = state.select(
            "source", (F.col("gap") - F.coalesce("best.size", F.lit(0))).alias("gap"), "low",
            F.when(F.col("best").isNull(), F.col("extra")).otherwise(F.array_append("extra", -F.col("best.rank"))).alias("extra"),
        )
        state = materialize(state, f"fill{n}")
    taken = F.coalesce((F.col("rank") < F.col("low")) | F.array_contains("extra", F.col("rank")), F.lit(False))
    return _with(ranked, state, "source", small).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("size") * (F.col("copies") + taken.cast("long"))).alias("taken")
    )
