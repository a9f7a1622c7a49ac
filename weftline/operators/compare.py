"""Comparison of two tools' calls and of clusterings: agreement, coverage, contingency, adjusted Rand index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import labels
from weftline.functions.seq import round_half_even

SINGLETON = "singleton"


def pct(part: Column, whole: Column) -> Column:
    """Percent with two digits; null for an empty whole."""
    return round_half_even(F.try_divide(100.0 * part, whole), 2)


def outer_calls(a: DataFrame, b: DataFrame, name: str, a_call: str, b_call: str, carry: list[str], annotations: DataFrame | None = None) -> DataFrame:
    """Full outer join of two tools' calls by name, missing calls Unknown, with the agreement and optional annotations."""
    rows = a.select(name, a_call).join(b.select(name, b_call, *carry), name, "full_outer")
    rows = rows.withColumns({a_call: labels.fill(F.col(a_call)), b_call: labels.fill(F.col(b_call))})
    rows = rows.withColumn("agreement", labels.agreement(F.col(a_call), F.col(b_call)))
    return rows if annotations is None else rows.join(annotations, name, "left")


def not_singleton(group: str) -> Column:
    """Rows outside the singleton group; rows without a group stay."""
    return ~F.col(group).eqNullSafe(F.lit(SINGLETON))


def _pair_counts(a: str, b: str, on: Column, prefix: str = "") -> list[Column]:
    """The counts behind `_pair_shown`, of the rows where `on` holds."""
    A, B = F.col(a) != labels.UNKNOWN, F.col(b) != labels.UNKNOWN
    both, same = on & A & B, F.col(a) == F.col(b)
    counts = {
        "total": on, "comparable": both, "agree": both & same, "disagree": both & ~same, "a_only": on & A & ~B, "b_only": on & ~A & B, "neither": on & ~A & ~B, "a_called": on & A, "b_called": on & B,
    }
    return [F.count_if(c).alias(f"__{prefix}{k}") for k, c in counts.items()]


def _pair_shown(prefix: str = "") -> list[Column]:
    c = lambda k: F.col(f"__{prefix}{k}")
    shown = {k: c(k) for k in ("total", "comparable", "agree", "disagree", "a_only", "b_only", "neither")} | {
        "n_skipped": c("total") - c("comparable"), "pct_disagree": pct(c("disagree"), c("comparable")), "pct_full_agree": pct(c("agree") + c("neither"), c("total")),
        "pct_agree": pct(c("agree"), c("comparable")), "pct_effective": pct(c("agree"), c("total")), "pct_coverage": pct(c("comparable"), c("total")),
        "pct_asymmetric": pct(c("a_only") + c("b_only"), c("total")), "pct_a_only": pct(c("a_only"), c("total")), "pct_b_only": pct(c("b_only"), c("total")),
        "pct_a_called": pct(c("a_called"), c("total")), "pct_b_called": pct(c("b_called"), c("total")),
    }
    return [v.alias(prefix + k) for k, v in shown.items()]


def pair_stats(rows: DataFrame, a: str, b: str, by: list[str] | None = None, where: Column | None = None, prefix: str = "") -> DataFrame:
    """Agreement and coverage of two columns of calls, in one aggregation, overall or per stratum.

    effective counts agreements and one-sided Unknowns' comparables against all rows; asymmetric ones have a call of one tool only.
    """
    on = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return rows.groupBy(*(by or [])).agg(*_pair_counts(a, b, on, prefix)).select(*(by or []), *_pair_shown(prefix))


def strata_report(rows: DataFrame, a: str, b: str, kind: str, subkind: str, group: str) -> DataFrame:
    """level (overall, type, subtype), stratum, modal_type and the statistics of `pair_stats`, with and without singletons (ns_), of every stratum.

    All levels and both regimes come from one read and one shuffle, by grouping sets. Rows without a type or subtype are a stratum of their
    own, called Unknown; modal_type is a subtype's most frequent type, the smallest on ties, Unknown if none, and null on other levels.
    """
    own = rows.withColumns({"__kind": F.col(kind), "__k": F.col(kind), "__s": F.col(subkind)})
    got = own.groupingSets([[], ["__k"], ["__s"]], "__k", "__s").agg(
        F.grouping("__k").alias("__no_k"), F.grouping("__s").alias("__no_s"), modal("__kind").alias("__modal"), *_pair_counts(a, b, F.lit(True)), *_pair_counts(a, b, not_singleton(group), "ns_")
    )
    of_kind, of_subkind = F.col("__no_k") == 0, F.col("__no_s") == 0
    return got.select(
        F.when(of_kind, "type").when(of_subkind, "subtype").otherwise("overall").alias("level"), F.when(of_kind, labels.fill(F.col("__k"))).when(of_subkind, labels.fill(F.col("__s"))).alias("stratum"),
        F.when(of_subkind, labels.fill(F.col("__modal"))).alias("modal_type"), *_pair_shown(), *_pair_shown("ns_"),
    )


def confidence(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Number and share of rows with a call, for each tool, both and either; shares are null without rows."""
    A, B = F.col(a) != labels.UNKNOWN, F.col(b) != labels.UNKNOWN
    n = F.count(F.lit(1))
    calls = {"a": A, "b": B, "both": A & B, "either": A | B}
    return rows.agg(n.alias("total"), *[F.count_if(c).alias(f"n_{k}") for k, c in calls.items()], *[pct(F.count_if(c), n).alias(f"{k}_pct") for k, c in calls.items()])


def group_confidence(rows: DataFrame, group: str, call: str, order: list[str]) -> DataFrame:
    """Groups (singletons and missing ones out) and how many have a call: the first one by order that is not null."""
    first = rows.where(F.col(group).isNotNull() & not_singleton(group)).where(F.col(call).isNotNull()).groupBy(group).agg(F.min_by(call, F.struct(*order)).alias("call"))
    return first.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("call") != labels.UNKNOWN).alias("confident"), pct(F.count_if(F.col("call") != labels.UNKNOWN), F.count(F.lit(1))).alias("confident_pct"))


def crosstab(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Long form: a, b, n, nulls Unknown."""
    return rows.groupBy(labels.fill(F.col(a)).alias(a), labels.fill(F.col(b)).alias(b)).agg(F.count(F.lit(1)).alias("n"))


def crosstab_wide(rows: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """One row for each a, a count for each listed b."""
    filled = rows.select(labels.fill(F.col(a)).alias(a), labels.fill(F.col(b)).alias("__b"))
    return filled.groupBy(a).agg(*[F.count_if(F.col("__b") == v).alias(v) for v in values])


def modal(x: str) -> Column:
    """Most frequent value, the smallest on ties."""
    return F.mode(x, True)


def macro_average(strata: DataFrame, columns: list[str]) -> DataFrame:
    """Unweighted mean over strata with something to compare; nulls are skipped."""
    return strata.where("comparable > 0").agg(F.count(F.lit(1)).alias("strata"), *[round_half_even(F.avg(c), 2).alias(f"macro_{c}") for c in columns])


def agreement_matrix(calls: DataFrame, name: str, clustering: str, call: str) -> DataFrame:
    """a, b, pct for each pair of clusterings over the names both call (neither Unknown nor Singleton); 100 on the diagonal, null if none."""
    usable = calls.where(~F.col(call).isin(labels.UNKNOWN, "Singleton"))
    x = usable.select(name, F.col(clustering).alias("a"), F.col(call).alias("ca"))
    y = usable.select(name, F.col(clustering).alias("b"), F.col(call).alias("cb"))
    got = x.join(y, name).where("a <> b").groupBy("a", "b").agg(pct(F.count_if(F.col("ca") == F.col("cb")), F.count(F.lit(1))).alias("pct"))
    names = calls.select(F.col(clustering).alias("a")).distinct()
    cells = names.join(names.withColumnRenamed("a", "b"))  # clusterings are a handful
    return cells.join(got, ["a", "b"], "left").select("a", "b", F.when(F.col("a") == F.col("b"), 100.0).otherwise(F.col("pct")).alias("pct"))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n and ari (four digits) from sums over the contingency table. No row for fewer than two items."""
    two = lambda c: F.sum(c.cast("double") * (c - 1) / 2)
    cells = contingency(rows, a, b)
    s = cells.agg(two(F.col("n")).alias("s"), F.sum("n").alias("n"))
    sa = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("sa"))
    sb = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(two(F.col("n")).alias("sb"))
    c = F.col
    expected = c("sa") * c("sb") / (c("n").cast("double") * (c("n") - 1) / 2)
    top, bottom = c("s") - expected, (c("sa") + c("sb")) / 2 - expected
    ari = F.when((c("s") == c("sa")) & (c("s") == c("sb")), 1.0).otherwise(F.try_divide(top, bottom))
    return s.join(sa).join(sb).where("n >= 2").select("n", round_half_even(ari, 4).alias("ari"))


def overlap_stats(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n_shared rows with a group on both sides, the groups of either side, and how many of these are in one group of the other side or in several.

    A group of a in several of b is split; a group of b in several of a is merged.
    """
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("__n"))

    def side(one: str, other: str, name: str, apart: str) -> DataFrame:
        groups = both.groupBy(one).agg(F.count(F.lit(1)).alias("k"), F.sum("__n").alias("__n"))
        return groups.agg(F.count(F.lit(1)).alias(f"n_clusters_{name}"), F.count_if(F.col("k") == 1).alias(f"intact_{name}"), F.count_if(F.col("k") > 1).alias(f"{apart}_{name}"), F.coalesce(F.sum("__n"), F.lit(0)).alias("n_shared"))

    return side(a, b, "a", "split").join(side(b, a, "b", "merged").drop("n_shared"))  # one row each


def forward_fractions(rows: DataFrame, group: str, call: str) -> DataFrame:
    """n, forward share of all its rows, Unknown ones too, and kind (all_forward, all_reverse if none is Forward, mixed) of each group."""
    x = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg((labels.fill(F.col(call)) == "Forward").cast("double")).alias("forward"))
    return x.select(group, "n", "forward", F.when(F.col("forward") == 1, "all_forward").when(F.col("forward") == 0, "all_reverse").otherwise("mixed").alias("kind"))


def chi_square_2x2(rows: DataFrame, x: str, y: str) -> DataFrame:
    """n and chi2 with Yates's correction; null unless both columns have exactly two values (null aside)."""
    rows = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = rows.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count_distinct(x).alias("nx"), F.count_distinct(y).alias("ny"))
    cell = lambda p, q: F.count_if((F.col(x) == F.col(p)) & (F.col(y) == F.col(q))).cast("double")
    t = rows.join(F.broadcast(ends)).agg(  # ends is one row
        cell("x0", "y0").alias("a"), cell("x0", "y1").alias("b"), cell("x1", "y0").alias("c"), cell("x1", "y1").alias("d"), F.max("nx").alias("nx"), F.max("ny").alias("ny"), F.count(F.lit(1)).alias("n")
    )
    a, b, c, d, n = (F.col(k) for k in "abcdn")
    excess = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    chi = F.try_divide(n * excess * excess, (a + b) * (c + d) * (a + c) * (b + d))
    return t.select("n", F.when((F.col("nx") == 2) & (F.col("ny") == 2), chi).alias("chi2"))


def chi_square_p(chi2: float) -> float:
    """p of a chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(chi2 / 2))


def flip_correction(calls: DataFrame, flips: DataFrame, reference: DataFrame, name: str, call: str, truth: str) -> DataFrame:
    """Agreement with the reference before and after swapping the calls of flipped arrays; a missing flip is none."""
    rows = calls.join(flips, name, "left").withColumn("corrected", F.when(F.coalesce("was_flipped", F.lit(False)), labels.flip(F.col(call))).otherwise(F.col(call))).join(reference, name)
    known = rows.where(F.col(call).isin("Forward", "Reverse") & F.col(truth).isin("Forward", "Reverse"))
    n = F.count(F.lit(1))
    return known.agg(n.alias("n"), F.count_if(F.col(call) == F.col(truth)).alias("before"), F.count_if(F.col("corrected") == F.col(truth)).alias("after"), pct(F.count_if(F.col(call) == F.col(truth)), n).alias("before_pct"), pct(F.count_if(F.col("corrected") == F.col(truth)), n).alias("after_pct"))


def size_stats(sizes: DataFrame, size: str = "n", by: list[str] | None = None) -> DataFrame:
    """Number, median, upper median, max and mean of cluster sizes, and how many are single."""
    n = F.count(F.lit(1))
    ordered = Window.partitionBy(*(by or [])).orderBy(size)
    ranked = sizes.withColumns({"__r": F.row_number().over(ordered), "__m": n.over(Window.partitionBy(*(by or [])))})
    return ranked.groupBy(*(by or [])).agg(
        n.alias("clusters"), F.median(size).alias("median"), F.max(F.when(F.col("__r") == F.expr("__m div 2 + 1"), F.col(size))).alias("upper_median"), F.max(size).alias("largest"),
        F.avg(size).alias("mean"), F.count_if(F.col(size) == 1).alias("singletons"),
    )
