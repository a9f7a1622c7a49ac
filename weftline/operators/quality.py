"""Duplicate summaries, ranking metrics, confusion matrices, run comparison and early stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.index import first_seen_ids


def collapse_summary(rows: DataFrame, signature: list[str], order: str, stratum: str) -> DataFrame:
    """stratum, before, after, removed and the number of signatures found in several strata.

    The row that stays of a signature is the first by `order`; which stratum it is in comes from an aggregation, so no group of duplicates
    meets in one task.
    """
    groups = rows.groupBy(*signature).agg(F.count(F.lit(1)).alias("n"), F.min_by(stratum, order).alias("__stays"), (F.min(stratum) != F.max(stratum)).alias("__across"))
    before = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("before"))
    after = groups.groupBy(F.col("__stays").alias(stratum)).agg(F.count(F.lit(1)).alias("after"))
    across = groups.agg(F.count_if("__across").alias("cross_groups"))
    out = before.join(after, stratum, "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return out.select(stratum, "before", "after", (F.col("before") - F.col("after")).alias("removed")).join(F.broadcast(across))  # one row


def cross_strata(rows: DataFrame, signature: list[str], order: str, stratum: str) -> DataFrame:
    """signature, first (its smallest `order`), stays (that row's stratum), removed and counts (a map of stratum to rows) of duplicates in several strata.

    Rows are counted by signature and stratum before a signature's strata meet, so the map is as long as there are strata. Null and empty strata are Unknown.
    """
    named = rows.select(*signature, order, F.coalesce(F.nullif(F.col(stratum).cast("string"), F.lit("")), F.lit("Unknown")).alias("__s"))
    counts = named.groupBy(*signature, "__s").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__o"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("__s", "n"))))
    first = F.min(F.struct("__o", "__s"))
    groups = counts.groupBy(*signature).agg(F.count(F.lit(1)).alias("__k"), first.alias("__f"), (F.sum("n") - 1).alias("removed"), entries.alias("counts")).where("__k > 1")
    return groups.select(*signature, F.col("__f.__o").alias("first"), F.col("__f.__s").alias("stays"), "removed", "counts")


def ranking_metrics(rows: DataFrame, y: str, score: str, by: list[str] | None = None) -> DataFrame:
    """n, positives, auc and average_precision, null with one class; ties share ranks.

    Rows of equal score are counted first, so the windows run over distinct scores only.
    """
    by = by or []
    steps = rows.groupBy(*by, score).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("q"))
    up = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*by).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumns({"below": F.sum("q").over(up) - F.col("q"), "tp": F.sum("p").over(down), "fp": F.sum("q").over(down)})
    wins = F.sum(F.col("p") * (F.col("below") + F.col("q") / 2.0))
    gain = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    P, Q = F.sum("p"), F.sum("q")
    both = (P > 0) & (Q > 0)
    return steps.groupBy(*by).agg(
        (P + Q).alias("n"), P.alias("positives"), F.when(both, wins / (P * Q)).alias("auc"), F.when(both, gain / P).alias("average_precision")
    )


def threshold_metrics(rows: DataFrame, y: str, yhat: str, by: list[str] | None = None) -> DataFrame:
    """n, accuracy, precision, recall, f1 (0 where undefined), positive rates and the majority baseline."""
    n = F.count(F.lit(1)).cast("double")
    tp, fp, fn = (F.count_if((F.col(y) == a) & (F.col(yhat) == b)).cast("double") for a, b in ((1, 1), (0, 1), (1, 0)))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    pos = F.count_if(F.col(y) == 1).cast("double")
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(F.col(y) == F.col(yhat)) / n).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (pos / n).alias("positive_rate"), ((tp + fp) / n).alias("predicted_rate"), (F.greatest(pos, n - pos) / n).alias("majority"),
    )


def confusion(rows: DataFrame, y: str, yhat: str) -> DataFrame:
    """y, yhat, n, share of the row and of all."""
    cells = rows.groupBy(y, yhat).agg(F.count(F.lit(1)).alias("n"))
    return cells.select(y, yhat, "n", (F.col("n") / F.sum("n").over(Window.partitionBy(y))).alias("row_share"), (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def early_stop(losses: DataFrame, run: str, epoch: str, loss: str, patience: int) -> DataFrame:
    """run, epoch, loss, best so far, improved (strictly), waited epochs, stopped (from the first epoch that waited `patience`)."""
    order = Window.partitionBy(run).orderBy(epoch)
    before = F.min(loss).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = losses.withColumn("improved", F.coalesce(F.col(loss) < before, F.lit(True))).withColumn("best", F.min(loss).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.when(F.col("improved"), F.col(epoch))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("waited", F.col(epoch) - last)
    stop = F.min(F.when(F.col("waited") >= patience, F.col(epoch))).over(Window.partitionBy(run))
    return rows.select(run, epoch, loss, "best", "improved", "waited", F.coalesce(F.col(epoch) >= stop, F.lit(False)).alias("stopped"))


def plateau_rates(losses: DataFrame, run: str, epoch: str, loss: str, rate: float, factor: float = 0.5, patience: int = 3, least: float = 1e-6) -> DataFrame:
    """run, final_rate: the rate is cut when more than `patience` epochs in a row are not better than the best by a ten-thousandth of it. One ordered fold a run (a run is a few hundred epochs)."""
    seq = losses.groupBy(run).agg(F.transform(F.sort_array(F.collect_list(F.struct(epoch, loss))), lambda x: x[loss]).alias("l"))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(float(rate)).alias("rate"))

    def step(s: Column, x: Column) -> Column:
        better = x < s["best"] * (1 - 1e-4)
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        cut = bad > patience
        return F.struct(F.when(better, x).otherwise(s["best"]).alias("best"), F.when(cut, 0).otherwise(bad).alias("bad"), F.when(cut, F.greatest(s["rate"] * factor, F.lit(least))).otherwise(s["rate"]).alias("rate"))

    return seq.select(run, F.aggregate("l", start, step)["rate"].alias("final_rate"))


def best_runs(runs: DataFrame, name: str, order: str, highest: list[str], lowest: list[str]) -> DataFrame:
    """metric, best run and its value; NaN and null are ignored, the first run wins ties."""
    out = None
    for metric, sign in [*((m, -1) for m in highest), *((m, 1) for m in lowest)]:
        known = runs.where(F.col(metric).isNotNull() & ~F.isnan(metric))
        key = F.struct((sign * F.col(metric)).alias("v"), F.col(order).alias("o"))
        one = known.agg(F.lit(metric).alias("metric"), F.min_by(name, key).alias("run"), F.min_by(metric, key).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def reliable_strata(rows: DataFrame, stratum: str, n: str, least: int = 5) -> DataFrame:
    return rows.groupBy(stratum).agg(F.max(n).alias("most")).where(F.col("most") >= least)


def compare_runs(rows: DataFrame, run: str, order: str, stratum: str, n: str, metrics: list[str], least: int = 5) -> DataFrame:
    """A row for each stratum with `least` rows or more in some run: stratum, n (the most of any run) and, for each metric, a map of run to value and the best run.

    Rows: a run's figures for a stratum, one each. NaN and null are no value; the first run by `order` wins ties; without any value there is no best run.
    """
    known = lambda m: F.col(m).isNotNull() & ~F.isnan(m)
    best = lambda m: F.min_by(run, F.when(known(m), F.struct((-F.col(m)).alias("v"), F.col(order).alias("o"))))
    entries = lambda m: F.map_from_entries(F.sort_array(F.collect_list(F.when(known(m), F.struct(F.col(run), F.col(m).alias("v"))))))
    of_metric = [c for m in metrics for c in (entries(m).alias(m), best(m).alias(f"best_{m}"))]
    return rows.groupBy(stratum).agg(F.max(n).alias("n"), *of_metric).where(F.col("n") >= least)


def pages(strata: DataFrame, stratum: str, per_page: int = 4) -> DataFrame:
    """stratum, page, place of the distinct strata in their order, per_page a page."""
    numbered = first_seen_ids(strata.where(F.col(stratum).isNotNull()), stratum, [stratum])
    return numbered.select(stratum, F.expr(f"idx div {per_page}").alias("page"), (F.col("idx") % per_page).alias("place"))


def log_loss(rows: DataFrame, label: str, score: str, by: list[str] | None = None, least: float = 1e-7) -> DataFrame:
    """n and the mean binary cross-entropy of scores, kept `least` away from 0 and 1; rows without label or score are left out."""
    known = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    p = F.least(F.greatest(F.col(score), F.lit(least)), F.lit(1 - least))
    return known.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(-(F.col(label) * F.log(p) + (1 - F.col(label)) * F.log(1 - p))).alias("loss"))
