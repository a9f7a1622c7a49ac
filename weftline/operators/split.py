"""Leakage-safe splits and folds. Order within a stratum is md5(seed|key), the same in any engine and for any partitioning.

Units (a signature, a group or a component of both) never span two splits, but for by_label_and_stratum, which cuts rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import labels
from weftline.operators.cluster import group_or_signature_components


def hashed(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def half_even(n: Column, share: float) -> Column:
    return F.rint(n * float(share)).cast("long")


def cut_rule(name: str, n: Column, share: float) -> Column:
    """How many of n go: `floor1` at least one; `keep1` none of one, at least one and all but one at most; `most1` the same but the one that is alone; `plain` rounded."""
    r = half_even(n, share)
    return {
        "plain": lambda: r,
        "floor1": lambda: F.greatest(F.lit(1), r),
        "most1": lambda: F.when(n <= 1, n).otherwise(F.least(n - 1, F.greatest(F.lit(1), r))),
        "keep1": lambda: F.when(n <= 1, F.lit(0)).otherwise(F.least(n - 1, F.greatest(F.lit(1), r))),
    }[name]()


def units(rows: DataFrame, unit: str, stratum: str | None = None) -> DataFrame:
    """unit and its stratum, the most frequent of its rows (the smallest on ties)."""
    if stratum is None:
        return rows.select(unit).distinct().withColumn("stratum", F.lit("all"))
    return rows.groupBy(unit).agg(F.mode(stratum, True).alias("stratum"))


def cut(units_: DataFrame, unit: str, parts: list[tuple[str, str, float]], rest: str, seed: int) -> DataFrame:
    """unit, split: in each stratum the first ones by hash go to the first part, the next to the second, what is left to `rest`.

    parts: (name, cut rule, share). A part never takes more than is left.
    """
    w = Window.partitionBy("stratum")
    rows = units_.withColumns({"__n": F.count(F.lit(1)).over(w), "__r": F.row_number().over(w.orderBy(hashed(F.col(unit), seed), unit))})
    split, end = F.lit(rest), F.lit(0).cast("long")
    bounds = []
    for name, rule, share in parts:
        end = F.least(F.col("__n"), end + cut_rule(rule, F.col("__n"), share))
        bounds.append((name, end))
    for name, e in reversed(bounds):
        split = F.when(F.col("__r") <= e, name).otherwise(split)
    return rows.select(unit, "stratum", split.alias("split"))


def split_groups(rows: DataFrame, group: str, seed: int, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Groups 70 / 15 / 15, training and validation at least one each."""
    return cut(units(rows, group), group, [("train", "floor1", train), ("val", "floor1", val)], "test", seed)


def stratified_holdout(rows: DataFrame, unit: str, stratum: str, share: float, seed: int) -> DataFrame:
    """Test share of each stratum; a stratum of one stays whole in dev."""
    return cut(units(rows, unit, stratum), unit, [("test", "keep1", share)], "dev", seed)


def stratified_three_way(rows: DataFrame, unit: str, stratum: str, seed: int, train: float = 0.8, test: float = 0.1) -> DataFrame:
    return cut(units(rows, unit, stratum), unit, [("train", "floor1", train), ("test", "plain", test)], "val", seed)


def train_test_by_stratum(rows: DataFrame, unit: str, stratum: str, seed: int, share: float = 0.2) -> DataFrame:
    return cut(units(rows, unit, stratum), unit, [("test", "keep1", share)], "train", seed)


def train_test_by_label(rows: DataFrame, unit: str, label: str, seed: int, share: float = 0.2) -> DataFrame:
    return cut(units(rows, unit, label), unit, [("test", "floor1", share)], "train", seed)


def by_label_and_stratum(rows: DataFrame, key: str, stratum: str, label: str, seed: int, share: float = 0.2) -> DataFrame:
    """Rows cut within (stratum, label). Duplicates may span splits: the one splitter without a unit."""
    named = rows.select(key, F.concat_ws("|", F.col(stratum).cast("string"), F.col(label).cast("string")).alias("stratum"))
    return cut(named, key, [("test", "keep1", share)], "train", seed)


def dev_pool(rows: DataFrame, unit: str, stratum: str, mode: str, seed: int, share: float = 0.8) -> DataFrame:
    """Development units into train and val, by stratum, by label or without either."""
    if mode == "group":
        return cut(units(rows, unit), unit, [("train", "floor1", share)], "val", seed)
    return cut(units(rows, unit, stratum), unit, [("train", "keep1" if mode == "stratum" else "floor1", share)], "val", seed)


def dev_of_components(rows: DataFrame, key: str, group: str, signature: list[str], stratum: str, seed: int, share: float = 0.8) -> DataFrame:
    """key, component, stratum, split (train_test or val): rows linked by a group or a signature, directly or through others, stay together.

    Components are cut by hash within the stratum that most of their rows have (the smallest on ties; null and empty count as Unknown): `share` of
    them, at least one and all but one at most, to train_test; one that is alone goes there too. Blank groups link nothing.
    """
    named = rows.withColumns({"__s": labels.subtype_key(F.col(stratum)), "__g": F.nullif(F.trim(F.col(group)), F.lit(""))})
    found = group_or_signature_components(named, key, "__g", signature)
    of = named.select(F.col(key).alias("__k"), "__s").join(found, F.col("__k") == F.col(key)).select(key, "component", "__s")
    done = cut(units(of, "component", "__s"), "component", [("train_test", "most1", share)], "val", seed)
    return of.select(key, "component").join(done, "component")


def folds(rows: DataFrame, unit: str, stratum: str, k: int, seed: int) -> DataFrame:
    """unit, stratum, fold: round robin over the hash order in each stratum."""
    u = units(rows, unit, stratum)
    r = F.row_number().over(Window.partitionBy("stratum").orderBy(hashed(F.col(unit), seed), unit))
    return u.select(unit, "stratum", ((r - 1) % k).cast("long").alias("fold"))


def use_fold(folded: DataFrame, k: int) -> DataFrame:
    return folded.withColumn("split", F.when(F.col("fold") == k, "val").otherwise("train"))


def leaks(rows: DataFrame, unit: str, split: str) -> DataFrame:
    """Units that span splits, with the number of splits."""
    return rows.groupBy(unit).agg(F.count_distinct(split).alias("splits")).where("splits > 1")
