"""Encoding of sequences as token ids, padded batches, pooling and position formulas, simple features with a linear model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import seq
from weftline.operators.index import first_seen_ids

#: The reserved tokens, their ids by place; what no vocabulary knows is N.
RESERVED = ("PAD", "CLS", "SEP", "A", "C", "G", "T", "N")
PAD, CLS, SEP, N = 0, 1, 2, 7


def characters(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, token: upper-cased characters in order."""
    return rows.select(key, F.posexplode(F.split(F.upper(F.col(text)), "")).alias("pos", "token")).where("token <> ''")


def vocabulary(tokens: DataFrame, token: str, order: list[str], reserved: int = len(RESERVED)) -> DataFrame:
    """token, id of the tokens seen: reserved letters keep their ids, the others get ids in first-seen order after the reserved ones."""
    letters = F.array_position(F.array(*map(F.lit, RESERVED)), F.col(token)) - 1
    is_reserved = F.col(token).isin(*RESERVED[SEP + 1 :])
    fixed = tokens.where(is_reserved).select(token).distinct().select(token, letters.alias("id"))
    return fixed.unionByName(first_seen_ids(tokens.where(~is_reserved), token, order).select(token, (F.col("idx") + reserved).alias("id")))


def encode_dna(sequence: Column, cls: bool = False, sep: bool = False) -> Column:
    """The ids of a sequence's letters, upper-cased, anything but A, C, G and T as N; with CLS before and SEP after if asked for. Empty gives no letters."""
    letters = F.filter(F.split(seq.normalize_dna(sequence), ""), lambda x: x != "")
    ids = F.transform(letters, lambda x: (F.array_position(F.array(*map(F.lit, RESERVED)), x) - 1).cast("long"))
    mark = lambda on, v: F.array(F.lit(v).cast("long")) if on else F.array().cast("array<long>")
    return F.concat(mark(cls, CLS), ids, mark(sep, SEP))


def decode_dna(ids: Column) -> Column:
    """The letters of ids; PAD, CLS and SEP are left out, unknown ids are N."""
    kept = F.filter(ids, lambda x: ~x.isin(PAD, CLS, SEP))
    return F.array_join(F.transform(kept, lambda x: F.coalesce(F.get(F.array(*map(F.lit, RESERVED)), x.cast("int")), F.lit("N"))), "")


def encode(tokens: DataFrame, vocab: DataFrame, key: str, unknown: int = N) -> DataFrame:
    """key, ids, n: the sequence's ids in order; tokens outside the vocabulary are `unknown`."""
    rows = tokens.join(vocab, "token", "left").select(key, F.struct("pos", F.coalesce("id", F.lit(unknown).cast("long")).alias("id")).alias("x"))
    ids = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["id"])
    return rows.groupBy(key).agg(ids.alias("ids")).select(key, "ids", F.size("ids").cast("long").alias("n"))


def collate(encoded: DataFrame, batch: str, most: int | None = None, pad: int = 0) -> DataFrame:
    """encoded with padded ids and mask: every sequence as long as the longest of its batch, cut at `most`."""
    cut = F.slice("ids", 1, most) if most else F.col("ids")
    rows = encoded.withColumn("ids", cut)
    width = F.max(F.size("ids")).over(Window.partitionBy(batch))
    rows = rows.withColumn("__w", width)
    fill = lambda v, n: F.array_repeat(F.lit(v).cast("long"), n)
    return rows.withColumns(
        {"padded": F.concat("ids", fill(pad, F.col("__w") - F.size("ids"))), "mask": F.concat(fill(1, F.size("ids")), fill(0, F.col("__w") - F.size("ids")))}
    ).drop("__w")


def encode_example(elements: Column, repeats: Column | None = None, left: Column | None = None, right: Column | None = None) -> dict[str, Column]:
    """The token lists of an example: element_tokens and repeat_tokens (a list a string), their lengths, n_elements, left_tokens and right_tokens.

    Repeats and flanks that are not given, and null ones, are empty lists; a null string among the elements is an empty one and keeps its place.
    """
    none = F.array().cast("array<string>")
    lists = lambda a: F.transform(none if a is None else F.coalesce(a, none), lambda x: encode_dna(F.coalesce(x, F.lit(""))))
    flank = lambda x: encode_dna(F.lit("") if x is None else F.coalesce(x, F.lit("")))
    e, r = lists(elements), lists(repeats)
    sizes = lambda t: F.transform(t, lambda x: F.size(x))
    return {
        "element_tokens": e, "element_lengths": sizes(e), "repeat_tokens": r, "repeat_lengths": sizes(r), "n_elements": F.size(e),
        "left_tokens": flank(left), "right_tokens": flank(right),
    }


def collate_examples(rows: DataFrame, batch: str, pad: int = PAD) -> DataFrame:
    """rows of `encode_example` padded on both axes to the largest of their batch, with element_mask (1 for an element, 0 for a row of padding).

    Repeats have as many rows as elements: what a batch's longest list of elements does not reach is cut. Flanks are as long as the longest
    of either side. Lists of numbers other than ids (dense vectors) are padded alike. A null batch is a batch. The batch's sizes are an
    aggregation with map-side combine and a join, so no batch is held by one task.
    """
    longest = lambda c: F.coalesce(F.max(F.array_max(F.transform(c, lambda x: F.size(x)))), F.lit(0))
    sizes = rows.groupBy(F.col(batch).alias("__b")).agg(
        F.max(F.size("element_tokens")).alias("__n"), longest("element_tokens").alias("__e"), longest("repeat_tokens").alias("__r"), F.max(F.greatest(F.size("left_tokens"), F.size("right_tokens"))).alias("__f")
    )
    out = rows.join(sizes, rows[batch].eqNullSafe(sizes["__b"]))

    def filled(x: Column, width: Column, kind: str) -> Column:
        return F.concat(x, F.array_repeat(F.lit(pad).cast(kind), width - F.size(x)))

    def both_axes(name: str, width: str) -> Column:
        kind = rows.schema[name].dataType.elementType.elementType.simpleString()
        cut = F.transform(F.slice(name, F.lit(1), F.col("__n")), lambda x: filled(x, F.col(width), kind))
        return F.concat(cut, F.array_repeat(F.array_repeat(F.lit(pad).cast(kind), F.col(width)), F.col("__n") - F.size(cut)))

    n = F.size("element_tokens")
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.col("__n") - n))
    flank = {f"{side}_tokens": filled(F.col(f"{side}_tokens"), F.col("__f"), "bigint") for side in ("left", "right")}
    padded = {"element_mask": mask, "element_tokens": both_axes("element_tokens", "__e"), "repeat_tokens": both_axes("repeat_tokens", "__r"), **flank}
    return out.withColumns(padded).drop("__b", "__n", "__e", "__r", "__f")


def pool(vectors: Column, kind: str, weights: Column | None = None) -> Column:
    """Mean, max or weighted sum (softmax of `weights`) of an array of vectors, component by component."""
    zip_ = lambda f: (lambda a, b: F.zip_with(a, b, f))
    first = F.try_element_at(vectors, F.lit(1))
    rest = F.slice(vectors, F.lit(2), F.size(vectors))
    if kind == "max":
        return F.aggregate(rest, first, zip_(lambda x, y: F.greatest(x, y)))
    if kind == "mean":
        return F.transform(F.aggregate(rest, first, zip_(lambda x, y: x + y)), lambda x: x / F.size(vectors))
    soft = softmax(weights)
    scaled = F.transform(vectors, lambda v, i: F.transform(v, lambda x: x * F.get(soft, i)))
    return F.aggregate(F.slice(scaled, F.lit(2), F.size(scaled)), F.try_element_at(scaled, F.lit(1)), zip_(lambda x, y: x + y))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def alibi_slopes(heads: int) -> list[float]:
    """2^(-8k/heads) for heads 1 to `heads`, a power of two; otherwise those of the power below, then every other one of twice that."""
    below = 1 << (heads.bit_length() - 1)
    own = [2.0 ** (-8.0 * (k + 1) / below) for k in range(below)]
    return own if below == heads else own + alibi_slopes(2 * below)[::2][: heads - below]


def alibi_bias(i: Column, j: Column, length: Column, slope: float) -> Column:
    """Signed: slope * (j - i) / (length - 1)."""
    return F.lit(slope) * (j - i) / F.greatest(length - 1, F.lit(1))


def rotate(vector: Column, position: Column, base: float = 10000.0) -> Column:
    """Rotary positions: components 2k and 2k+1 turn by position * base^(-2k/dim), dim the even part of the size; the last of an odd number stays."""
    dim = F.size(vector) - F.size(vector) % 2
    angle = lambda k: position * F.pow(F.lit(base), -2.0 * k / dim)

    def turn(x: Column, i: Column) -> Column:
        k = F.floor(i / 2)
        a = angle(k)
        odd = F.get(vector, F.when(i % 2 == 0, i + 1).otherwise(i - 1))
        return F.when(i >= dim, x).when(i % 2 == 0, x * F.cos(a) - odd * F.sin(a)).otherwise(odd * F.sin(a) + x * F.cos(a))

    return F.transform(vector, turn)


def array_features(elements: Column) -> dict[str, Column]:
    """Length and composition of an array of strings: count, total, mean and population deviation of lengths, GC."""
    lengths = F.transform(elements, lambda x: F.length(x).cast("double"))
    n = F.size(elements)
    total = F.aggregate(lengths, F.lit(0.0), lambda a, b: a + b)
    mean = F.try_divide(total, n)
    var = F.try_divide(F.aggregate(F.transform(lengths, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, b: a + b), n)
    return {"n": n.cast("long"), "total": total.cast("long"), "mean_len": mean, "std_len": F.sqrt(var), "gc": seq.gc_fraction(F.array_join(elements, ""))}


def class_statistics(rows: DataFrame, label: str, features: list[str]) -> DataFrame:
    """feature, min, max, mean, std overall, the two classes' means and their absolute and relative difference."""
    out = None
    for f in features:
        zero, one = (F.avg(F.when(F.col(label) == k, F.col(f))) for k in (0, 1))
        row = rows.agg(
            F.lit(f).alias("feature"), F.min(f).cast("double").alias("min"), F.max(f).cast("double").alias("max"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("std"),
            zero.alias("mean_0"), one.alias("mean_1"), F.abs(one - zero).alias("difference"), F.try_divide(F.abs(one - zero), F.abs(F.avg(f))).alias("relative"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def logistic_cv(rows: DataFrame, key: str, label: str, features: list[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """feature, coefficient (largest first) of a ridge logistic fit on all rows, and the accuracy over folds by hash."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=features, outputCol="x").transform(rows.select(key, F.col(label).cast("double").alias("y"), *features).na.drop())
    data = data.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds))).cache()
    fit = lambda d: LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / max(1, d.count()), standardization=False, maxIter=100).fit(d)
    hits = []
    for k in range(folds):
        test, train = data.where(F.col("fold") == k), data.where(F.col("fold") != k)
        if test.limit(1).count() and train.select("y").distinct().count() == 2:
            hits.append(fit(train).transform(test).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0])
    weights = fit(data).coefficients.toArray().tolist()
    data.unpersist()
    out = [(f, float(w), math.fsum(hits) / max(1, len(hits))) for f, w in sorted(zip(features, weights, strict=True), key=lambda p: -abs(p[1]))]
    return rows.sparkSession.createDataFrame(out, "feature string, coefficient double, cv_accuracy double")


def histogram(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Counts of each value, in each group."""
    return rows.groupBy(*(by or []), value).agg(F.count(F.lit(1)).alias("n"))


def binned(rows: DataFrame, value: str, least: int = 5, most: int = 30) -> DataFrame:
    """bin (from 0), low and n over min(most, max(least, distinct values)) bins of equal width; the highest value is in the last bin."""
    ends = rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"), F.least(F.lit(most), F.greatest(F.lit(least), F.count_distinct(value))).alias("bins"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.col("bins") - 1)).cast("long")
    x = rows.join(F.broadcast(ends)).select(b.alias("bin"), "lo", width.alias("w"))  # ends is one row
    return x.groupBy("bin").agg((F.first("lo") + F.col("bin") * F.first("w")).alias("low"), F.count(F.lit(1)).alias("n"))
