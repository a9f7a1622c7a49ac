"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Each step only looks at rows that the step before left with company: the prefix is hashed for rows whose length others have,
and counted with that length; the survivors are marked in a bitmap of fixed size, which the last scan consults by a
broadcast join, so that the full hash is taken only for rows that may have a copy. A false mark costs one needless hash,
never a wrong result. Texts are not shuffled while the groups of copies are few enough to be sent to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.runtime import materialize

#: Lengths, and groups of copies, up to which they are broadcast; beyond, joins shuffle.
BROADCAST_LENGTHS, BROADCAST_GROUPS = 500_000, 200_000
#: Bits in one row of the survivors' bitmap, as bitmap_construct_agg has them.
ROW_BITS = 32768


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def _refine(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    """(length, prefix hash) of the groups that steps one and two leave with at least two rows."""
    text = _text(text_col)
    by_len = materialize(docs.select(F.octet_length(text).alias("len")).groupBy("len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("len"), "lengths")
    wanted = F.broadcast(by_len) if by_len.count() <= BROADCAST_LENGTHS else by_len
    rows = docs.select(F.octet_length(text).alias("len"), F.substring(text, 1, prefix_chars).alias("prefix")).join(wanted, "len", "left_semi")
    by_prefix = rows.groupBy("len", F.xxhash64("prefix").alias("ph")).agg(F.count(F.lit(1)).alias("n"))
    return by_prefix.where("n > 1").select("len", "ph")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 64,
    filter_bits: int = 1 << 25,
) -> DataFrame:
    """docs with three more columns: keep_id (id of the row of the same text that stays), group_size, kept.

    Texts are equal when identical; null counts as empty. Of equal texts the largest id stays; null ids sort lowest.
    Rows that repeat both id and text count each, and exactly one of them stays. Input columns of the three
    names are replaced. An empty table gives an empty result.

    filter_bits bounds the broadcast bitmap (4 MB by default) whatever the input's size; when it fills up, more
    rows take the full hash, with the same result.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    marks = (
        _refine(docs, id_col, text_col, prefix_chars)
        .select(F.pmod(F.xxhash64("len", "ph"), F.lit(filter_bits)).alias("pos"))
        .groupBy(F.expr(f"pos div {ROW_BITS}").alias("__bm_row"))
        .agg(F.expr(f"bitmap_construct_agg(pos % {ROW_BITS})").alias("__bm"))
    )
    keyed = docs.withColumns({"__len": F.octet_length(_text(text_col)), "__ph": F.xxhash64(F.substring(_text(text_col), 1, prefix_chars))})
    keyed = keyed.withColumn("__pos", F.pmod(F.xxhash64("__len", "__ph"), F.lit(filter_bits)))
    keyed = keyed.withColumn("__bm_row", F.expr(f"__pos div {ROW_BITS}"))
    # At most filter_bits / ROW_BITS rows of 4 KB each.
    marked = keyed.join(F.broadcast(marks), "__bm_row", "left")
    byte = F.conv(F.hex(F.expr(f"substring(__bm, cast((__pos % {ROW_BITS}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = marked.withColumn("__hit", F.coalesce(F.expr("1") == F.getbit(byte, (F.col("__pos") % 8).cast("int")), F.lit(False)))
    plain = docs.columns

    alone = marked.where(~F.col("__hit")).select(
        *plain, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    again = marked.where("__hit").select(*plain, "__len", F.sha2(_text(text_col), 256).alias("__sha"))
    by_row = again.groupBy("__len", "__sha", F.col(id_col).alias("__id")).agg(F.count(F.lit(1)).alias("n"))
    groups = (
        by_row.groupBy("__len", "__sha")
        .agg(F.sum("n").alias("group_size"), F.max(F.struct(F.col("__id").alias("id"), F.col("n"))).alias("best"))
        .where("group_size > 1")
        .select(F.col("__len").alias("__g_len"), F.col("__sha").alias("__g_sha"), "group_size", F.col("best.id").alias("keep_id"), F.col("best.n").alias("__ties"))
    )
    groups = materialize(groups, "groups")
    few = groups.count() <= BROADCAST_GROUPS
    joined = again.join(F.broadcast(groups) if few else groups, (F.col("__len") == F.col("__g_len")) & (F.col("__sha") == F.col("__g_sha")), "left")
    joined = joined.withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1)), "__ties": F.coalesce("__ties", F.lit(1))})
    is_best = F.col(id_col).eqNullSafe(F.col("keep_id"))
    settled = joined.where(~is_best | (F.col("__ties") == 1)).select(*plain, "keep_id", "group_size", is_best.alias("kept"))
    # Rows that repeat id and text: number them, the first stays. No such rows, no work.
    one = F.row_number().over(Window.partitionBy("__len", "__sha", id_col).orderBy(F.lit(1)))
    tied = joined.where(is_best & (F.col("__ties") > 1)).select(*plain, "keep_id", "group_size", (one == 1).alias("kept"))
    return alone.unionByName(settled).unionByName(tied)
