"""The corpus pipeline: toxicity, exact dedup, near-duplicate join, source mixing and packing, each over all the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from weftline.runtime import materialize, on_workers, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model does not call toxic, with all their columns as they were, whatever their names.

    Null and empty texts are scored as texts without words, repeated rows each alike; an empty table stays empty.
    """
    on_workers(spark)
    whole = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text")
    scored = toxicity.score_toxicity(whole, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select("__row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one with the largest id; null counts as empty, null ids sort lowest, of rows that repeat both exactly one stays."""
    whole = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text")
    return exact_dedup.exact_dedup(whole).where("kept").select("__row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near duplicates, that with the smallest id (a null id only where a group has no other).

    Rows without words are groups of their own. Rows that repeat both id and text stay or go together: the stage before leaves none.
    """
    keep = ngram_join.jaccard_components(docs).select(F.col("component_id").alias("__id"), F.col("keep_hash").alias("__hash")).distinct()
    same = docs["doc_id"].eqNullSafe(keep["__id"]) & (F.xxhash64(docs["text"].cast("string")) == keep["__hash"])
    return docs.join(keep, same, "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows it does not take are gone, so are those without words.

    Copies depend on id and source alone; null sources are a source, rows that repeat an id are taken or left together.
    """
    mixed = mixing.pareto_mix(docs).where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.expr("taken div size").alias("__copies")).distinct()
    taken = docs.join(mixed, docs["doc_id"].eqNullSafe(mixed["__id"]) & docs["source"].eqNullSafe(mixed["__source"])).where(mixing.n_words(docs["text"]) > 0)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: the places of every row's tokens. Null and empty texts are one token; other columns are ignored."""
    on_workers(spark)
    return packing.best_fit_pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: Language models and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
