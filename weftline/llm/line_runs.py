"""Line deduplication against levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends, A to Z lower-cased; keys are told apart by two 64-bit hashes.
Documents come in batches of ascending id. A batch's distinct keys, each with its smallest id, are merge-anti-joined with all runs
so far; what is left becomes a run of the lowest level. A run is a bucketed, sorted table, so that only the new batch is
shuffled. When a level holds `fan` runs, they are compacted into one run of the level above, so a key is rewritten once a level.
As batches ascend, the runs hold for each key the smallest id that has it; a line goes when its document is not that one.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.runtime import delete, discard, materialize, scratch_dir, writing

#: Shorter keys are never dropped.
LEAST_CHARS = 10
#: Batches that one call deals documents into, and runs of a level that make it compact.
BATCHES, FAN = 6, 3
_BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A to Z lower-cased and no other letter."""
    bare = F.btrim(line, F.lit(_BLANK))
    # Where all letters are ASCII, lower() is the same and faster.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def split_lines(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Runs of (h1, h2, id) by level, level 0 first. Only this object reads its tables; `drop` deletes them."""

    def __init__(self, spark: SparkSession, buckets: int, fan: int = FAN):
        self.spark, self.buckets, self.fan = spark, buckets, fan
        self.levels: list[list[str]] = [[]]
        self.places: dict[str, str] = {}

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, rows: DataFrame) -> str:
        name = f"weftline_run_{uuid.uuid4().hex}"
        self.places[name] = f"{scratch_dir(self.spark)}/{name}"
        with writing(self.spark):
            rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", self.places[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        delete(self.spark, self.places.pop(name))

    def add(self, batch: DataFrame) -> None:
        """Add the keys of a batch that no run has. batch: h1, h2, id, a row a key."""
        new = batch.select("h1", "h2", "id").repartition(self.buckets, "h1", "h2")
        for run in self.runs():
            new = new.join(run, ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(new))
        for k, level in enumerate(self.levels):
            if len(level) < self.fan:
                break
            whole = self.spark.table(level[0])
            for name in level[1:]:
                whole = whole.unionByName(self.spark.table(name))
            above = self._write(whole.repartition(self.buckets, "h1", "h2"))
            for name in level:
                self._drop(name)
            level.clear()
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(above)

    def holders(self) -> DataFrame:
        """h1, h2, id of every key in any run."""
        first, *rest = self.runs()
        for run in rest:
            first = first.unionByName(run)
        return first

    def drop(self) -> None:
        for name in list(self.places):
            self._drop(name)


def _keys(docs: DataFrame) -> DataFrame:
    """id, at, pos, h1, h2 of every line whose key is long enough. docs: id, at, text."""
    lines = docs.select("id", "at", F.posexplode(split_lines(F.col("text"))).alias("pos", "line")).select("id", "at", "pos", line_key(F.col("line")).alias("key"))
    return lines.where(F.char_length("key") >= LEAST_CHARS).select("id", "at", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """id_col, n_lines, n_dropped and kept (the text of the lines that stay) of every row.

    A key of at least 10 code points stays in the smallest id that has it, as often as it stands there, and goes everywhere else.
    Null and empty texts are one empty line. Rows of one id are one document: they keep and lose the same keys. A null id comes
    after all others. Line ends and white space inside a line matter; a text without \\n is one line of any length. An empty table
    stays empty; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("at", F.xxhash64(F.coalesce("text", F.lit(""))))
    bounds = rows.agg(F.percentile_approx(F.col("id").cast("double"), [k / batches for k in range(1, batches)], 1000).alias("b")).first()["b"] or []
    batch = sum(((F.col("id").cast("double") > F.lit(b)).cast("int") for b in bounds), F.lit(0))
    firsts = _keys(rows).groupBy(F.coalesce(batch, F.lit(len(bounds))).alias("batch"), "h1", "h2").agg(F.min("id").alias("id"))
    firsts = materialize(firsts, "firsts", partition_by=["batch"])
    runs = LineRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fan)
    for k in range(len(bounds) + 1):
        runs.add(firsts.where(F.col("batch") == k))
    discard(firsts)
    # The document is part of the join's key: a line that a third of all rows has is dealt over all tasks.
    mine, held = _keys(rows), runs.holders().select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("id").alias("first"))
    gone = mine.join(held, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & F.col("id").eqNullSafe(F.col("first")), "left_anti")
    gone = materialize(gone.groupBy("id", "at").agg(F.collect_set("pos").alias("gone")), "gone")
    runs.drop()
    there = gone.select(F.col("id").alias("gid"), F.col("at").alias("gat"), "gone")
    lines = rows.join(there, F.col("id").eqNullSafe(F.col("gid")) & (F.col("at") == F.col("gat")), "left").select("id", split_lines(F.col("text")).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return lines.select(F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), kept.alias("kept"))
