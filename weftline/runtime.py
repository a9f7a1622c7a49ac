"""Session helpers: shared scratch space, lineage cuts and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, only where that is unset and Spark runs in one process (tests), a local one."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return str(have.get()).rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="weftline-")
    context.setCheckpointDir(own)
    return str(context._jsc.sc().getCheckpointDir().get()).rstrip("/")


#: Settings of every write: shuffle files go when the query ends (Spark 4.1), and Python workers hold fewer rows, which may be whole texts, at a time.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Settings of a write hold inside."""
    was = {key: spark.conf.get(key, None) for key in _WRITING}
    try:
        for key, value in _WRITING.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in was.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def materialize(df: DataFrame, name: str = "rows", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write df once to the shared scratch folder as Parquet, in folders by partition_by if given, and read it back.

    Cuts the lineage: a lost executor costs a re-read of files, not a recomputation, and Python stages that feed
    several consumers run once. The shuffle files behind df go when the write ends; the written ones when `discard` is told.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/weftline-{name}-{uuid.uuid4().hex}"
    with writing(spark):
        df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch = path
    return written


def discard(*written: DataFrame) -> None:
    """Delete what `materialize` wrote for these frames; nothing may read them, or frames made from them, any more."""
    for df in written:
        if path := df.__dict__.pop("scratch", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder to one that is not there yet; the folders above are made."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    files = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(b.getParent())
    if not files.rename(a, b):
        raise OSError(f"cannot rename {source} to {target}")


_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make gives, kept by this process until another key is asked for or `release` is called.

    Python workers live on from step to step, so a worker holds the store of the step it works for, not those of the steps before.
    """
    if key not in _KEPT:
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Drop what this process keeps."""
    _KEPT.clear()


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package by its place; clusters that don't share that folder get it by --py-files."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
