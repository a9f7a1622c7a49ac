"""Sinks: delimited tables with pinned columns, JSON lines, indexed text and reports. None ever deletes its inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def indexed_text(key: Column, elements: Column) -> Column:
    """One record: `>id`, a newline, and the elements with comma and blank between."""
    return F.concat(F.lit(">"), key, F.lit("\n"), F.array_join(F.transform(elements, lambda x: x.cast("string")), ", "))


def write_delimited(rows: DataFrame, path: str, columns: list[str], sep: str = "\t") -> None:
    """A header and the pinned columns; others are dropped, missing ones are empty."""
    known = set(rows.columns)
    rows.select(*[F.col(c) if c in known else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("errorifexists").csv(path, sep=sep, header=True)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_clusters(members: DataFrame, path: str, cluster: str = "cluster_id", array_id: str = "id", elements: str = "elements", order: list[str] | None = None, bundled: bool = False) -> None:
    """Indexed text by cluster, clusters of one array in a folder of their own: kind=singleton or kind=cluster, then the cluster's id.

    Clusters are in the string order of their names (g_10 before g_2), a cluster's arrays by `order` (by id if not given). Rows are dealt by
    ranges of that order, so a cluster of most rows is several files, whose names follow the order. Rows without a cluster are left out.
    bundled: for very many clusters, whose folders would take most of the time; a folder a kind, in it JSON objects of a cluster's name and an array's text, a line each.
    """
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("__n"))
    keys = {f"__o{k}": F.col(c) for k, c in enumerate(order or [array_id])}
    kind, named = F.when(F.col("__n") == 1, "singleton").otherwise("cluster").alias("kind"), F.coalesce(F.col(cluster).cast("string"), F.lit("")).alias(cluster)
    text = indexed_text(F.coalesce(F.col(array_id).cast("string"), F.lit("")), F.coalesce(F.col(elements), F.array().cast("array<string>"))).alias("value")
    rows = members.join(sizes, cluster).withColumns(keys).select(kind, named, *keys, text)
    ranged = rows.repartitionByRange("kind", cluster, *keys).sortWithinPartitions("kind", cluster, *keys)
    if bundled:
        ranged.select("kind", cluster, "value").write.mode("errorifexists").partitionBy("kind").json(path)
        return
    ranged.select("kind", cluster, "value").write.mode("errorifexists").partitionBy("kind", cluster).text(path)


def replace_oversized(members: DataFrame, parts: DataFrame, path: str, most: int, dry_run: bool = False, cluster: str = "cluster_id", array_id: str = "id", elements: str = "elements", bundled: bool = False) -> DataFrame:
    """cluster, n, action (keep or split) and pieces of every cluster; unless dry_run, the clusters are written anew to `path`, those above `most` as their parts.

    parts: cluster, id, part of the arrays of large clusters; part p of g is named g_p. An array of a large cluster without a part stays under
    the old name. Inputs are never deleted.
    """
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("__n"))
    large = F.col("__n") > most
    named = members.join(sizes, cluster).join(parts.select(F.col(cluster), F.col(array_id), F.col("part").alias("__part")), [cluster, array_id], "left")
    name = F.when(large & F.col("__part").isNotNull(), F.concat_ws("_", F.col(cluster).cast("string"), F.col("__part").cast("string"))).otherwise(F.col(cluster).cast("string"))
    named = named.withColumn("__name", name)
    if not dry_run:
        write_clusters(named.select(F.col("__name").alias(cluster), array_id, elements), path, cluster, array_id, elements, bundled=bundled)
    per_name = named.groupBy(cluster, "__name").agg(F.count(F.lit(1)).alias("k"), F.max("__n").alias("__n"))
    return per_name.groupBy(cluster).agg(F.sum("k").alias("n"), F.max(F.when(large, "split").otherwise("keep")).alias("action"), F.count(F.lit(1)).alias("pieces"))


def element_index_json(index: DataFrame, element: str = "element", idx: str = "idx") -> DataFrame:
    """One row, one column: the index as a JSON object. For an index that fits a task; `write_index` has no such bound."""
    return index.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(element).cast("string"), F.col(idx)))))).alias("json"))


def write_index(index: DataFrame, path: str, element: str = "element", idx: str = "idx", size: int = 10_000) -> None:
    """The index as JSON objects of `size` elements at most, an object a line, lines and elements in the order of their numbers from 0."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(element).cast("string").alias("e"))))
    shards = index.where(F.col(element).isNotNull()).groupBy(F.expr(f"{idx} div {size}").alias("shard")).agg(F.to_json(F.map_from_entries(F.transform(entries, lambda x: F.struct(x["e"], x["i"])))).alias("value"))
    shards.repartitionByRange("shard").sortWithinPartitions("shard").select("value").write.mode("errorifexists").text(path)


def write_metadata(arrays: DataFrame, path: str, array_id: str = "array_id") -> None:
    """A JSON object a line: the array's id to its repeat and direction. Arrays without an id are left out."""
    entry = F.create_map(F.col(array_id).cast("string"), F.struct("repeat", "direction"))
    arrays.where(F.col(array_id).isNotNull()).select(F.to_json(entry).alias("value")).write.mode("errorifexists").text(path)


def cluster_stats_json(stats: DataFrame) -> DataFrame:
    return stats.select(F.to_json(F.struct(*stats.columns)).alias("json"))


def report(sections: list[tuple[str, DataFrame]], key: str = "key", value: str = "value") -> DataFrame:
    """section, key, value rows of several two-column tables."""
    out = None
    for name, rows in sections:
        part = rows.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
