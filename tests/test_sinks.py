"""Cluster files in order, replaced clusters, sharded indexes, and the remaining readers."""

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from weftline.operators import cluster
from weftline.sources import readers, writers


def members_of(spark, n=400):
    """A cluster with most rows, some of a few, some of one."""
    rows = [("g_2" if k % 4 else f"g_{10 + k % 40}", k, (k * 37) % n, [k, k + 1]) for k in range(n)] + [("g_1", n, 0, [7]), (None, n + 1, 0, [8])]
    return spark.createDataFrame(rows, "cluster_id string, id long, at long, elements array<long>")


def test_files_follow_the_order(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.write_clusters(members_of(spark).repartition(5), path, order=["at"])
    assert sorted(os.listdir(path))[-2:] == ["kind=cluster", "kind=singleton"]
    assert os.listdir(f"{path}/kind=singleton") == ["cluster_id=g_1"]
    want, seen = {r["cluster_id"]: [] for r in members_of(spark).collect()}, {}
    for r in sorted(members_of(spark).collect(), key=lambda r: r["at"]):
        want[r["cluster_id"]].append(str(r["id"]))
    for folder in os.listdir(f"{path}/kind=cluster"):
        files = sorted(f for f in os.listdir(f"{path}/kind=cluster/{folder}") if f.endswith(".txt"))
        text = "".join((tmp_path / "out" / "kind=cluster" / folder / f).read_text() for f in files)
        seen[folder.removeprefix("cluster_id=")] = [line[1:] for line in text.split("\n") if line.startswith(">")]
    assert seen == {k: v for k, v in want.items() if k and len(v) > 1}
    back = readers.read_clusters(spark, path)
    assert back.count() == 401 and back.where("cluster_id = 'g_1'").first()["elements"] == [7]


def test_oversized_clusters_become_parts(spark, tmp_path):
    members = members_of(spark).drop("at").where("cluster_id IS NOT NULL")
    parts = cluster.forced_partition(members.select("cluster_id", "id"), ["cluster_id"], ["id"], 100)
    path = str(tmp_path / "new")
    plan = {r["cluster_id"]: (r["n"], r["action"], r["pieces"]) for r in writers.replace_oversized(members, parts, path, 100, dry_run=True).collect()}
    assert plan["g_2"] == (300, "split", 4) and plan["g_1"] == (1, "keep", 1) and plan["g_10"] == (10, "keep", 1)
    assert not os.path.exists(path)
    assert {r["cluster_id"]: (r["n"], r["action"], r["pieces"]) for r in writers.replace_oversized(members, parts, path, 100).collect()} == plan
    sizes = {r["cluster_id"]: r["count"] for r in readers.read_clusters(spark, path).groupBy("cluster_id").count().collect()}
    assert sizes["g_2_0"] == 75 and "g_2" not in sizes and sum(sizes.values()) == 401


def test_parts_may_be_components_split_by_seeds(spark):
    # Two chains of similar arrays in one cluster; the longer is split, nothing else.
    rows = [("g", k, [k, k + 1, k + 2]) for k in range(6)] + [("g", k, [k, k + 1, k + 2]) for k in range(100, 103)]
    members = spark.createDataFrame(rows, "cluster_id string, id long, elements array<long>")
    split = cluster.seed_split(members.withColumnRenamed("cluster_id", "g"), "g", 4, 0.2)
    parts = split.select(F.col("g").alias("cluster_id"), "id", F.col("cluster").alias("part"))
    got = writers.replace_oversized(members, parts, "", 4, dry_run=True).first()
    assert (got["n"], got["action"], got["pieces"]) == (9, "split", 3)


def test_index_and_metadata(spark, tmp_path):
    index = spark.createDataFrame([(f'e"{k}', k) for k in range(25)] + [(None, 25)], "element string, idx long")
    writers.write_index(index, str(tmp_path / "index"), size=10)
    lines = [x for f in sorted((tmp_path / "index").glob("*.txt")) for x in f.read_text().splitlines()]
    assert [list(json.loads(x).values()) for x in lines] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
    assert {r["element"]: r["idx"] for r in readers.read_index(spark, str(tmp_path / "index")).collect()} == {f'e"{k}': k for k in range(25)}
    arrays = spark.createDataFrame([("a", "GT", "+"), ("b", None, "-"), (None, "x", "x")], "array_id string, repeat string, direction string")
    writers.write_metadata(arrays, str(tmp_path / "meta"))
    got = sorted(tuple(r) for r in readers.read_metadata(spark, str(tmp_path / "meta"), lines=True).collect())
    assert got == [("a", "GT", "+"), ("b", None, "-")]


def test_remaining_readers(spark, tmp_path):
    calls = "array_name string, folder string, direction string"
    first = spark.createDataFrame([("a", "1", "Forward"), ("b", "2", "Reverse"), ("a", "2", "Reverse")], calls)
    report = spark.createDataFrame([("c", "1", "Forward"), ("d", "3", "Forward"), ("a", "3", "Reverse")], calls)
    got = {r["array_name"]: (r["folder"], r["direction"]) for r in readers.calls_by_folder(first, report).collect()}
    assert got == {"a": ("1", "Forward"), "b": ("2", "Reverse"), "d": ("3", "Forward")}
    (tmp_path / "c.csv").write_text("array_name,group_name\nx,g1\ny,singleton\nx,g2\nz,\n")
    assert {r["array_name"]: r["group_name"] for r in readers.read_cluster_table(spark, str(tmp_path / "c.csv")).collect()} == {"x": "g2", "y": "singleton", "z": None}
    assert {r["array_name"]: r["group_name"] for r in readers.read_lookup(spark, str(tmp_path / "c.csv"), sep=",").collect()} == {"x": "g1", "y": "singleton", "z": None}
    both = readers.read_predictions(spark, {"one": str(tmp_path / "c.csv"), "none": str(tmp_path / "absent.csv")})
    assert sorted((r["array_name"], r["clustering"]) for r in both.collect()) == [("x", "one"), ("x", "one"), ("z", "one")]
    (tmp_path / "run.log").write_text("line 1\nline 2\n")
    assert [(r["name"], r["text"]) for r in readers.read_logs(spark, str(tmp_path / "run.log")).collect()] == [("run.log", "line 1\nline 2\n")]
    stats = writers.cluster_stats_json(spark.createDataFrame([(3, 1)], "total int, single int")).first()[0]
    assert json.loads(stats) == {"total": 3, "single": 1}


def test_ids_of_either_suffix(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "x.fasta").write_text(">p q\nAC\n")
    assert [r[0] for r in readers.text_ids_in(spark, str(tmp_path / "one")).collect()] == ["p"]
    (tmp_path / "one" / "x.fa").write_text(">r\nAC\n")
    assert [r[0] for r in readers.text_ids_in(spark, str(tmp_path / "one")).collect()] == ["r"]
    (tmp_path / "none").mkdir()
    with pytest.raises(AnalysisException):
        readers.text_ids_in(spark, str(tmp_path / "none"))


def test_bundled_clusters_are_the_same_rows_in_few_files(spark, tmp_path):
    rows = lambda df: sorted((r["kind"], r["cluster_id"], r["id"], tuple(r["elements"])) for r in df.select("kind", "cluster_id", "id", "elements").collect())
    members = members_of(spark).where("cluster_id IS NOT NULL").unionByName(spark.createDataFrame([(f"s_{k}", 1000 + k, 0, [k]) for k in range(60)], members_of(spark).schema))
    writers.write_clusters(members, str(tmp_path / "one"), order=["at"])
    writers.write_clusters(members, str(tmp_path / "many"), order=["at"], bundled=True)
    assert rows(readers.read_clusters(spark, str(tmp_path / "many"), bundled=True)) == rows(readers.read_clusters(spark, str(tmp_path / "one")))
    assert sorted(x for x in os.listdir(tmp_path / "many") if x.startswith("kind")) == ["kind=cluster", "kind=singleton"]
    assert len(list((tmp_path / "many").rglob("*.json"))) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = [json.loads(x) for f in sorted((tmp_path / "many" / "kind=cluster").glob("*.json")) for x in f.read_text().splitlines()]
    assert [x["cluster_id"] for x in lines] == sorted(x["cluster_id"] for x in lines)


def test_results_a_line_each(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    document = '{"Sequences":[{"Id":"s1","Cas":[],"Crisprs":[{"Name":"a1","Start":1,"End":9,"Evidence_Level":4,"CRISPRDirection":"+"}]}]}'
    (tmp_path / "deep" / "x.txt").write_text(f"{document}\n{{broken\n{document.replace('a1', 'a2')}\n")
    good, bad = readers.read_results(spark, str(tmp_path), pattern="*.txt", lines=True)
    assert sorted(r["array_name"] for r in readers.calls_from_results(good).collect()) == ["a1", "a2"] and bad.count() == 1
