"""Readers and writers round trip on small files."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.sources import readers, writers

DOC = {
    "Sequences": [
        {
            "Id": "s1", "Version": "s1.1", "Description": "d", "Length": 100,
            "Cas": [{"Type": "x_CAS_Class1-Subtype-I-E_1", "Start": 25, "End": 30, "Genes": [{"n": 1}, {"n": 2}]}, {"Type": "x_CAS_Class2-Type-II_1", "Start": 1, "End": 5, "Genes": []}],
            "Crisprs": [
                {"Name": "a1", "Start": 10, "End": 20, "Evidence_Level": 4, "DR_Consensus": "GTT", "CRISPRDirection": "-", "Spacers": 2,
                 "Regions": [{"Type": "LeftFlank", "Sequence": "L"}, {"Type": "Spacer", "Sequence": "AAC"}, {"Type": "DR", "Sequence": "GTT"}, {"Type": "Spacer", "Sequence": ""}, {"Type": "Spacer", "Sequence": "CCG"}]},
                {"Name": "a2", "Start": 50, "End": 60, "Evidence_Level": 2, "DR_Consensus": "GTT", "Regions": []},
            ],
        }
    ]
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("results")
    for name, text in (("Result_1", json.dumps(DOC)), ("Result_2", "{broken"), ("Result_3", json.dumps(DOC))):
        (top / name).mkdir()
        (top / name / "result.json").write_text(text)
    return str(top)


def test_results(spark, root):
    good, bad = readers.read_results(spark, root)
    assert (good.count(), bad.count()) == (2, 1)
    a = readers.annotated_arrays(good).where("array_name = 'a1'").first()
    # Both cassettes are five away: the first in the list wins.
    assert (a["cas_subtype"], a["cas_distance"], a["cas_genes"]) == ("I-E", 5, 2)
    assert readers.extracted_arrays(good).select("spacers").first()[0] == ["AAC", "", "CCG"]
    o = readers.oriented_arrays(good).collect()
    assert [(r["array_id"], r["spacers"], r["was_flipped"], r["cas_type"]) for r in o] == [("a1", ["CGG", "GTT"], True, "I")]
    assert [r["direction"] for r in readers.calls_from_results(good).collect()] == ["Reverse", "Reverse"]
    assert readers.read_results_or_single(spark, root).where("Sequences IS NOT NULL").count() == 2


def test_indexed_text(spark, tmp_path):
    (tmp_path / "x.txt").write_text(">a\n0, 1, 2\n>b\n-3, x, 4\n>c\n\n")
    got = {r["id"]: r["elements"] for r in readers.read_indexed_text(spark, str(tmp_path / "x.txt")).collect()}
    assert got == {"a": [0, 1, 2], "b": [-3, 4], "c": []}
    assert readers.element_sets(readers.read_indexed_text(spark, str(tmp_path / "x.txt"))).count() == 2
    members = spark.createDataFrame([("g_0", "a", [1, 2]), ("g_0", "b", [2]), ("g_1", "c", [9])], "cluster_id string, id string, elements array<int>")
    writers.write_clusters(members, str(tmp_path / "out"))
    assert (tmp_path / "out" / "kind=singleton" / "cluster_id=g_1").is_dir()
    assert readers.read_indexed_text(spark, str(tmp_path / "out" / "kind=cluster")).count() == 2


def test_tables(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("CRISPR_Id\tEvidence_Level\tCRISPRDirection\nx\t4.0\t+\ny\tbad\t-\nz\t3\t+\n")
    assert [(r["array_name"], r["direction"]) for r in readers.calls_from_report(readers.read_delimited(spark, str(tmp_path / "r.tsv"))).collect()] == [("x", "Forward")]
    (tmp_path / "g.csv").write_text("name,predicted orientation,recommend reversing array,array names\ng1,forward,True,\"['a', 'b']\"\ng2,Reverse,no,\"[c'd, e]\"\n")
    got = readers.group_calls(readers.read_delimited(spark, str(tmp_path / "g.csv"), ",")).collect()
    assert [(r["array_name"], r["group_name"], r["recommend_reverse"]) for r in got] == [("a", "g1", True), ("b", "g1", True), ("cd", "g2", False), ("e", "g2", False)]
    (tmp_path / "a.tsv").write_text("array_name\tcas_class\tcas_type\tcas_subtype\n a \tC1\tI\t\na\tC2\tII\tx\n\tC\tI\tI\n")
    assert [tuple(r) for r in readers.read_annotations(spark, str(tmp_path / "a.tsv")).collect()] == [("a", "C1", "I", "Unknown")]
    with pytest.raises(ValueError, match="cas_class"):
        readers.read_annotations(spark, str(tmp_path / "r.tsv"), ("array_name", "cas_class"))


def test_json_maps_and_lines(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"g": {"size": 2, "arrays": {"a": {"was_flipped": True, "cas_type": "I"}, "b": {"cas_type": "I"}}}}))
    assert {r[0]: r[1] for r in readers.read_flip_map(spark, str(tmp_path / "m.json")).collect()} == {"a": True, "b": False}
    assert readers.read_metadata(spark, str(tmp_path / "none.json")).count() == 0
    rows = spark.createDataFrame([("x", 1, ["A"], ["C"])], "array_name string, label int, spacers array<string>, repeats array<string>")
    writers.write_json_lines(rows, str(tmp_path / "ex"))
    back = readers.read_examples(spark, str(tmp_path / "ex")).first()
    assert (back["array_name"], back["label"], back["spacers"], back["left_flank"], back["n_spacers"]) == ("x", 1, ["A"], "", 0)
    writers.write_delimited(rows.drop("spacers", "repeats"), str(tmp_path / "tsv"), ["label", "array_name", "absent"])
    assert readers.read_delimited(spark, str(tmp_path / "tsv")).columns[:3] == ["label", "array_name", "absent"]
    (tmp_path / "s.fa").write_text(">id1 rest\nACGT\n>id2\nA\n")
    assert [r[0] for r in readers.text_ids(spark, str(tmp_path / "s.fa")).collect()] == ["id1", "id2"]
    assert writers.element_index_json(spark.createDataFrame([("x", 0), ("y", 1)], "element string, idx long")).first()[0] == '{"x":0,"y":1}'
    assert writers.report([("s", rows.select(F.col("array_name").alias("key"), F.col("label").alias("value")))]).count() == 1
