"""Hand-computed values of the Column functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import labels, seq, textfmt
from weftline.operators import compare, ml, quality
from weftline.operators.interval import gap


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: seq.reverse_complement(F.lit("ACGTacgtNn-")), "-nNacgtACGT"),
        (lambda: seq.normalize_dna(F.lit("atcgX-N")), "ATCGNNN"),
        (lambda: gap(F.lit(10), F.lit(20), F.lit(25), F.lit(30)), 5),
        (lambda: gap(F.lit(10), F.lit(20), F.lit(1), F.lit(5)), 5),
        (lambda: gap(F.lit(10), F.lit(20), F.lit(15), F.lit(40)), 0),
        (lambda: seq.round_half_even(F.lit(2.675), 2), 2.68),
        (lambda: seq.gc_fraction(F.lit("")), 0.0),
        (lambda: labels.direction_a(F.lit(" R rest")), "Reverse"),
        (lambda: labels.direction_a(F.lit("FR")), "Unknown"),
        (lambda: labels.direction_b(F.lit(" FORWARD ")), "Forward"),
        (lambda: labels.agreement(F.lit("Forward"), F.lit(None).cast("string")), "not_comparable"),
        (lambda: labels.subtype_key(F.lit("  ")), "Unknown"),
        (lambda: textfmt.duration(F.lit(3723)), "1h02m03s"),
        (lambda: textfmt.duration(F.lit(-5)), "0s"),
        (lambda: textfmt.ellipsize(F.lit("abcdefgh"), 6), "abc..."),
        (lambda: textfmt.ellipsize(F.lit("abcdef"), 2), "ab"),
        (lambda: ml.decode_dna(ml.encode_dna(F.lit("acXt"), True, True)), "ACNT"),
        (lambda: F.array_join(ml.encode_dna(F.lit("ACGTx"), True, True), ","), "1,3,4,5,6,7,2"),
        (lambda: labels.agreement(F.lit("ND"), F.lit("Forward")), "disagree"),
        (lambda: labels.parse_type_label(F.lit("X_CAS_Class1-Type-IVa_1"))["status"], "ok"),
        (lambda: labels.parse_type_label(F.lit("X_CAS_Class1-Type-IV_1"))["status"], "coarse_type_only"),
        (lambda: F.array_join(ml.rotate(F.array(F.lit(1.0), F.lit(0.0), F.lit(9.0)), F.lit(0)), ","), "1.0,0.0,9.0"),
        (lambda: F.lit(str(ml.alibi_slopes(3))), "[0.0625, 0.00390625, 0.25]"),
        (lambda: textfmt.safe_filename(F.lit("a b/c")), "a_b_c"),
    ],
)
def test_value(spark, column, want):
    assert one(spark, column()) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("NC_000913.3_CAS_Class1-Subtype-I-E_1", ("Class1", "I", "I-E", "ok")),
        ("X_CAS_Class1-Type-IV_1", ("Class1", "IV", "IV", "coarse_type_only")),
        ("X_CAS_Class1-Subtype-I-Z_2", ("Class1", "I", "Unknown", "unknown_subtype")),
        ("", ("Unknown", "Unknown", "Unknown", "unknown_type")),
        (None, ("Unknown", "Unknown", "Unknown", "unknown_type")),
    ],
)
def test_type_label(spark, raw, want):
    x = one(spark, labels.parse_type_label(F.lit(raw).cast("string")))
    assert (x["cas_class"], x["cas_type"], x["cas_subtype"], x["status"]) == want


def test_known_subtypes_count():
    assert len(labels.KNOWN_SUBTYPES) == len(set(labels.KNOWN_SUBTYPES)) == 74


def test_contains_run_guards_short_lists(spark):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert one(spark, seq.contains_run(arr("a", "b", "c"), arr("b", "c"), arr("x", "y", "z"), arr("y", "z"))) is True
    assert one(spark, seq.contains_run(arr("a"), arr("a", "b"), arr("x"), arr("x", "y"))) is False
    assert one(spark, seq.contains_run(arr("a"), arr(), arr("x"), arr())) is False


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ACGTNacgtn-", max_size=12), min_size=1, max_size=20))
def test_reverse_complement_is_an_involution(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    twice = seq.reverse_complement(seq.reverse_complement(F.col("t")))
    assert df.where(twice != F.col("t")).count() == 0


def test_forward_share_counts_unknown_calls(spark):
    rows = spark.createDataFrame([("g", "Forward"), ("g", "Unknown"), ("u", "Unknown"), ("f", "Forward")], "g string, c string")
    assert {tuple(r) for r in compare.forward_fractions(rows, "g", "c").collect()} == {("g", 2, 0.5, "mixed"), ("u", 1, 0.0, "all_reverse"), ("f", 1, 1.0, "all_forward")}


def test_overlap_counts_each_side(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("c", "z"), ("c", "z")], "a string, b string")
    assert compare.overlap_stats(rows, "a", "b").first().asDict() == {"n_clusters_a": 3, "intact_a": 2, "split_a": 1, "n_shared": 5, "n_clusters_b": 3, "intact_b": 2, "merged_b": 1}


def test_rates_fall_on_tiny_gains(spark):
    rows = spark.createDataFrame([("r", k, 1.0 - 1e-6 * k) for k in range(6)], "run string, epoch int, loss double")
    assert quality.plateau_rates(rows, "run", "epoch", "loss", 0.1).first()["final_rate"] == 0.05
