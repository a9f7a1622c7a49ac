"""Examples as padded batches against a plain version."""

from pyspark.sql import functions as F

from weftline.operators import ml

#: Batch, elements, repeats, left and right flank; nulls, empty texts and lists, a batch without any elements, a null batch.
ROWS = [
    (1, 0, ["ACG", "", "tx"], ["GT", "GTTA", "G", "GTTAC", "A"], "AC", None),
    (2, 0, ["A"], [], None, "GGGT"),
    (3, 0, None, ["ACGT"], "", ""),
    (4, 1, [], ["C", "G"], "T", "T"),
    (5, None, ["AC", None], None, "A", "C"),
    (6, None, ["ACGTA"], ["A", "C", "G"], None, None),
]
CODE = {c: k for k, c in enumerate(ml.RESERVED)}


def plain(rows):
    enc = lambda x: [CODE[c] if c in "ACGT" else ml.N for c in (x or "").upper()]
    coded = {k: (b, [enc(x) for x in e or []], [enc(x) for x in r or []], enc(left), enc(right)) for k, b, e, r, left, right in rows}
    out = {}
    for k, (b, e, r, left, right) in coded.items():
        batch = [c for c in coded.values() if c[0] == b]
        n, we, wr = max(len(c[1]) for c in batch), max([len(x) for c in batch for x in c[1]], default=0), max([len(x) for c in batch for x in c[2]], default=0)
        wf = max(max(len(c[3]), len(c[4])) for c in batch)
        pad = lambda x, w: x + [0] * (w - len(x))
        both = lambda a, w: [pad(x, w) for x in a[:n]] + [[0] * w for _ in range(n - len(a))]
        out[k] = (both(e, we), [1] * len(e) + [0] * (n - len(e)), both(r, wr), pad(left, wf), pad(right, wf), [len(x) for x in e])
    return out


def test_batches_equal_a_plain_version(spark):
    rows = spark.createDataFrame(ROWS, "id int, b int, e array<string>, r array<string>, l string, t string")
    coded = ml.encode_example(*[F.col(c) for c in "erlt"])
    got = ml.collate_examples(rows.select("id", "b", *[c.alias(k) for k, c in coded.items()]), "b").collect()
    names = ("element_tokens", "element_mask", "repeat_tokens", "left_tokens", "right_tokens", "element_lengths")
    assert {r["id"]: tuple(r[c] for c in names) for r in got} == plain(ROWS)


def test_without_repeats_and_flanks(spark):
    rows = spark.createDataFrame([(1, ["AC", "G"])], "id int, e array<string>")
    got = rows.select(*[c.alias(k) for k, c in ml.encode_example(F.col("e")).items()]).first()
    assert got.asDict() == {"element_tokens": [[3, 4], [5]], "element_lengths": [2, 1], "repeat_tokens": [], "repeat_lengths": [], "n_elements": 2, "left_tokens": [], "right_tokens": []}


def test_dense_vectors_are_padded_with_zeros(spark):
    rows = spark.createDataFrame([(1, 0, [[0.5, 1.0], [2.0, 3.0]], [], [], []), (2, 0, [[4.0, 5.0]], [[1.0, 1.0]], [], [])],
                                 "id int, b int, element_tokens array<array<double>>, repeat_tokens array<array<double>>, left_tokens array<long>, right_tokens array<long>")
    got = {r["id"]: r for r in ml.collate_examples(rows, "b").collect()}
    assert got[2]["element_tokens"] == [[4.0, 5.0], [0.0, 0.0]] and got[2]["element_mask"] == [1, 0]
    assert got[1]["repeat_tokens"] == [[0.0, 0.0], [0.0, 0.0]] and got[2]["repeat_tokens"] == [[1.0, 1.0], [0.0, 0.0]]


def test_empty(spark):
    rows = spark.createDataFrame([], "id int, b int, e array<string>, r array<string>, l string, t string")
    coded = ml.encode_example(*[F.col(c) for c in "erlt"])
    assert ml.collate_examples(rows.select("id", "b", *[c.alias(k) for k, c in coded.items()]), "b").count() == 0
