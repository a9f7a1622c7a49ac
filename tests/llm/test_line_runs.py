"""Line dedup against a plain version."""

import random
import string

import pytest
from pyspark.sql import functions as F

from weftline.llm import line_runs

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows):
    keyed = [(i, [(x, x.strip(" \t\n\x0b\x0c\r").translate(LOWER)) for x in (t or "").split("\n")]) for i, t in rows]
    first = {}
    for i, lines in keyed:
        for _, k in lines:
            if len(k) >= 10:
                at = float("inf") if i is None else i
                first[k] = min(first.get(k, at), at)
    out = []
    for i, lines in keyed:
        stay = [x for x, k in lines if len(k) < 10 or first[k] == (float("inf") if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches, fan", [(1, 3), (6, 2), (7, 3)])
def test_equal_to_plain_version(spark, batches, fan):
    rng = random.Random(batches)
    pool = [" Común É LINE of words", "common line OF words\t", "short", "", "ÉCOLE des lignes", "école des lignes", "x" * 5000, "only\rcarriage\rreturns", "\x0b padded line here \x0c", "padded LINE here", "nine char", "ten  chars"]
    rows = [(rng.choice([None, rng.randrange(60)]) if k % 9 == 0 else k, "\n".join(rng.choices(pool, k=rng.randrange(1, 9)))) for k in range(80)]
    rows += [(3, None), (None, None), (-5, ""), (2**62, "\n\n"), (2**62, "common line of words")] + rows[:5]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("x"), "gone": F.lit(1), "at": F.lit(2), "lines": F.lit(3)})
    got = [tuple(r) for r in line_runs.dedup_lines(frame, batches=batches, fan=fan).collect()]
    assert sorted(got, key=repr) == plain(rows)


def test_empty_table(spark):
    assert line_runs.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_are_compacted_by_level(spark):
    runs = line_runs.LineRuns(spark, 4, fan=2)
    for k in range(5):
        runs.add(spark.range(k * 10, k * 10 + 15).selectExpr("id AS h1", "id AS h2", f"{k}L AS id"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    held = {r["h1"]: r["id"] for r in runs.holders().collect()}
    runs.drop()
    assert held == {h: max(0, (h - 5) // 10) for h in range(55)}
