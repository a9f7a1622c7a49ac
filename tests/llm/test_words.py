"""Word hashes against plain Python, and the recall of repeated passages by length."""

import random

import numpy as np
import pandas as pd

from weftline.llm import para_dedup, words

PIECES = ["a", "B", "é", "漢", "😀", "\x00", " ", "\n", "\t", "\x0b", "\r", "\x1c", " ", "longword" * 4, "x" * 70, "abcdefgh", "z" * 9, "Q" * 64, "\ud800"]


def test_words_are_those_of_bytes_split():
    rng = random.Random(1)
    known = {}
    for _ in range(300):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(6))]
        h, docs, lines = words.batch_words(texts)
        raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
        flat = [w for t in raw for w in t.split()]
        assert docs.tolist() == np.cumsum([0, *(len(t.split()) for t in raw)]).tolist()
        assert lines.tolist() == np.cumsum([0, *(len(line.split()) for t in raw for line in t.split(b"\n"))]).tolist()
        assert len(flat) == len(h) and all(known.setdefault(w, x) == x for w, x in zip(flat, h.tolist(), strict=True))
        for own, t in zip(words.shingle_sets(texts), raw, strict=True):
            w = t.split()
            assert len(own) == len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else ())
    assert len(set(known.values())) == len(known)


def test_parts_hold_whole_rows(monkeypatch):
    monkeypatch.setattr(words, "PART_CHARS", 10)
    batch = pd.DataFrame({"text": ["abc", None, "d" * 50, "", "ef", "g" * 9]})
    found = list(words.in_parts([batch, batch[:0]]))
    assert pd.concat(found).equals(batch) and len(found) > 2
    assert max(p["text"].str.len().sum() for p in found) <= 59


def test_recall_of_spliced_passages_by_length(spark):
    rng = np.random.default_rng(3)
    fresh = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n))
    lengths, rows = (35, 36, 38, 40, 43, 45, 49, 55, 80), []
    for k, n in enumerate(lengths):
        for j in range(40):
            passage = fresh(n)
            for side in (0, 1):
                rows.append((1000 * k + 2 * j + side, f"{fresh(int(rng.integers(5, 90)))} {passage} {fresh(int(rng.integers(5, 90)))}"))
    out = para_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "keep_id", "n_words").distinct().collect()
    found = {r["doc_id"]: r["keep_id"] for r in out}
    assert all(v == k - k % 2 for k, v in found.items())
    share = {n: sum(1000 * k + 2 * j in found for j in range(40)) / 40 for k, n in enumerate(lengths)}
    assert all(v == 1 for v in share.values())
    assert all(lengths[r["doc_id"] // 1000] - 14 <= r["n_words"] <= lengths[r["doc_id"] // 1000] for r in out)
    assert all(r["n_words"] >= 35 for r in out)


def test_shorter_runs_do_not_count(spark):
    rng = np.random.default_rng(6)
    fresh = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n))
    rows = []
    for k, n in enumerate((25, 30, 32, 34) * 10):
        passage = fresh(n)
        rows += [(2 * k + side, f"{fresh(40)} {passage} {fresh(40)}") for side in (0, 1)]
    assert para_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_a_short_run_beside_a_long_one(spark):
    rng = np.random.default_rng(7)
    fresh = lambda n: ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]
    rows = []
    for k in range(20):
        # 0 and 1 share 90 words, 2 has 36 of these: its own windows alone may cover less than 35.
        w = fresh(90)
        texts = [[*fresh(9), *w, *fresh(9)], [*fresh(30), *w], [*fresh(20), *w[20:56], *fresh(20)]]
        rows += [(3 * k + j, " ".join(t)) for j, t in enumerate(texts)]
    out = para_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["keep_id"]) for r in out} == {(d, d - d % 3) for d, _ in rows}


def test_recall_of_similar_paragraphs_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    fresh = lambda n: ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]
    rows, linked = [], set()
    for k in range(150):
        # One change in the first 24 words and one in the last leave no common window of 25 and one anchor at most.
        w = fresh(44)
        v = [*w[:20], "other", *w[21:]]
        rows += [(2 * k, "\n".join([" ".join(fresh(8)), " ".join(w)])), (2 * k + 1, " ".join(v))]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, v))
        if 100 * len(a & b) >= 75 * len(a | b):
            linked.add(k)
    out = para_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r["doc_id"] // 2 for r in out}
    assert linked and len(found & linked) >= 0.9 * len(linked)
    assert all(r["keep_id"] == r["doc_id"] - r["doc_id"] % 2 for r in out)


def test_rows_that_repeat_an_id(spark):
    rng = np.random.default_rng(5)
    fresh = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n))
    one, other = fresh(60), fresh(60)
    # Row 1 has two texts, one of them twice; places of one text say nothing about the other.
    rows = [(1, f"{one} {fresh(30)}"), (1, f"{fresh(40)} {other}"), (2, f"{fresh(9)} {one}"), (3, f"{other} {fresh(5)}"), (4, None)]
    rows.append(rows[0])
    out = para_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = sorted((r["doc_id"], r["keep_id"], r["start_word"] // 10) for r in out)
    assert len(spans) == 4 and [s[:2] for s in spans] == [(1, 1), (1, 1), (2, 1), (3, 1)]
    assert all(46 <= r["n_words"] <= 60 for r in out) and len({r["cluster_id"] for r in out}) == 2
