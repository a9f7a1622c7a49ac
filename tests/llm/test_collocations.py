"""Collocations against a plain version; the suffix array against sorting."""

import collections
import random
import re
import string

import numpy as np
import pytest

from weftline.llm import collocations
from weftline.llm.collocations import Bitmap, common_prefixes, left_in_run, mine_collocations, phrase_counts, suffix_array

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows, least, first):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for size in range(1, 6):
                for i in range(len(w) - size + 1):
                    f[lang or "und", tuple(w[i : i + size])] += 1
    often = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    inside = {(lang, g[i : i + m]) for (lang, g), v in often.items() for m in range(2, len(g)) for i in range(len(g) - m + 1) if v >= f[lang, g[i : i + m]]}
    by = collections.defaultdict(list)
    for (lang, g), a in often.items():
        if (lang, g) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            by[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in by.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:first])}


def texts(seed, rows=120):
    rng = random.Random(seed)
    words = ["New", "york", "NEW", "École", "école", "x" * 90, "a", "b", "the", "ß", "日本", "\x00", "ab\xa0c"]
    out = []
    for _ in range(rows):
        some = rng.choices(words, k=rng.randrange(0, 40)) + rng.choice([["new", "york", "city", "hall", "of", "the", "a"], [], ["a"] * 7])
        out.append(("".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r", "\x0b"]) for w in some), rng.choice(["en", "en", "de", None, "und"])))
    return out + [(None, "en"), ("", None), ("...", "fr"), ("word " * 3000, "de")] + out[:3]


@pytest.mark.parametrize("least, first", [(2, 2000), (5, 7)])
def test_equal_to_plain_version(spark, monkeypatch, least, first):
    rows = texts(least)
    frame = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS key", "'x' AS word", "2 AS f", "3 AS n", "'y' AS phrase").repartition(3)
    assert {tuple(r) for r in mine_collocations(frame, least=least, first=first).collect()} == plain(rows, least, first)


def test_small_shards_and_crowded_bitmaps(spark, monkeypatch):
    rows = texts(11, 60)
    monkeypatch.setattr(collocations, "LEAST_BITS", 64)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    assert {tuple(r) for r in mine_collocations(frame, least=3).collect()} == plain(rows, 3, 2000)


def test_empty_table(spark):
    assert mine_collocations(spark.createDataFrame([], "text string, lang string")).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array_and_intervals(seed):
    rng = np.random.default_rng(seed)
    ids, cut = rng.integers(0, 1 + 2 * seed, 300), rng.random(300) < 0.1
    cut[-1] = True
    left = left_in_run(cut)
    ends = [next(j for j in range(i, 300) if cut[j]) + 1 for i in range(300)]
    suffix = [tuple(ids[i : ends[i]]) for i in range(300)]
    order = suffix_array(ids, left, 5)
    assert [suffix[i][:5] for i in order] == sorted(s[:5] for s in suffix)
    lcp = common_prefixes(ids, left, order, 5)
    assert list(lcp[1:]) == [next((j for j in range(5) if suffix[a][j : j + 1] != suffix[b][j : j + 1] or len(suffix[a]) <= j), 5) for a, b in zip(order, order[1:])]
    for n, at, f in phrase_counts(ids, cut, 1, 5):
        want = collections.Counter(s[:n] for s in suffix if len(s) >= n)
        assert {suffix[i][:n]: int(c) for i, c in zip(at, f)} == dict(want) and len(at) == len(want)


def test_shards_of_a_task_are_cut_by_bytes(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(collocations, "SHARD_BYTES", 10)
    batch = pd.DataFrame({"text": ["abc def", "ghi, jkl", "m" * 30, "n"], "lang": ["en"] * 4})
    shards = list(collocations._shards([batch], 0))
    assert [[s.word(k) for k in range(len(s.key))] for s in shards] == [["abc", "def", "ghi", "jkl"], ["m" * 30], ["n"]]
    assert list(shards[0].cut) == [False, True, True, True]


def test_bitmap_holds_all_keys(spark):
    keys = [0, -1, 1, 2**63 - 1, -(2**63), 64, 12345678901]
    found = Bitmap.of(spark.createDataFrame([(k,) for k in keys], "key long"), len(keys))
    assert found.has(np.array(keys, np.int64).view(np.uint64)).all() and not found.has(np.arange(100, 164, dtype=np.uint64)).any()
