"""Collocations: phrases of two to five words that stand together more often than their parts would let expect.

Texts are read shard by shard, a shard being some SHARD_BYTES of one task's texts. A shard's words become numbers, its pieces runs of numbers, and
a suffix array over all runs, made by prefix doubling in numpy, brings equal phrases together: an interval of neighbours whose common
prefix (LCP) has n words or more is one phrase of n words, its length the phrase's count. Counts of all shards are merged by key, exactly.

Three passes keep what is merged small without losing a phrase that is frequent enough:
1. words: all of them, with their spelling; n of a language is their sum.
2. pairs of two frequent words, under one 64-bit key each (a shared key can only raise a count, so it loses nothing).
3. phrases all of whose neighbouring pairs are frequent, under their words' keys.
What is frequent goes to the tasks as a bitmap of bounded size; a bit that two keys share costs work, not correctness.
A word's key is a 64-bit hash of language and word; if two words share one, all passes are run again with another seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.words import M3, hash_runs, mix
from weftline.runtime import discard, materialize, on_workers

LONGEST = 5
#: UTF-8 bytes of a shard; a longer text is a shard of its own.
SHARD_BYTES = 1 << 22
#: Bits of a bitmap: sixteen for each key, within these bounds (at most 32 MB are broadcast; beyond 2^24 keys more of the rest passes, and is counted).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Parts that a language's phrases are ranked in before the parts' first ones are ranked together.
RANK_PARTS = 64
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True


class Shard:
    """The words of some texts: key of each, where its bytes are, which text it is from, and whether its piece ends after it."""

    def __init__(self, texts: list[bytes], langs: list[str], seed: int):
        # A text ends with a line feed, so no piece crosses texts.
        self.data, self.langs = b"\n".join([*texts, b"\0" * 8]), langs
        flat = np.frombuffer(self.data, np.uint8)[:-8]
        inside = np.zeros(len(flat) + 2, bool)
        inside[1:-1] = ~_GAP[flat]
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = turns[::2], turns[1::2]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.text = np.searchsorted(begins, self.starts, "right") - 1
        code = np.array([xxhash.xxh3_64_intdigest(x, seed) for x in langs], np.uint64)
        with np.errstate(over="ignore"):
            self.key = mix(hash_runs(self.data, self.starts, self.ends) ^ code[self.text])
        piece = np.concatenate([[0], np.cumsum(_BREAK[flat])])[self.starts]
        self.cut = np.append(piece[1:] != piece[:-1], True)[: len(piece)]

    def word(self, at: int) -> str:
        return self.data[self.starts[at] : self.ends[at]].decode()


def left_in_run(cut: np.ndarray) -> np.ndarray:
    """Words from each place to the end of its run; cut: whether a run ends after the place."""
    ends = np.flatnonzero(cut)
    return ends[np.searchsorted(ends, np.arange(len(cut)))] - np.arange(len(cut)) + 1 if len(cut) else np.zeros(0, np.int64)


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their next `depth` words at least (a run's end comes before any word), by prefix doubling."""
    rank, k, n = ids.astype(np.int64) + 1, 1, np.int64(len(ids) + 1)
    order = np.argsort(rank, kind="stable")
    while k < depth:
        ahead = np.zeros(len(ids), np.int64)
        on = np.flatnonzero(left > k)
        ahead[on] = rank[on + k]
        both = rank * n + ahead
        order = np.argsort(both, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], both[order][1:] != both[order][:-1]]))
        k *= 2
    return order


def common_prefixes(ids: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """LCP of each suffix with the one before it, in words, at most depth; 0 for the first."""
    a, b = order[:-1], order[1:]
    lcp, same = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    top = len(ids) - 1
    for j in range(depth):
        same = same & (left[a] > j) & (left[b] > j) & (ids[np.minimum(a + j, top)] == ids[np.minimum(b + j, top)])
        lcp[1:] += same
    return lcp


def phrase_counts(ids: np.ndarray, cut: np.ndarray, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, a place of each distinct phrase of n words, its count) for n from least to most."""
    left = left_in_run(cut)
    order = suffix_array(ids, left, most)
    lcp = common_prefixes(ids, left, order, most)
    for n in range(least, most + 1):
        whole = left[order] >= n
        # Suffixes of an interval stand together, and those too short for n words come before them.
        at = order[whole]
        first = np.flatnonzero(lcp[whole] < n)
        yield n, at[first], np.diff(np.append(first, len(at)))


class Bitmap:
    """A set of 64-bit keys; may hold more than it was given."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    def has(self, key: np.ndarray) -> np.ndarray:
        at = key & self.mask
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    @staticmethod
    def of(keys: DataFrame, n_keys: int) -> Bitmap:
        """Of column key; what reaches the driver is at most the bitmap."""
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n_keys - 1).bit_length() if n_keys else 0))
        at = F.pmod(F.col("key"), F.lit(bits))
        rows = keys.select((at / 64).cast("int").alias("w"), F.expr("shiftleft(1L, CAST(pmod(key, 64) AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
        words = np.zeros(bits // 64, np.uint64)
        words[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).view(np.uint64)
        return Bitmap(words)


def pair_keys(key: np.ndarray) -> np.ndarray:
    """Key of each word with the next one."""
    with np.errstate(over="ignore"):
        return mix(key[:-1] * M3 + key[1:])


def _shards(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[Shard]:
    texts, langs, size = [], [], 0
    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"], strict=True):
            texts.append(text.encode().lower())
            langs.append(lang)
            size += len(texts[-1])
            if size >= SHARD_BYTES:
                yield Shard(texts, langs, seed)
                texts, langs, size = [], [], 0
    if texts:
        yield Shard(texts, langs, seed)


def count_words(texts: DataFrame, seed: int) -> DataFrame:
    """key, lang, word and f of all words, and clash: whether two words share the key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard in _shards(batches, seed):
            _, ids = np.unique(shard.key, return_inverse=True)
            for _, at, f in phrase_counts(ids, np.ones(len(ids), bool), 1, 1):
                spelling, langs = [shard.word(k) for k in at.tolist()], [shard.langs[k] for k in shard.text[at].tolist()]
                yield pd.DataFrame({"key": shard.key[at].view(np.int64), "lang": langs, "word": spelling, "f": f})

    counted = texts.mapInPandas(run, "key long, lang string, word string, f long").groupBy("key")
    clash = (F.min("lang") != F.max("lang")) | (F.min("word") != F.max("word"))
    return counted.agg(F.min("lang").alias("lang"), F.min("word").alias("word"), F.sum("f").alias("f"), clash.alias("clash"))


def count_pairs(texts: DataFrame, seed: int, words: Bitmap) -> DataFrame:
    """key and f of pairs of neighbours of which both are in words."""
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard in _shards(batches, seed):
            often = shared.value.has(shard.key)
            near = np.flatnonzero(often & np.append(often[1:], False) & ~shard.cut) if len(often) else np.zeros(0, np.int64)
            # Runs of frequent words: what is not frequent parts them.
            keep = np.union1d(near, near + 1)
            _, ids = np.unique(shard.key[keep], return_inverse=True)
            cut = np.append(np.diff(keep) != 1, True)[: len(keep)] | shard.cut[keep]
            for _, at, f in phrase_counts(ids, cut, 2, 2):
                place = keep[at]
                with np.errstate(over="ignore"):
                    yield pd.DataFrame({"key": mix(shard.key[place] * M3 + shard.key[place + 1]).view(np.int64), "f": f})

    return texts.mapInPandas(run, "key long, f long").groupBy("key").agg(F.sum("f").alias("f"))


def count_phrases(texts: DataFrame, seed: int, pairs: Bitmap, longest: int) -> DataFrame:
    """phrase (its words' keys) and f of phrases of two to `longest` words all of whose pairs of neighbours are in pairs."""
    shared = texts.sparkSession.sparkContext.broadcast(pairs)
    names = [f"w{k}" for k in range(longest)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard in _shards(batches, seed):
            near = np.append(shared.value.has(pair_keys(shard.key)), False)[: len(shard.key)] & ~shard.cut
            first = np.flatnonzero(near)
            keep = np.union1d(first, first + 1)
            _, ids = np.unique(shard.key[keep], return_inverse=True)
            for n, at, f in phrase_counts(ids, ~near[keep], 2, longest):
                rows = np.zeros((longest, len(at)), np.int64)
                for k in range(n):
                    rows[k] = shard.key[keep[at] + k].view(np.int64)
                yield pd.DataFrame({"n": n, **dict(zip(names, rows, strict=True)), "f": f})

    kinds = ", ".join(["n int", *(f"{x} long" for x in names), "f long"])
    merged = texts.mapInPandas(run, kinds).groupBy("n", *names).agg(F.sum("f").alias("f"))
    return merged.select(F.slice(F.array(*names), F.lit(1), F.col("n")).alias("phrase"), "f")


def _maximal(phrases: DataFrame) -> DataFrame:
    """The phrases that do not stand inside a longer one that is as frequent.

    If one of any length does, so does one that is a single word longer: what stands between the two is no rarer than the longer one.
    """
    size = F.size("phrase")
    inner = phrases.where(size > 2).select(F.explode(F.array(F.slice("phrase", F.lit(1), size - 1), F.slice("phrase", F.lit(2), size - 1))).alias("phrase"), "f")
    longer = inner.groupBy("phrase").agg(F.max("f").alias("in_longer"))
    return phrases.join(longer, "phrase", "left").where("in_longer IS NULL OR in_longer < f").select("phrase", "f")


def mine_collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, first: int = 2000, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's `first` best phrases of 2 to `longest` words that occur `least` times or more.

    A to Z are lower-cased; texts are split at [.,;:!?\\x0A-\\x0D] into pieces and those at blanks and tabs into words. n is a language's
    number of words, a a phrase's occurrences in pieces, overlaps included, l and r those of the two parts of the cut with the lowest score
    floor(1000 a n / (l r)), ties to the shorter first part. Phrases inside a longer one of the same count are left out. Order: score and a
    descending, then the phrase's UTF-8 bytes. Null texts count as empty, a null language as `und`; repeated rows count again, ids do
    not matter, a text of any length is read whole, an empty table gives no row, other columns are ignored.
    """
    spark = docs.sparkSession
    on_workers(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")).where("text <> ''")
    seed = 0
    while True:
        words = materialize(count_words(texts, seed), "words")
        if words.where("clash").limit(1).count() == 0:
            break
        discard(words)
        seed += 1
    often = words.where(F.col("f") >= least)
    pairs = materialize(count_pairs(texts, seed, Bitmap.of(often, often.count())).where(F.col("f") >= least), "pairs")
    phrases = materialize(count_phrases(texts, seed, Bitmap.of(pairs, pairs.count()), longest).where(F.col("f") >= least), "phrases")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    # Every part of a frequent phrase is frequent, so it is among the words and phrases counted.
    parts = phrases.unionByName(often.select(F.array("key").alias("phrase"), "f"))
    spelled = _maximal(phrases).select("phrase", F.col("f").alias("a"), F.posexplode("phrase").alias("pos", "key")).join(often.select("key", "lang", "word"), "key")
    spelled = spelled.groupBy("phrase", "a").agg(F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    spelled = spelled.select("phrase", "a", "lang", F.array_join(F.col("w.word"), " ").alias("text")).join(totals, "lang")
    size = F.size("phrase")
    cuts = spelled.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("phrase", F.lit(1), F.col("k")), "right": F.slice("phrase", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(parts.select(F.col("phrase").alias("left"), F.col("f").alias("l")), "left").join(parts.select(F.col("phrase").alias("right"), F.col("f").alias("r")), "right")
    big = {c: F.col(c).cast("decimal(38,0)") for c in "anlr"}
    # Whole numbers of up to 38 digits; the quotient of two of them is exact before it is cut.
    cuts = cuts.withColumns({"over": 1000 * big["a"] * big["n"], "under": big["l"] * big["r"]}).withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("phrase", "lang", "a", "n", "text").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    rows = best.select("lang", F.col("text").alias("phrase"), "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    some = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
