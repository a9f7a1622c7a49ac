"""Repeated passages: paragraph MinHash banding, exact verification, removals clustered by components.

Two kinds of units meet by key:

* paragraphs, the lines of PARAGRAPH_WORDS words or more. MinHash values of their five-word shingles are cut into bands,
  tuned so that paragraphs at the threshold collide with the wanted probability; colliding paragraphs are verified by the
  exact Jaccard similarity of their shingle sets, until every two of a bucket are in one component or have been compared.
* passages spliced into other text, which no line shows: windows of WINDOW_WORDS words at anchors that the words themselves
  choose (the smallest hash among SPREAD neighbouring places). Any run of WINDOW_WORDS + SPREAD - 1 words that two texts share
  holds a common window; these collide exactly when they are equal. Where common windows cover fewer than LEAST_WORDS words of a text,
  all windows within reach of them are units too, in every text that has them, so a shared run of LEAST_WORDS words is covered whole.

Units of one component are one passage. In each document overlapping units of a passage are one span, and only spans of
LEAST_WORDS words or more count. The smallest document id of a component keeps its spans, the others' go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.ngram_join import BRIEF, BROADCAST_IDS, _texts, link_lists, may_link, sketch
from weftline.llm.words import M3, batch_words, grams, in_parts, mix
from weftline.operators.graph import components
from weftline.runtime import discard, materialize, on_workers

PARAGRAPH_WORDS, WINDOW_WORDS, SPREAD, LEAST_WORDS = 35, 25, 8, 35
SHINGLE = 5


def tune_bands(threshold: float, recall: float, rows: int = 3) -> tuple[int, int]:
    """(bands, rows): the fewest bands of `rows` values with which sets at the threshold collide with probability `recall`."""
    hit = threshold**rows
    return int(np.ceil(np.log(1 - recall) / np.log(1 - hit))), rows


def anchors(g: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Places of the windows of all texts: the smallest gram of each SPREAD places in a row (the last one on ties), or of all places of a text that has fewer."""
    best = np.arange(len(g))
    step = 1
    while step < SPREAD:
        early, late = best[: max(0, len(best) - step)], best[step:]
        best = np.where(g[late] <= g[early], late, early)
        step *= 2
    first, size = docs[:-1], np.diff(docs)
    many = np.maximum(0, size - WINDOW_WORDS - SPREAD + 2)
    at = best[_ranges(first, many)]
    few = [int(a + n - 1 - np.argmin(g[a : a + n][::-1])) for a, n in zip(first.tolist(), (size - WINDOW_WORDS + 1).tolist(), strict=True) if 0 < n < SPREAD]
    return np.concatenate([at[:1], at[1:][at[1:] != at[:-1]], np.array(few, np.int64)])


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., many[0] of them, then those of first[1]."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def _windows(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW_WORDS words from each place on, from the grams they are made of."""
    with np.errstate(over="ignore"):
        out = g[at]
        for k in range(SHINGLE, WINDOW_WORDS, SHINGLE):
            out = out * M3 + g[at + k]
        return mix(out + np.uint64(WINDOW_WORDS))


def _names(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the words from a to b, each times an odd number that tells its place."""
    with np.errstate(over="ignore"):
        mixed = mix(h)
        one = np.concatenate([[0], np.cumsum(mixed)]).astype(np.uint64)
        placed = np.concatenate([[0], np.cumsum(mixed * np.arange(len(h), dtype=np.uint64))]).astype(np.uint64)
        first = a.astype(np.uint64)
        total = one[b] - one[a]
        return mix(np.uint64(2) * (placed[b] - placed[a] - first * total) + total + (b - a).astype(np.uint64))


def _band_keys(g: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key a band for each paragraph: the smallest of its grams by each of `rows` orders (products with odd numbers; repeats do not change a minimum)."""
    many = b - a - SHINGLE + 1
    flat, starts = g[_ranges(a, many)], np.cumsum(many) - many
    keys = np.zeros((len(a), bands), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = np.full(len(a), np.uint64(band + 1))
            for r in range(rows):
                odd = mix(np.array([band * rows + r + 1], np.uint64)) | np.uint64(1)
                key = mix(key * M3 + np.minimum.reduceat(flat * odd, starts))
            keys[:, band] = key
    return keys


def unit_rows(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """id, at, start, words, unit and keys of every paragraph and window: a paragraph's unit names its words, and it has band keys; a window has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_parts(batches):
            ids, ats = batch["id"].to_numpy(np.int64), batch["at"].to_numpy(np.int64)
            h, docs, lines = batch_words(batch["text"])
            g = grams(h, SHINGLE)
            at = anchors(g, docs)
            doc = np.searchsorted(docs, at, "right") - 1
            yield pd.DataFrame({"id": ids[doc], "at": ats[doc], "start": (at - docs[doc]).astype(np.int32), "words": WINDOW_WORDS, "unit": _windows(g, at).view(np.int64), "keys": None})
            a, b = lines[:-1], lines[1:]
            a, b = a[b - a >= PARAGRAPH_WORDS], b[b - a >= PARAGRAPH_WORDS]
            if not len(a):
                continue
            doc = np.searchsorted(docs, a, "right") - 1
            out = pd.DataFrame({"id": ids[doc], "at": ats[doc], "start": (a - docs[doc]).astype(np.int32), "words": (b - a).astype(np.int32), "unit": _names(h, a, b).view(np.int64)})
            out["keys"] = list(_band_keys(g, a, b, bands, rows).view(np.int64))
            yield out

    return texts.where("id IS NOT NULL").mapInPandas(run, "id long, at long, start int, words int, unit long, keys array<long>")


def near_windows(places: DataFrame, texts: DataFrame) -> DataFrame:
    """id, at, start, unit of every window of the texts that starts at most LEAST_WORDS - WINDOW_WORDS words from one of its places (id, at, start)."""
    reach = LEAST_WORDS - WINDOW_WORDS
    asked = materialize(places.groupBy("id", "at").agg(F.collect_set("start").alias("places")), "asked")  # no more places than the text has words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_parts(batches):
            h, docs, _ = batch_words(batch["text"])
            g = grams(h, SHINGLE)
            found = []
            for first, size, mine in zip(docs[:-1].tolist(), np.diff(docs).tolist(), batch["places"], strict=True):
                at = np.unique(np.add.outer(np.asarray(mine, np.int64), np.arange(-reach, reach + 1)))
                found.append(at[(at >= 0) & (at <= size - WINDOW_WORDS)] + first)
            at = np.concatenate([*found, np.zeros(0, np.int64)])
            doc = np.searchsorted(docs, at, "right") - 1
            ids, ats = batch["id"].to_numpy(np.int64), batch["at"].to_numpy(np.int64)
            yield pd.DataFrame({"id": ids[doc], "at": ats[doc], "start": (at - docs[doc]).astype(np.int32), "unit": _windows(g, at).view(np.int64)})

    few = asked.count() <= BROADCAST_IDS
    held = texts.join(F.broadcast(asked) if few else asked, ["id", "at"]).select("id", "at", "text", "places")
    out = materialize(held.mapInPandas(run, "id long, at long, start int, unit long"), "dense")
    discard(asked)
    return out


def shared_windows(windows: DataFrame) -> DataFrame:
    """id, at, start, end, unit, written, of the windows that two ids have."""
    common = materialize(windows.groupBy("unit").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("unit"), "common")
    few = common.count() <= BROADCAST_IDS
    hits = windows.join(F.broadcast(common) if few else common, "unit").select("id", "at", "start", (F.col("start") + WINDOW_WORDS).alias("end"), "unit")
    hits = materialize(hits, "hits")
    discard(common)
    return hits


def numbered_runs(units: DataFrame) -> DataFrame:
    """id, at, run, start, end, unit, written: overlapping units of a text are one run; a new one begins where no unit before reaches."""
    order = Window.partitionBy("id", "at").orderBy("start", "end", "unit")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = units.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    return materialize(marked.withColumn("run", F.sum("new").over(order)).select("id", "at", "run", "start", "end", "unit"), "runs")


def _paragraph_components(texts: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the paragraph names that are linked: they collide in a band and their shingle sets are similar.

    In a band each paragraph is compared with the bucket's smallest name, then with every other one in the bucket that is not yet in
    its component: buckets of linked paragraphs cost their length, and only unlinked members cost their pairs.
    """
    one = materialize(rows.groupBy("unit").agg(F.min(F.struct("id", "at", "start", "words", "keys")).alias("o")), "one")
    keyed = one.select("unit", F.explode("o.keys").alias("key")).distinct()
    lists = keyed.withColumn("hub", F.min("unit").over(Window.partitionBy("key"))).where("unit <> hub")
    lists = materialize(lists.select("key", "hub", F.col("unit").alias("node")), "lists")
    pairs = materialize(lists.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    asked = pairs.select(F.col("a").alias("unit")).unionByName(pairs.select(F.col("b").alias("unit"))).distinct()
    asked = asked.join(one, "unit").groupBy("o.id", "o.at").agg(F.collect_list(F.struct("unit", "o.start", "o.words")).alias("places"))
    asked = materialize(asked, "asked")  # a row a text, with its own paragraphs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_parts(batches):
            h, docs, _ = batch_words(batch["text"])
            g = grams(h, SHINGLE)
            rows = []
            for first, places in zip(docs[:-1].tolist(), batch["places"], strict=True):
                for p in places:
                    a = first + p["start"]
                    tokens = np.unique(g[a : a + p["words"] - SHINGLE + 1])
                    rows.append((p["unit"], len(tokens), sketch(tokens, BRIEF), tokens.view(np.int64)))
            yield pd.DataFrame(rows, columns=["node", "n", "brief", "tokens"])

    few = asked.count() <= BROADCAST_IDS
    sets = texts.join(F.broadcast(asked) if few else asked, ["id", "at"]).select("places", "text").mapInPandas(run, "node long, n int, brief array<long>, tokens array<long>")
    sets = materialize(sets.dropDuplicates(["node"]), "sets")  # every member of a list is here; rows that repeat id and text give theirs once

    def compare(pairs: DataFrame) -> DataFrame:
        # Sizes and sketches rule out most pairs on narrow rows; only what is left fetches tokens.
        of = sets.select("node", "n", "brief")
        near = pairs.join(of.toDF("a", "na", "sa"), "a").join(of.toDF("b", "nb", "sb"), "b").where(may_link(percent))
        near = materialize(near.select("a", "b", "na", "nb").distinct(), "near")
        tokens = sets.select("node", "tokens")
        both = near.join(tokens.toDF("b", "tb"), "b").join(tokens.toDF("a", "ta"), "a")
        shared = F.size(F.array_intersect("ta", "tb"))
        found = materialize(both.where(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b"), "links")
        discard(near)
        return found

    found = link_lists(lists.select("key", "node"), compare(pairs), pairs, sets, percent, compare)
    discard(one, lists, pairs, asked, sets)
    return found


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, recall: float = 0.97) -> DataFrame:
    """id_col, start_word, n_words, cluster_id, keep_id, kept: the spans of each document that another document has as well.

    start_word counts the words (runs without ASCII white space) of the whole text. cluster_id names the passage; keep_id is the smallest
    id that has it, whose spans are kept. Only passages in two documents or more count. Null and empty texts and null ids have no
    spans. Rows that repeat id and text are one row; rows that repeat an id with other texts are one document, with spans in each text.
    A passage of LEAST_WORDS words or more that two documents share word for word always counts. Other columns are ignored.
    """
    on_workers(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    # A text's hash tells the texts of one id apart; it travels with every window only where some id has two.
    twice = texts.groupBy("id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi")).where("id IS NOT NULL AND lo < hi").limit(1).count()
    texts = texts.withColumn("at", F.xxhash64("text") if twice else F.lit(0).cast("long"))
    bands, rows = tune_bands(percent / 100, recall)
    found = materialize(unit_rows(texts, bands, rows), "found")
    paragraphs, windows = found.where("keys IS NOT NULL"), found.where("keys IS NULL").select("id", "at", "start", "unit")
    of_paragraphs = _paragraph_components(texts, paragraphs, percent)
    named = paragraphs.select("id", "at", "start", "words", "unit").join(of_paragraphs, paragraphs["unit"] == of_paragraphs["node"], "left")
    named = named.select("id", "at", "start", "words", F.coalesce("component", "unit").alias("unit"))
    shared = named.groupBy("unit").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("unit")
    spans = named.join(shared, "unit").select("id", "at", "start", (F.col("start") + F.col("words")).alias("end"), F.xxhash64(F.lit("paragraph"), "unit").alias("unit"))

    hits = shared_windows(windows)
    units = materialize(hits.unionByName(spans), "units")
    discard(found, hits)
    runs = numbered_runs(units)
    # Runs too short to count may be parts of a passage that does: their windows' neighbours decide, wherever these windows are.
    short = runs.groupBy("id", "at", "run").agg((F.max("end") - F.min("start")).alias("n"), F.collect_set("unit").alias("units")).where(F.col("n") < LEAST_WORDS)
    short = materialize(short.select(F.explode("units").alias("unit")).distinct(), "short")
    if n_short := short.limit(BROADCAST_IDS + 1).count():
        places = units.join(F.broadcast(short) if n_short <= BROADCAST_IDS else short, "unit").select("id", "at", "start")
        dense = near_windows(places, texts)
        more = shared_windows(dense)
        both = materialize(units.unionByName(more), "units")
        discard(runs, units, dense, more)
        units, runs = both, numbered_runs(both)
    discard(short, units)
    whole = runs.groupBy("id", "at", "run").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("unit").alias("first"))
    whole = whole.where(F.col("end_word") - F.col("start_word") >= LEAST_WORDS)
    edges = runs.join(whole.select("id", "at", "run", "first"), ["id", "at", "run"]).select(F.col("first").alias("a"), F.col("unit").alias("b")).distinct()
    passage = components(edges, "a", "b")
    spans = whole.join(passage, whole["first"] == passage["node"]).select("id", "start_word", "end_word", F.col("component").alias("cluster_id"))
    spans = materialize(spans, "spans")
    keeper = spans.groupBy("cluster_id").agg(F.min("id").alias("keep_id"), F.max("id").alias("last")).where("keep_id < last")
    out = spans.join(keeper, "cluster_id")
    kind = docs.schema[id_col].dataType
    return out.select(
        F.col("id").cast(kind).alias(id_col), "start_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "cluster_id",
        F.col("keep_id").cast(kind).alias("keep_id"), (F.col("id") == F.col("keep_id")).alias("kept"),
    )
