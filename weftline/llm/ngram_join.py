"""Exact Jaccard self-join of word n-gram sets by universe-partition pigeonhole.

Sets whose Jaccard similarity is at least t differ in at most H = (1-t)/(1+t) * (size + size) tokens. The universe of tokens is
hashed into segments, the same for all sets of a size band, so two linked sets have few segments that differ.

* Bands. Sizes grow fourfold from band to band. A set is indexed in its own band and, if it may link with smaller sets below, in
  the band below as well.
* Thresholds. A segment of threshold 0 matches whole, and a pair that differs in it spends one of its H differences there. A segment
  of threshold 1 matches whole or with one token deleted on either side (its one-deletion neighbourhood), and a pair that does
  not match there has spent two. Segments that are not needed get no threshold and no row.
* Allocation. Part of a band's universe may be set aside for segments of threshold 1; how large a part, none included, is
  chosen for each band by what the choices cost on a sample: index rows, and pairs that meet. On the rest a set gives
  threshold 0 to as many segments as its remaining differences need and one more, in an order that depends on a segment's
  content alone, those of frequent tokens only last. By the prefix principle two linked sets share one of these.
  In the smallest band (H at most 1) the whole set is one segment of threshold 1.

Equal sets are one node. Sets that share a key are compared with the first member of the key's list, then with all that are not in
their component yet, all at once. A pair's sizes and parity sketches (one bit a bucket of tokens: no more bits differ than tokens do) rule out
most pairs that are not linked; the others are compared token by token. Lists of frequent tokens are dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.words import M3, in_parts, mix, shingle_sets
from weftline.operators.graph import components
from weftline.runtime import discard, materialize, on_workers, release

#: Sizes at which bands begin, by rule: 1, 6, then four times the one before.
FIRST, RATIO, BANDS = 6, 4, 16
#: Documents sampled for the cost model's frequent tokens, the count that makes one frequent, and how many are kept.
COST_DOCS, COST_COUNT, COST_TOKENS = 5_000, 4, 50_000
#: Documents sampled for the allocation, and what a pair that meets costs in index rows.
ALLOCATION_DOCS, PAIR_ROWS = 1_000, 20
#: Tasks that a list of frequent tokens is dealt over.
SALTS = 64
#: Nodes whose texts are fetched by a broadcast of their ids; beyond, by a shuffle.
BROADCAST_IDS = 500_000
#: 64-bit words of the sketch that lists carry; rounds in which each list meets one more member before all that is left is listed.
BRIEF, ROUNDS = 16, 1
#: Members of a list for each part it is dealt over where all members meet.
LIST_PART = 4_096
#: Lists that a node names where all members meet: its smallest keys, by which a pair is told once and not in each list it shares.
NAMED_LISTS = 16
#: Passes over the index, a column of keys each, so that only this share of it is on its way at a time.
PASSES = 4
#: Names of sets that a task remembers so as to index a set once; the rest is left to the lists.
SEEN_NAMES = 500_000


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def name(tokens: np.ndarray, seed: int) -> tuple[int, int]:
    """Two 64-bit names of a set, from its tokens in any order."""
    with np.errstate(over="ignore"):
        mixed = mix(tokens + np.uint64(2 * seed + 11))
        pair = np.array([mixed.sum(dtype=np.uint64), mix(mixed + M3).sum(dtype=np.uint64)])
    return tuple(mix(pair).view(np.int64).tolist())


def sketch(tokens: np.ndarray, words: int = 0) -> np.ndarray:
    """Parity of the number of tokens in each bucket, in 64-bit words: `words` of them, or a power of two with two buckets a token or more.

    Two sets' sketches of one size differ in no more bits than the sets in tokens. Buckets are the tokens' low bits, so the
    halves of a sketch together (exclusive or) are the sketch of half the size.
    """
    size = 64 * words or 1 << max(6, (2 * len(tokens) - 1).bit_length())
    odd = (np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


class Plan:
    """Bands, bounds, allocation and segment keys for one threshold, percent / 100."""

    def __init__(self, percent: int, aside: dict[int, int] | None = None):
        self.percent = percent
        self.begins = [1] + [FIRST * RATIO**k for k in range(BANDS)]
        self.aside = aside or {}

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.begins, n, "right")) - 1

    def bound(self, n: int, most: int) -> int:
        """Largest symmetric difference of linked sets of n and at most `most` tokens."""
        return (100 - self.percent) * (n + most) // (100 + self.percent)

    def places(self, n: int) -> list[tuple[int, int]]:
        """(band, H) of the bands a set of n tokens is indexed in."""
        band = self.band(n)
        out = [(band, self.bound(n, 100 * n // self.percent))]
        if band and -(-self.percent * n // 100) < self.begins[band]:
            out.append((band - 1, self.bound(n, self.begins[band] - 1)))
        return out

    def choices(self, band: int) -> list[int]:
        """How many segments of threshold 1 a band may have, of as many as would hold its whole universe in some four tokens each."""
        parts = self.parts(band)
        return [0] if band < 2 else [0, parts // 8 or 1, parts // 4]

    def parts(self, band: int) -> int:
        return 1 << (self.begins[band] // 4).bit_length()

    def shift(self, band: int) -> int:
        """Segments of threshold 0 are a token's first bits: two segments and more a token of the band's smallest set; in small bands each token is one."""
        return 0 if band < 2 else 64 - (2 * self.begins[band]).bit_length()

    def keys(self, tokens: np.ndarray, band: int, h: int, frequent: np.ndarray) -> tuple[np.ndarray, int, bool]:
        """(index keys of a set in a band, how many at the end are of frequent tokens only, whether they suffice).

        They may not suffice, if tokens crowd in too few segments; the caller then hashes all tokens anew.
        """
        with np.errstate(over="ignore"):
            salt = np.uint64(band + 1) * M3
            mixed = mix(tokens + M3)
            if band == 0:
                whole = mixed.sum()
                near = whole - mixed if h and len(tokens) > 1 else mixed[:0]
                return mix(np.append(near, whole) ^ salt), 0, True
            common = np.zeros(len(tokens), bool)
            if len(frequent):
                common = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
            out, dear = [], []
            if aside := self.aside.get(band, 0):
                part = tokens & np.uint64(self.parts(band) - 1)
                for k in range(aside):
                    mine = part == np.uint64(k)
                    own, often = mixed[mine], common[mine]
                    if not len(own):
                        continue
                    whole, rare = own.sum(), len(own) - int(often.sum())
                    out.append(mix(np.array([whole + np.uint64(k)]) ^ ~salt))
                    dear.append(np.array([rare == 0]))
                    if len(own) > 1:
                        h -= 2
                        out.append(mix((whole - own + np.uint64(k)) ^ ~salt))
                        dear.append(rare - (~often).astype(int) == 0)
                left = part >= np.uint64(aside)
                tokens, mixed, common = tokens[left], mixed[left], common[left]
            enough = True
            if h >= 0 and not (enough := len(tokens) > h):
                return mixed[:0], 0, False
            if h >= 0:
                segment = tokens >> np.uint64(self.shift(band))
                starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
                enough = len(starts) > h
                key = mix((np.add.reduceat(mixed, starts) ^ salt) + mix(segment[starts] + salt))
                often = np.logical_and.reduceat(common, starts)
                if len(key) > h + 1:
                    # One rare token is enough to tell a segment from most others.
                    first = np.argpartition((key >> np.uint64(1)) | (often.astype(np.uint64) << np.uint64(63)), h)[: h + 1]
                    key, often = key[first], often[first]
                out.append(key)
                dear.append(often)
            if not out:
                return mixed[:0], 0, enough
            key, often = np.concatenate(out), np.concatenate(dear)
            return np.concatenate([key[~often], key[often]]), int(often.sum()), enough


def frequent_tokens(texts: DataFrame, n_docs: int, n_words: int) -> np.ndarray:
    """Tokens that many of a bounded sample of documents hold: they steer costs, never results."""
    parts = max(1, n_docs // COST_DOCS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_parts(batches):
            found = shingle_sets(batch["text"], n_words)
            yield pd.DataFrame({"token": _signed(np.concatenate([*found, np.zeros(0, np.uint64)]))})

    sample = texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == 0).select("text")
    counts = sample.mapInPandas(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COST_COUNT)
    top = counts.orderBy(F.col("n").desc(), "token").limit(COST_TOKENS).select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(top.view(np.uint64))


def allocate(texts: DataFrame, n_docs: int, n_words: int, percent: int, frequent: np.ndarray) -> dict[int, int]:
    """band -> how many segments of threshold 1 it gets: the choice with the least index rows and pairs on a bounded sample of sets.

    Pairs grow with the square of the rows, so a pair of the sample weighs as often as the sample fits in the table.
    """
    parts = max(1, n_docs // ALLOCATION_DOCS)
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = Plan(percent)
        for batch in in_parts(batches):
            for tokens in shingle_sets(batch["text"], n_words):
                for band, h in plan.places(len(tokens)) if len(tokens) else ():
                    for aside in plan.choices(band)[1:] and plan.choices(band):
                        plan.aside = {band: aside}
                        key, _, enough = plan.keys(tokens, band, h, shared.value)
                        yield pd.DataFrame({"band": band, "aside": aside, "short": not enough, "key": _signed(key)})

    sample = texts.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(parts)) == 0).select("text").distinct()
    rows = sample.mapInPandas(run, "band int, aside int, short boolean, key long")
    keys = rows.groupBy("band", "aside", "key").agg(F.count(F.lit(1)).alias("k"), F.max("short").alias("short"))
    cost = keys.groupBy("band", "aside").agg((F.sum("k") + F.sum(F.col("k") * (F.col("k") - 1) / 2) * float(PAIR_ROWS * parts)).alias("cost")).where(~F.max("short"))
    best = cost.groupBy("band").agg(F.min_by("aside", F.struct("cost", "aside")).alias("aside")).collect()  # a row a band
    return {r["band"]: r["aside"] for r in best if r["aside"]}


def summarize(texts: DataFrame, plan: Plan, n_words: int, seed: int, frequent: np.ndarray) -> DataFrame:
    """A row a document: id, at (hash of its text), n, node and check (names of its set), and once a task for each set its sketches (brief, and sketch if that says more) and its keys, dealt over PASSES columns, those of frequent tokens apart.

    short: the keys don't suffice.
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    turn = np.uint64(seed)
    columns = [f"keys{p}" for p in range(PASSES)]
    none = [None] * (PASSES + 3)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        seen: set[int] = set()
        for batch in in_parts(batches):
            rows = []
            for tokens in shingle_sets(batch["text"], n_words):
                if seed:
                    tokens = np.sort(mix(tokens ^ turn))
                n = len(tokens)
                if not n:
                    rows.append((0, 0, 0, False, *none))
                    continue
                node, check = name(tokens, seed)
                if node in seen:
                    rows.append((n, node, check, False, *none))
                    continue
                if len(seen) < SEEN_NAMES:
                    seen.add(node)
                found = [plan.keys(tokens, b, h, shared.value) for b, h in plan.places(n)]
                keys = np.concatenate([k[: len(k) - often] for k, often, _ in found])
                dear = np.concatenate([k[len(k) - often :] for k, often, _ in found])
                full = sketch(tokens) if 2 * n > 64 * BRIEF else None
                each = keys % np.uint64(PASSES)
                rows.append((n, node, check, not all(x[2] for x in found), sketch(tokens, BRIEF), full, _signed(dear), *(_signed(keys[each == p]) for p in range(PASSES))))
            out = pd.DataFrame(rows, columns=["n", "node", "check", "short", "brief", "sketch", "dear", *columns])
            out.insert(0, "at", batch["at"].to_numpy())
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    # Ids travel through Python as text: beside a null, pandas would round large ones.
    kinds = "id string, at long, n long, node long, check long, short boolean, brief array<long>, sketch array<long>, dear array<long>, " + ", ".join(f"{c} array<long>" for c in columns)
    return texts.select(F.col("id").cast("string").alias("id"), F.xxhash64("text").alias("at"), "text").mapInPandas(run, kinds).withColumn("id", F.col("id").cast("long"))


def _differing(a: str, b: str) -> Column:
    """How many bits differ of two sketches, the longer one folded once (sizes of pairs are within one doubling)."""

    def folded(x: str) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    left = F.when(F.size(a) > F.size(b), folded(a)).otherwise(F.col(a))
    right = F.when(F.size(b) > F.size(a), folded(b)).otherwise(F.col(b))
    return F.aggregate(F.zip_with(left, right, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)


def may_link(percent: int) -> Column:
    """Whether sizes na, nb and brief sketches sa, sb allow a link. No linked pair is lost."""
    sizes = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    bits = sum((F.bit_count(F.col("sa")[k].bitwiseXOR(F.col("sb")[k])) for k in range(1, BRIEF)), F.bit_count(F.col("sa")[0].bitwiseXOR(F.col("sb")[0])))
    return sizes & ((100 + percent) * bits <= (100 - percent) * (F.col("na") + F.col("nb")))


def prune(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb of the pairs that sizes and sketches do not rule out. No linked pair is lost."""
    of = nodes.select("node", "n", "brief", "sketch")
    near = pairs.join(of.toDF("a", "na", "sa", "fa"), "a").join(of.toDF("b", "nb", "sb", "fb"), "b").where(may_link(percent))
    fit = F.when(F.col("fa").isNotNull() & F.col("fb").isNotNull(), (100 + percent) * _differing("fa", "fb") <= (100 - percent) * (F.col("na") + F.col("nb"))).otherwise(True)
    return near.where(fit).select("a", "b", "na", "nb")


def verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, n_words: int, repeats: bool) -> DataFrame:
    """The linked ones of pairs (a, b, na, nb), written: compared token by token.

    Each set is computed from the text of one document that has it; that document is found by id and text hash, null ids too.
    repeats: some rows have both id and text in common, so that a document may be found more than once.
    """
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked = materialize(asked.join(nodes.select("node", "doc"), "node").select("node", F.col("doc.id").alias("i"), F.col("doc.at").alias("t")), "asked")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in in_parts(batches):
            yield pd.DataFrame({"node": batch["node"].to_numpy(), "tokens": list(map(_signed, shingle_sets(batch["text"], n_words)))})

    n_asked = asked.count()
    if not n_asked:
        discard(asked)
        return materialize(pairs.select("a", "b"), "links")
    few = n_asked <= BROADCAST_IDS
    wanted = F.broadcast(asked) if few else asked
    fetched = texts.join(wanted, (F.xxhash64("text") == F.col("t")) & F.col("id").eqNullSafe(F.col("i"))).select("node", "text")
    if repeats:
        fetched = fetched.groupBy("node").agg(F.min("text").alias("text"))
    sets = materialize(fetched.mapInPandas(run, "node long, tokens array<long>"), "tokens")
    # The members' tokens travel to their hubs; the hub's own are not copied before the last join.
    half = pairs.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    full = half.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
    shared = F.size(F.array_intersect("ta", "tb"))
    links = materialize(full.where(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b").distinct(), "links")
    discard(asked, sets)
    return links


def _labels(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with the component of their node, the node itself where it has no link yet."""
    return rows.join(found.withColumnRenamed("component", "__c"), "node", "left").withColumn("component", F.coalesce("__c", "node")).drop("__c")


def members_met(rest: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """a, b of the members of lists (key, node, component, and k, the list's members) that are in different components and may be linked by nodes' n and brief.

    A list is dealt over k / LIST_PART parts, each of which meets all of it: the comparisons of a long list are many tasks' work. A pair that
    shares many lists passes in the first that both name; where both name none in common it passes in each.
    """
    named = rest.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("key")), 1, NAMED_LISTS).alias("named"))
    of = rest.withColumn("parts", F.expr(f"int(ceil(k / {LIST_PART}))")).join(named, "node").join(nodes.select("node", "n", "brief"), "node")
    part, each = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    one = of.select("key", part.alias("part"), F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("brief").alias("sa"), F.col("named").alias("la"))
    other = of.select(F.col("key").alias("other"), each.alias("part"), F.col("node").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("brief").alias("sb"), F.col("named").alias("lb"))
    first = F.coalesce(F.array_min(F.array_intersect("la", "lb")) >= F.col("key"), F.lit(True))
    apart = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
    return one.join(other, (one["key"] == other["other"]) & (one["part"] == other["part"]) & apart & may_link(percent) & first).select("a", "b")


def link_lists(members: DataFrame, links: DataFrame, tested: DataFrame, nodes: DataFrame, percent: int, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) once every two members (key, node) of a list are in one component, cannot be linked by size and sketch, or have been compared.

    links and tested: the pairs (a, b) found and compared so far; nodes: node, n and brief; compare writes the linked ones of its pairs.
    Members of a list meet by a join that lets only pairs pass that may be linked, so what it gives follows the links and near misses, not the square of a list.
    """
    found = components(links, "a", "b")
    for last in [False] * ROUNDS + [True]:
        # What is left of a list matters only while it spans components, and once for all lists of the same members.
        rest = _labels(members, found)
        of_component = rest.groupBy("key", "component").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64(F.lit("other"), "node")).alias("g"), F.min("node").alias("hub"))
        spans = of_component.groupBy("key").agg(
            F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("same"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"), F.count(F.lit(1)).alias("parts"),
            F.max(F.struct("component", "hub")).alias("o"),
        )
        spans = spans.where("parts > 1").groupBy("k", "h", "g", "same", "parts").agg(F.min(F.struct("key", "o")).alias("o"))
        spans = materialize(spans.select("o.key", "o.o.component", "o.o.hub", "k"), "spans")
        if spans.limit(1).count() == 0:
            discard(spans, links, tested)
            return found
        if last:
            break
        # All meet a member of a late component: groups that the first members did not link are linked here, not pair by pair below.
        met = rest.join(spans.withColumnRenamed("component", "__of"), "key").where(F.col("component") != F.col("__of"))
        pairs = met.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
        pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "new")
        more = compare(pairs)
        n_more = more.count()
        both, all_tested = materialize(links.unionByName(more), "links"), materialize(tested.unionByName(pairs), "tested")
        discard(links, tested, pairs, more)
        links, tested = both, all_tested
        if not n_more:
            break
        discard(found, spans)
        found = components(links, "a", "b")
    rest = materialize(rest.join(spans.select("key", "k"), "key"), "rest")
    met = members_met(rest, nodes, percent)
    pairs = materialize(met.distinct().join(tested, ["a", "b"], "left_anti"), "new")
    more = compare(pairs)
    both = materialize(links.unionByName(more), "links")
    discard(spans, rest, pairs, more, links, found, tested)
    found = components(both, "a", "b")
    discard(both)
    return found


def _lists(sets: DataFrame) -> list[DataFrame]:
    """key, salt, hub, node, written, a frame a pass: every two sets that share a key stand under its smallest node, the hub, which is listed too if the key is salted.

    Keys of frequent tokens are dealt over SALTS lists each, in a pass of their own.
    """
    passes = [sets.select(F.explode(f"keys{p}").alias("key"), F.lit(0).alias("salt"), "node") for p in range(PASSES)]
    passes.append(sets.select(F.explode("dear").alias("key"), (F.pmod("node", F.lit(SALTS)) + 1).cast("int").alias("salt"), "node"))
    return [materialize(_met(index), "lists") for index in passes]


def _met(index: DataFrame) -> DataFrame:
    order = Window.partitionBy("key", "salt").orderBy("node")
    met = index.withColumns({"hub": F.first("node").over(order), "before": F.lag("node").over(order)})
    return met.where("before <> node OR (before IS NULL AND salt > 0)").select("key", "salt", "hub", "node")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, n_words: int = 5) -> DataFrame:
    """id_col, n_shingles, component_id and keep_hash of every row: the smallest id reachable by links, itself included, and the xxhash64 of that row's text.

    Rows link when 100 * intersection >= percent * union of their sets of distinct n-word shingles. Rows without words, or with
    a null text, have an empty set and link with nothing. Rows with the same id are each compared by their own text; a null id
    joins a component like any other and is never its smallest unless it has no other. Other columns are ignored. percent is 75 to 100:
    below, two linked sets may share no segment of the smallest band, so it is an error.
    """
    if not 75 <= percent <= 100:
        raise ValueError(f"percent is 75 to 100, not {percent}")
    on_workers(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    n_docs = texts.count()
    frequent = frequent_tokens(texts, n_docs, n_words)
    plan = Plan(percent, allocate(texts, n_docs, n_words, percent, frequent))
    seed = 0
    while True:
        sets = materialize(summarize(texts, plan, n_words, seed, frequent), "sets")
        nodes = sets.where("n > 0").groupBy("node").agg(
            F.max(F.struct("id", "at")).alias("doc"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("least"), F.max("n").alias("n"), F.max("brief").alias("brief"), F.max("sketch").alias("sketch"),
            ((F.max("n") != F.min("n")) | (F.max("check") != F.min("check")) | F.max("short")).alias("again"),
        )
        nodes = materialize(nodes, "nodes")
        if nodes.where("again").limit(1).count() == 0:
            break
        # Two different sets have one 64-bit name, or a set has too few segments: hash anew, set nothing aside.
        seed, plan = seed + 1, Plan(percent)
        discard(sets, nodes)
    lists = _lists(sets.where("dear IS NOT NULL"))
    grouped = reduce(DataFrame.unionByName, lists)
    ids = materialize(sets.select("id", "at", "n", "node"), "ids")
    discard(sets)
    repeats = ids.where("n > 0").groupBy("id", "at").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count() > 0
    hubs = grouped.where("salt > 0").groupBy("key", "hub").agg(F.min("hub").alias("node"))
    hubs = hubs.select("key", F.min("node").over(Window.partitionBy("key")).alias("hub"), "node")  # at most SALTS rows a key
    pairs = grouped.select("hub", "node").unionByName(hubs.select("hub", "node")).where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    pairs = materialize(pairs.distinct(), "pairs")
    near = materialize(prune(pairs, nodes, percent), "near")
    discard(pairs)
    # One hub a node first; most of the other pairs are in one component then.
    first = materialize(near.groupBy("b").agg(F.min(F.struct("a", "na", "nb")).alias("o")).select("o.a", "b", "o.na", "o.nb"), "first")
    links = verify(first, nodes, texts, percent, n_words, repeats)
    found = components(links, "a", "b")
    apart = near.join(first, ["a", "b"], "left_anti").withColumn("node", F.col("a"))
    apart = _labels(apart, found).withColumnRenamed("component", "ca").withColumn("node", F.col("b"))
    apart = materialize(_labels(apart, found).where("ca <> component").select("a", "b", "na", "nb"), "apart")
    more = verify(apart, nodes, texts, percent, n_words, repeats)
    both = materialize(links.unionByName(more), "links")
    discard(first, links, found, apart, more)

    def compare(pairs: DataFrame) -> DataFrame:
        near = materialize(prune(pairs, nodes, percent), "near")
        found = verify(near, nodes, texts, percent, n_words, repeats)
        discard(near)
        return found

    # A list's hub has met all of it; a salted list's hub has not met the members of the key's other lists.
    members = grouped.where("salt > 0 OR hub <> node").select("key", "node")
    found = link_lists(members, both, near.select("a", "b"), nodes, percent, compare)
    discard(*lists, near)
    of_node = _labels(nodes.select("node", "least"), found)
    smallest = of_node.groupBy("component").agg(F.min("least").alias("o"))
    named = materialize(of_node.join(smallest, "component").select("node", F.col("o.id").alias("component_id"), F.col("o.at").alias("keep_hash")), "named")
    discard(nodes, found)
    joined = ids.where("n > 0").join(named, "node").select("id", "n", "component_id", "keep_hash")
    out = joined.unionByName(ids.where("n = 0").select("id", "n", F.col("id").alias("component_id"), F.col("at").alias("keep_hash")))
    kind = docs.schema[id_col].dataType
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"), "keep_hash")
