"""Registered queries on the driver's smallest tables, against SQL or brute force; the pipeline's stages."""

import collections

import duckdb
import pytest

from tests.oracle import DATA, connect, rows_of, rows_of_sql
from weftline.llm.queries import ORACLE_SQL, QUERIES

DOCUMENTS = f"SELECT doc_id, text FROM '{DATA}/documents.parquet'"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    cols, want = rows_of_sql(connect(), ORACLE_SQL[name])
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == cols and rows_of(got) == want


def brute_components(docs):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    label = list(range(len(docs)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {d: (len(sets[k]), docs[root(k)][0]) for k, (d, _) in enumerate(docs)}


def test_ngram_join_equals_all_pairs(spark):
    docs = duckdb.sql(DOCUMENTS + " ORDER BY doc_id").fetchall()
    assert {r[0]: (r[1], r[2]) for r in QUERIES["op3_ngram_join"](spark, DATA).collect()} == brute_components(docs)


def library_ids(end):
    import numpy as np
    from tokenizers import Tokenizer

    from weftline.llm import tokenizing

    plain = Tokenizer.from_file(tokenizing.default_tokenizer())
    docs = duckdb.sql(DOCUMENTS + " ORDER BY doc_id").fetchall()
    return {d: np.array([*plain.encode(t or "", add_special_tokens=False).ids, end], "<u4") for d, t in docs}


def test_packing_equals_the_library(spark):
    import zlib

    out = QUERIES["op1_best_fit_packing"](spark, DATA).toPandas()
    ids = library_ids(0)
    assert set(out["doc_id"]) == set(ids)
    for d, g in out.sort_values("piece").groupby("doc_id"):
        at = 0
        assert g["piece"].tolist() == list(range(len(g)))
        for r in g.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[d][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[d]) and (len(g) == 1 or at > 2048 and set(g["length"][1:]) <= {2048})
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1].tolist()] and g["length"].sum() <= 2048
    least = -(-int(out["length"].sum()) // 2048)
    assert least <= out["sequence_id"].nunique() <= least + 1


def test_token_store_equals_the_library(spark):
    import zlib

    ids, start = library_ids(2), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op6_token_store"](spark, DATA).collect()}
    for d in sorted(ids):
        assert got.pop(d) == (start, len(ids[d]), zlib.crc32(ids[d].tobytes()))
        start += len(ids[d])
    assert not got


def test_main_text_is_the_article(spark):
    # Every page of the table has an article element; its text by the standard library's parser.
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.depth, self.skip, self.blocks, self.now = 0, 0, [], ""

        def cut(self):
            if self.depth and self.now.split():
                self.blocks.append(" ".join(self.now.split()))
            self.now = ""

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")
            if tag in ("article", "p", "h1", "h2", "h3", "li", "ul", "ol", "div", "blockquote", "pre", "table", "tr", "td"):
                self.cut()
            self.now += " " if tag == "br" else ""
            self.depth += tag == "article"

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")
            if tag in ("article", "p", "h1", "h2", "h3", "li", "ul", "ol", "div", "blockquote", "pre", "table", "tr", "td"):
                self.cut()
            self.depth -= tag == "article"

        def handle_data(self, data):
            self.now += "" if self.skip else data

    got = {r["page_id"]: r["text"] for r in QUERIES["op2_html_main_text"](spark, DATA).collect()}
    for k, page in duckdb.sql(f"SELECT page_id, html FROM '{DATA}/pages.parquet'").fetchall():
        parser = Article()
        parser.feed(page or "")
        assert got[k] == "\n".join(parser.blocks)


def test_passages_of_over_fifty_words_are_found(spark):
    seen = collections.defaultdict(set)
    for d, t in duckdb.sql(DOCUMENTS).fetchall():
        w = (t or "").encode().lower().split()
        for k in range(len(w) - 50):
            seen[tuple(w[k : k + 51])].add(d)
    want = set().union(*(v for v in seen.values() if len(v) > 1))
    got = {r["doc_id"] for r in QUERIES["op8_passage_dedup"](spark, DATA).collect()}
    assert want <= got


def plain_toxicity(spark, docs):
    from weftline.llm import toxicity

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(*toxicity.training_rows(frame, labels, "doc_id", "text", "toxic"))
    weights = toxicity._Weights(model)
    return [(d, t) for d, t in docs if model.score(model.logit(toxicity.words(t), weights)) < 0.5]


def test_pipeline_stages(spark):
    """Each stage's rows against a plain version of it on the same input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)

    def run(name, docs):
        kept = stages[name](spark, docs, DATA)
        assert kept.columns == columns
        return spark.createDataFrame(kept.toPandas(), kept.schema)

    plain = lambda docs: sorted((r["doc_id"], r["text"]) for r in docs.collect())
    before, docs = plain(docs), run("toxicity", docs)
    assert plain(docs) == sorted(plain_toxicity(spark, before))
    before, docs = plain(docs), run("exact_dedup", docs)
    assert plain(docs) == sorted((d, t) for t, d in {t: d for d, t in before}.items())
    before, docs = plain(docs), run("ngram_join", docs)
    assert plain(docs) == sorted((d, t) for d, t in before if brute_components(before)[d][1] == d)
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    copies = c.sql(f"SELECT doc_id, taken // size FROM ({ORACLE_SQL['op5_source_mixing']}) WHERE taken > 0").fetchall()
    before, docs = dict(plain(docs)), run("source_mixing", docs)
    assert plain(docs) == sorted((d, before[d]) for d, n in copies for _ in range(n))
    ids, packed = library_ids(0), stages["best_fit_packing"](spark, docs, DATA).toPandas()
    n_of = collections.Counter(d for d, _ in plain(docs))
    assert packed.groupby("doc_id")["length"].sum().to_dict() == {d: n * len(ids[d]) for d, n in n_of.items()}
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048 and not packed.duplicated(["sequence_id", "offset"]).any()


LONG = " ".join(f"w{k}" for k in range(3000))
N = len(LONG)


@pytest.fixture(scope="module")
def odd(spark):
    long = LONG
    rows = [(1, "alpha beta gamma delta", "s"), (1, "alpha beta gamma delta", "s"), (2, None, None), (None, "", "s"), (None, long, None), (4, long + " x", "t"), (4, "one two three four five six", "s"), (5, "one", "t")]
    return spark.createDataFrame([(*r, "mine", 0.5, 7) for r in rows], "doc_id long, text string, source string, predicted string, score double, size int")


@pytest.mark.parametrize("name", ["toxicity", "exact_dedup", "ngram_join", "source_mixing", "best_fit_packing"])
def test_pipeline_stage_edges(spark, odd, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    out, nothing = stage(spark, odd, DATA), stage(spark, odd.limit(0), DATA)
    assert nothing.count() == 0
    if name == "best_fit_packing":
        assert out.select("doc_id").distinct().count() == 5
        return
    assert out.columns == odd.columns == nothing.columns
    rows = [(r["doc_id"], len(r["text"] or "")) for r in out.collect()]
    assert {(r["predicted"], r["score"], r["size"]) for r in out.collect()} == {("mine", 0.5, 7)}
    if name == "toxicity":
        assert len(rows) == 8
    elif name == "exact_dedup":
        assert sorted(rows, key=str) == sorted([(1, 22), (2, 0), (None, N), (4, N + 2), (4, 27), (5, 3)], key=str)
    elif name == "ngram_join":  # the long texts are near copies, the one with an id stays; both rows of id 1 are one text
        assert (None, N) not in rows and (4, N + 2) in rows and (4, 27) in rows and len(rows) == 7
    else:
        assert all(n for _, n in rows)
