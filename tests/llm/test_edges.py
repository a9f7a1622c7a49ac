"""Nulls, empty tables, empty and long texts, ties, repeated rows and clashing column names, for every operator."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import chat_format, exact_dedup, html_main, mixing, ngram_join, packing, para_dedup, token_store, tokenizing, topk, toxicity

DOC = "doc_id long, text string, source string, lang string"
LONG = " ".join(f"word{k}" for k in range(6000))
ROWS = [
    (1, "alpha beta", "s", "en"), (2, "alpha beta", "s", "en"), (3, None, None, None), (4, "", "s", "en"), (5, LONG, "t", "en"), (5, LONG, "t", "en"),
    (None, "alpha beta", "s", "en"), (7, "  \n\t ", "u", "en"), (8, "élan vital <|endoftext|> 漢字 😀", "u", "fr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def clash(df, *names):
    """df with columns named as the operator names its own."""
    return df.withColumns({n: F.lit("x") for n in names})


def test_exact_dedup(docs, none):
    out = exact_dedup.exact_dedup(clash(docs, "keep_id", "kept", "group_size")).collect()
    assert len(out) == len(ROWS)
    by = {}
    for r in out:
        by.setdefault(r["text"] or "", []).append(r)
    assert sorted((r["doc_id"] or -1, r["kept"]) for r in by["alpha beta"]) == [(-1, False), (1, False), (2, True)]
    assert {(r["keep_id"], r["group_size"]) for r in by[""]} == {(4, 2)}
    assert sorted(r["kept"] for r in by[LONG]) == [False, True]
    assert exact_dedup.exact_dedup(none).count() == 0


def test_packing(docs, none):
    out = packing.best_fit_pack(clash(docs, "piece", "slot", "bucket")).toPandas()
    ids = {}
    for key, text, *_ in ROWS:
        ids.setdefault(text or "", len(tokenizing.store(tokenizing.default_tokenizer()).packed(text)) // 4 + 1)
    assert out["length"].sum() == sum(ids[r[1] or ""] for r in ROWS)
    assert out["length"].max() <= 2048
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.concatenate([[0], np.cumsum(g["length"].to_numpy())[:-1]])).all() and g["length"].sum() <= 2048
    assert packing.best_fit_pack(none).count() == 0


def test_packing_search_empties_bins():
    # Best fit in descending order needs four bins here, exchanges three.
    lengths = np.array([6, 5, 4, 4, 3, 3, 2, 3])
    where, offset = packing.pack_lengths(lengths, 10)
    assert (np.bincount(where, lengths) <= 10).all() and len(set(where)) == 3
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]


def test_packing_search_goes_on_while_it_empties_bins():
    lengths = np.random.default_rng(1).integers(500, 900, 1500)
    bins = packing.Bins(lengths, 2048)
    before = len(bins.items)
    bins.search()
    left = [x for x in bins.items if x]
    assert len(left) < before and sorted(i for x in left for i in x) == list(range(1500)) and max(lengths[x].sum() for x in left) <= 2048


def test_tokens_equal_the_library(docs):
    from tokenizers import Tokenizer

    s, plain = tokenizing.store(tokenizing.default_tokenizer()), Tokenizer.from_file(tokenizing.default_tokenizer())
    rng = np.random.default_rng(4)
    pool = ["a", "é", "ß", "1", "²", "_", "'", "'ll", " ", "  ", "\n", "\r\n", "\xa0", " ", "\x1c", ".", ",", "&", "漢", "́", "😀", "<|endoftext|>", "$"]
    for _ in range(3000):
        t = "".join(rng.choice(pool, rng.integers(1, 12)))
        assert s.packed(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert 50256 in np.frombuffer(s.packed("a <|endoftext|> b"), "<u4")
    assert s.packed(None) == s.packed("") == b""


def test_token_store(spark, docs, none, tmp_path):
    token_store.write_shards(clash(docs, "part", "seq"), str(tmp_path / "x"))
    out = token_store.read_documents(spark, str(tmp_path / "x")).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [None, 1, 2, 3, 4, 5, 5, 7, 8]
    assert [r["start"] for r in out] == np.cumsum([0] + [r["n_tokens"] for r in out][:-1]).tolist()
    assert out[3]["n_tokens"] == 1 and out[3]["ids_crc32"] == zlib.crc32((2).to_bytes(4, "little"))
    token_store.write_shards(none, str(tmp_path / "y"))
    assert token_store.read_documents(spark, str(tmp_path / "y")).count() == 0


def test_lookup_over_shards(spark, tmp_path):
    rng = np.random.default_rng(8)
    ids = rng.integers(-(1 << 62), 1 << 62, 3000).tolist() + [77] * 40 + [None, None, (1 << 53) + 1]
    docs = spark.createDataFrame([(k, f"text {n} of {k}") for n, k in enumerate(ids)], "doc_id long, text string").repartition(5)
    path = str(tmp_path / "x")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_store.write_shards(docs, path, shard_ids=500)  # repeated ids go over several shards
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = spark.read.schema(token_store.SHARDS).parquet(path)
    assert shards.select("part").distinct().count() > 1 and shards.count() > 20
    encoder, texts = tokenizing.store(tokenizing.default_tokenizer()), {}
    for n, k in enumerate(ids):
        texts.setdefault(k, []).append([*np.frombuffer(encoder.packed(f"text {n} of {k}"), "<u4").tolist(), 2])
    keys = rng.choice(3000, 1000, replace=False).tolist()
    asked = [ids[k] for k in keys] + rng.integers(-(1 << 62), 1 << 62, 1000).tolist() + [77, 77, None, (1 << 53) + 1, 1 << 62, -(1 << 63) + 1]
    wanted = spark.createDataFrame([(k, 0) for k in asked], "doc_id long, part int")
    got = {}
    for r in token_store.lookup(spark, path, wanted).collect():
        assert r["occurrence"] not in got.setdefault(r["doc_id"], {})
        got[r["doc_id"]][r["occurrence"]] = r["ids"]
    assert set(got) == set(asked) & set(texts)
    assert all(sorted(v) == list(range(len(v))) and sorted(v.values()) == sorted(texts[k]) for k, v in got.items())
    assert token_store.lookup(spark, path, wanted.limit(0)).count() == 0
    token_store.write_shards(docs.limit(0), str(tmp_path / "y"))
    assert token_store.lookup(spark, str(tmp_path / "y"), wanted).count() == 0


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = token_store.key_of(np.arange(5000), np.zeros(5000))
    table = token_store.PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(5000))
    packed = [np.array([k], "<u4").tobytes() for k in range(5000)]
    _, payload, index = token_store.build_shard(list(range(5000)), packed)
    shard = token_store.Shard(payload, index)
    assert shard.get(4321).tolist() == [4321]
    assert shard.get(99999) is None and shard.get(4321, 1) is None


def test_mixing(docs, none):
    out = mixing.pareto_mix(clash(docs, "size", "rank", "target", "w")).collect()
    assert len(out) == len(ROWS)
    assert all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in out)
    again = mixing.pareto_mix(docs).collect()
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.pareto_mix(none).count() == 0


def test_mixing_meets_targets(spark):
    rows = [(k, "w " * (1 + k * 37 % 50), f"s{k % 4}", "en") for k in range(800)]
    out = mixing.pareto_mix(spark.createDataFrame(rows, DOC)).groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.first("source_size").alias("s")).collect()
    assert all(abs(r["k"] - r["t"]) <= 2 for r in out)
    assert sum(r["t"] for r in out) == pytest.approx(sum(r["s"] for r in out))


def test_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), (None, 5)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(mixing.cyclic_weights(sizes, "source"), "source").collect()}
    assert got == {"a": 950.0, "b": 30.0, "c": 30.0, None: 15.0}


def test_ngram_join_edges(docs, none):
    out = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(clash(docs, "node", "band", "key")).collect()}
    assert out == {(1, 1, 1), (2, 1, 1), (None, 1, 1), (3, 0, 3), (4, 0, 4), (7, 0, 7), (5, 5996, 5), (8, 1, 8)}
    assert ngram_join.jaccard_components(none).count() == 0


def test_rows_that_repeat_id_and_text_link_once(spark):
    w = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(5, " ".join(w))] * 3 + [(7, " ".join(w[:57] + ["x"]))] * 2 + [(7, "another text")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect())
    assert got == [(5, 56, 5)] * 3 + [(7, 1, 7)] + [(7, 54, 5)] * 2


def test_rows_without_an_id_keep_their_links(spark):
    w = [f"w{k}" for k in range(60)]
    texts = {5: w, None: w[:50] + ["x1"] + w[51:], 9: w[:50] + ["x1", "x2"] + w[52:57]}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()] + [(11, "alone in here")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()} == {(5, 5), (None, 5), (9, 5), (11, 11)}


@pytest.mark.parametrize("aside", [{}, {1: 0, 2: 1, 3: 4}])
def test_linked_sets_share_a_key(aside):
    rng, plan, none = np.random.default_rng(6), ngram_join.Plan(75, aside), np.zeros(0, np.uint64)
    for _ in range(4000):
        n = int(rng.choice([1, 2, 3, 5, 6, 8, 20, 24, 60, 95, 100, 130, 300]))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        b = a.copy()
        drop, add = rng.integers(0, n // 6 + 2, 2)
        b = np.unique(np.concatenate([rng.permutation(b)[drop:], rng.integers(0, 2**63, add).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
        shared = len(np.intersect1d(a, b))
        if not len(b) or 100 * shared < 75 * (len(a) + len(b) - shared):
            continue
        found = [[plan.keys(x, band, h, none) for band, h in plan.places(len(x))] for x in (a, b)]
        if all(ok for f in found for _, _, ok in f):
            assert np.intersect1d(*(np.concatenate([k for k, _, _ in f]) for f in found)).size
        brief = [ngram_join.sketch(x, ngram_join.BRIEF).view(np.uint64) for x in (a, b)]
        assert np.bitwise_count(brief[0] ^ brief[1]).sum() <= len(a) + len(b) - 2 * shared
        folded = [ngram_join.sketch(x).view(np.uint64) for x in (a, b)]
        small = min(map(len, folded))
        folded = [x if len(x) == small else x[:small] ^ x[small:] for x in folded]
        assert np.bitwise_count(folded[0] ^ folded[1]).sum() <= len(a) + len(b) - 2 * shared


def test_chat_round_trip(spark):
    rows = [
        (1, 1, "assistant", "a </turn> \\<turn> <\\turn> <part:0>"), (1, 0, "user", None), (1, 0, "user", None), (2, None, None, "x\\"), (2, 3, "a\nb>", "</turn>\n<turn>assistant\nno"),
        (None, 0, "assistant", LONG),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"parts": chat_format.text_part(F.col("text")), "formatted": F.lit(1)})
    out = chat_format.format_conversations(turns)
    got = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["t"]], r["l"]) for r in out.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).collect()}
    assert got[1] == ([("user", ""), ("user", ""), ("assistant", rows[0][3])], rows[0][3])
    assert got[2] == ([("", "x\\"), ("a\nb>", rows[4][3])], "")
    assert got[None] == ([("assistant", LONG)], LONG)
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_chat_parts(spark):
    part = "named_struct('type', '{}', 'text', {}, 'ref', {}, 'width', {}, 'height', {}, 'seconds', {}, 'pages', {})"
    parts = [part.format("text", "'see '", "null", "null", "null", "null", "null"), part.format("image", "null", "'i.png'", "28", "15", "null", "null"), part.format("text", "' & '", "null", "null", "null", "null", "null"),
             part.format("audio", "null", "'a.wav'", "null", "null", "2.0D", "null"), part.format("document", "null", "'d.pdf'", "null", "null", "null", "2"), part.format("odd", "null", "null", "null", "null", "null", "null")]
    r = spark.range(1).select(chat_format.flatten_parts(F.expr(f"array({', '.join(parts)})").cast(chat_format.PART_SCHEMA)).alias("f")).first()["f"]
    assert r["body"] == "see <part:0> & <part:1><part:2><part:3>"
    assert [(a["slot"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, "image", "i.png", 4), (1, "audio", "a.wav", 50), (2, "document", "d.pdf", 1152), (3, "odd", None, 0)]
    assert r["expanded_tokens"] == 4 + 50 + 1152


def test_html(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>a</ul></nav><div class='cookie-notice'>We use</div><article><h1>Head &amp; line</h1>"
        "<p>One<br>two <b>bold</b> &lt;x&gt;<p>Second \n  para<aside>side</aside><div class=ad>buy</div><form>f<input></form><section class='comments'><p>nice</p></section></article><footer>f</footer>"
    )
    plain = "<body><p>Shared menu</p><p>Only here {}</p><p>Shared foot</p></body>"
    rows = [(1, "http://h/a/1", page), (2, "http://h/b/1", plain.format(1)), (3, "http://h/b/2", plain.format(2)), (4, None, None), (5, "http://g/", ""), (5, "http://g/", ""), (None, "http://g/<", "<p>a < b</p><script>var t='</p>'</script>")]
    out = html_main.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "packed": F.lit(2), "text": F.lit(3)})).collect()
    got = sorted(((r["page_id"] or -1), r["text"], r["n_chars"]) for r in out)
    assert [g[1] for g in got] == ["a < b", "Head & line\nOne two bold <x>\nSecond para", "Only here 1", "Only here 2", "", "", ""]
    assert all(g[2] == len(g[1]) for g in got)
    assert html_main.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_differencing_decides(spark):
    # Without their neighbours the pages would keep the notice, the foot and the doubtful section.
    page = "<body><p>Notice of the house</p><div class='social-history'><p>{}</p></div><p>Only here {}</p><p>Foot</p></body>"
    inside = "<body><article><p>One {0}</p><div class='social-history'><p>{1}</p></div><p>Quoted</p></article></body>"
    rows = [(1, "http://h/a/1", page.format("Same", 1)), (2, "http://h/a/2", page.format("Same", 2)), (3, "http://h/a/3", page.format("Own", 3)),
            (4, "http://g/a/1", inside.format(1, "Same")), (5, "http://g/a/2", inside.format(2, "Same")), (6, "http://g/b", inside.format(3, "Own")), (7, "http://k/alone", page.format("Same", 7))]
    got = {r["page_id"]: r["text"] for r in html_main.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Only here 1", 2: "Only here 2", 3: "Own\nOnly here 3", 4: "One 1\nQuoted", 5: "One 2\nQuoted", 6: "One 3\nOwn\nQuoted", 7: "Notice of the house\nSame\nOnly here 7\nFoot"}


def test_texts_equal_a_plain_version_whatever_the_ranges(spark):
    # The plain version sorts all pages on the driver.
    rng = np.random.default_rng(2)
    menu = [f"Menu {k}" for k in range(9)]
    rows = []
    for k in range(300):
        body = [*rng.choice(menu, rng.integers(0, 5)), *(f"Line {rng.integers(0, 400)}" for _ in range(rng.integers(0, 6))), *rng.choice(menu, 2)]
        rows.append((int(k % 290) if k % 50 else None, f"http://h{rng.integers(0, 4)}/{rng.choice(list('abc'))}/{rng.integers(0, 40)}", "".join(f"<p>{x}</p>" for x in body)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    marked = pages.select("page_id", "url", "html", F.xxhash64("html").alias("m")).collect()
    host = lambda r: r["url"].split("/")[2]
    ordered = sorted(marked, key=lambda r: (host(r), r["url"].split("/", 3)[3], r["page_id"] is not None, r["page_id"] or 0, r["m"]))
    want = []
    for k, r in enumerate(ordered):
        near = [html_main.lines(ordered[j]["html"]) for j in (k - 1, k + 1) if 0 <= j < len(ordered) and host(ordered[j]) == host(r)]
        want.append((r["page_id"] or -1, r["url"], html_main.main_text(html_main.lines(r["html"]), *near)))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted((r["page_id"] or -1, r["url"], r["text"]) for r in html_main.extract_main_text(pages).collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_very_long_page():
    page = "<nav>menu</nav><article>" + "".join(f"<p>line {k} &amp; more</p>" for k in range(40_000)) + "</article>"
    assert html_main.main_text(html_main.lines(page)).count("\n") == 39_999


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (list(map(str, rng.integers(0, 4, rng.integers(0, 9)))) for _ in range(2))
        found = sorted(html_main.shared_lines(a, b))
        it = iter(b)
        assert all(a[i] in it for i in found) and len(found) == brute_lcs(a, b)


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).astype(float).tolist()) for k in range(300)] + [(300, None), (301, [float("nan")] * 8), (302, [None] * 8), (303, [1.0]), (7, rows7 := [0.5] * 8), (304, rows7)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), block=3).collect()}
    ok = [(i, np.floor(256 * np.array(e + [0.0] * (8 - len(e)))).astype(np.int64)) for i, e in rows if e and all(x is not None and np.isfinite(x) for x in e)]
    for q, x in [o for o in ok if o[0] % 50 == 0]:
        best = sorted(((-int(x @ y), i) for i, y in ok if i != q))[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -s) for s, i in best]
    many = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(v, v.where("vec_id < 300 OR vec_id = 304"), block=7).collect()}
    assert all(many[key] == value for key, value in got.items()) and len(many) == 5 * 301
    assert topk.top_k(v, v.where("vec_id = 301")).count() == 0 and topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_topk_plan_does_not_grow_with_the_queries(spark):
    v = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*(F.rand(k) for k in range(4))).alias("embedding"))
    plans = [topk.top_k(v, v.where("vec_id < 200"), block=b)._jdf.queryExecution().optimizedPlan().toString().count("\n") for b in (100, 2)]
    assert plans[0] == plans[1]


def toxic_rows():
    rng = np.random.default_rng(5)
    clean = ["".join(rng.choice(list("aeiourstln"), rng.integers(2, 8))) for _ in range(300)]
    rows = []
    for k in range(400):
        w = list(rng.choice(clean, rng.integers(5, 120)))
        if y := int(k % 4 == 0):
            for at in rng.integers(0, len(w), 3):
                w[at] = rng.choice(["grobzak", "grobzaks", "vilfump"])
        rows.append((k, " ".join(w), y))
    return rows, clean


def test_toxicity_held_out(spark, none):
    rows, clean = toxic_rows()
    docs = spark.createDataFrame([(k, t, "s", "en") for k, t, _ in rows] + [(900, None, None, None), (901, "", "s", "en"), (902, "grobzakk grobzaky " + " ".join(clean[:20]), "s", "en"), (902, LONG, "s", "en")], DOC)
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(1, None), (None, 1), (5000, 1)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(clash(docs, "score", "predicted"), labels).collect()
    assert len(out) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    truth = {k: y for k, _, y in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    got = {r["doc_id"]: r["score"] for r in out if r["doc_id"] in truth}
    toxic, clean_ = ([got[k] for k, y in truth.items() if y == want] for want in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean_]) >= 0.8
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {r["predicted"] for r in toxicity.score_toxicity(docs.limit(3), labels.where("toxic = 0")).collect()} == {0}


def test_unseen_misspellings_share_the_word_s_vector():
    rows, clean = toxic_rows()
    model = toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    usual = np.median([model.word(w) for w in clean])
    assert model.word("grobzak") > model.word("grobzakk") > usual and model.word("vilfumpp") > usual


def test_passages(spark, docs, none):
    rng = np.random.default_rng(8)
    w = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    passage, line = w(55), w(80)
    near = " ".join(x if k != 40 else "other" for k, x in enumerate(line.split()))
    rows = [(1, f"{w(30)} {passage} {w(40)}"), (2, f"{w(61)} {passage} {w(3)}"), (3, w(200)), (4, f"{w(20)}\n{line}\n{w(9)}"), (5, f"{near}\n{w(50)}"), (6, None), (7, ""), (None, passage)]
    out = para_dedup.repeated_passages(clash(spark.createDataFrame(rows, "doc_id long, text string"), "unit", "run")).collect()
    assert {(r["doc_id"], r["keep_id"]) for r in out} == {(1, 1), (2, 1), (4, 4), (5, 4)}
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) and r["n_words"] >= 35 for r in out)
    spans = {r["doc_id"]: r for r in out}
    assert 30 <= spans[1]["start_word"] <= 38 and spans[1]["start_word"] + spans[1]["n_words"] <= 85
    assert para_dedup.repeated_passages(none).count() == 0


def test_bands_reach_the_recall():
    bands, rows = para_dedup.tune_bands(0.75, 0.97)
    assert 1 - (1 - 0.75**rows) ** bands >= 0.97 > 1 - (1 - 0.75**rows) ** (bands - 1)


@pytest.mark.parametrize("part", [3, 4_096])
def test_every_pair_of_a_bucket_is_compared(spark, monkeypatch, part):
    # Ten pairs of near copies without a common window, all in one bucket, whole or dealt over parts.
    monkeypatch.setattr(ngram_join, "LIST_PART", part)
    real = para_dedup.unit_rows
    monkeypatch.setattr(para_dedup, "unit_rows", lambda *a: real(*a).withColumn("keys", F.when(F.col("keys").isNotNull(), F.array(F.lit(1).cast("long")))))
    rng = np.random.default_rng(9)
    rows = []
    for k in range(10):
        w = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(44)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[:22] + ["other"] + w[23:]))]
    out = para_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["keep_id"]) for r in out} == {(k, k - k % 2) for k in range(20)}


def test_lists_whose_short_hashes_agree_are_both_compared(spark):
    # The two lists have the same sum of 40-bit node hashes.
    members = spark.createDataFrame([(1, 585), (1, 4014), (2, 2346), (2, 3142)], "key long, node long")
    nodes = members.select("node", F.lit(1).alias("n"), F.array(*[F.lit(0).cast("long")] * ngram_join.BRIEF).alias("brief"))
    none = spark.createDataFrame([], "a long, b long")
    found = {r["node"]: r["component"] for r in ngram_join.link_lists(members, none, none, nodes, 75, lambda pairs: pairs).collect()}
    assert found == {585: 585, 4014: 585, 2346: 2346, 3142: 2346}


def test_pages_at_the_ends_of_ranges_have_neighbours(spark):
    rows = [(k, f"http://h/b/{k}", f"<body><p>Shared menu</p><p>Only here {k}</p><p>Shared foot</p></body>") for k in range(24)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    was = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for n in ("40", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {(r["page_id"], r["text"]) for r in html_main.extract_main_text(pages).collect()} == {(k, f"Only here {k}") for k in range(24)}
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
