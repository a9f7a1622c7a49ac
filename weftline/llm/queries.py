"""The registered queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import chat_format, collocations, exact_dedup, html_main, leaderboard, line_runs, mixing, ngram_join, packing, para_dedup, token_store, topk, toxicity
from weftline.runtime import delete, materialize, scratch_dir, table


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

PROBE = "\\### Assistant: </turn> ok"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.expr("array(named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))")).alias("m"))
    rows = rows.unionByName(probe.select("conv_id", "m.turn", "m.role", F.lit(PROBE).alias("text")))
    turns = rows.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts"))
    out = chat_format.format_conversations(turns)
    read = out.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '</turn>', '<\/turn>'), '<part:', '<\part:') AS escaped FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, escaped) AS lines,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, escaped), '') AS loss,
         sum(length(role) + length(escaped) + 15) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.pareto_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM s0
), s2 AS (
  SELECT *, (sum(source_size) OVER () - (sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 3 * source_size))::BIGINT AS rest,
         (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS ws
  FROM s1 WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST)
), s3 AS (
  SELECT *, 3 * source_size * ws <= w * rest AS is_full FROM s2
), s4 AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE
    CAST(w * (sum(source_size) OVER () - sum(CASE WHEN is_full THEN 3 * source_size ELSE 0 END) OVER ())::BIGINT AS DOUBLE) / (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::BIGINT END AS target
  FROM s3
), r0 AS (
  SELECT d.*, s4.source_size, s4.target, CASE WHEN s4.source_size > 0 THEN least(3.0::DOUBLE, target / s4.source_size) ELSE 0::DOUBLE END AS e,
         (('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source
), r1 AS (
  SELECT *, floor(e)::BIGINT AS copies, CASE WHEN size > 0 AND e - floor(e) > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q FROM r0
), r2 AS (
  SELECT *, floor(q / (1 + q) * 68719476736.0::DOUBLE)::BIGINT AS rank FROM r1
), r3 AS (
  SELECT *, target - (sum(copies * size) OVER (PARTITION BY source))::BIGINT AS gap0,
         sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM r2
), r4 AS (
  SELECT *, coalesce(min(CASE WHEN rank IS NOT NULL AND upto > gap0 THEN rank END) OVER (PARTITION BY source), 68719476736) AS low FROM r3
), f0 AS (
  SELECT *, gap0 - (sum(CASE WHEN rank < low THEN size ELSE 0 END) OVER (PARTITION BY source))::BIGINT AS gap, rank < low AS hit FROM r4
), f1 AS (
  SELECT *, max(CASE WHEN NOT hit AND size <= gap THEN {'s': size, 'r': -rank} END) OVER (PARTITION BY source) AS b1 FROM f0
), f2 AS (
  SELECT * REPLACE (hit OR (b1 IS NOT NULL AND rank = -b1.r) AS hit, gap - coalesce(b1.s, 0) AS gap) FROM f1
), f3 AS (
  SELECT *, max(CASE WHEN NOT hit AND size <= gap THEN {'s': size, 'r': -rank} END) OVER (PARTITION BY source) AS b2 FROM f2
), f4 AS (
  SELECT * REPLACE (hit OR (b2 IS NOT NULL AND rank = -b2.r) AS hit, gap - coalesce(b2.s, 0) AS gap) FROM f3
), f5 AS (
  SELECT *, max(CASE WHEN NOT hit AND size <= gap THEN {'s': size, 'r': -rank} END) OVER (PARTITION BY source) AS b3 FROM f4
), f6 AS (
  SELECT * REPLACE (hit OR (b3 IS NOT NULL AND rank = -b3.r) AS hit) FROM f5
)
SELECT doc_id, size, source_size, target, size * (copies + coalesce(hit, FALSE)::BIGINT) AS taken FROM f6
"""


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/weftline-shards-{uuid.uuid4().hex}"
    token_store.write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    read = materialize(token_store.read_documents(spark, path), "stored")  # four narrow columns a document
    delete(spark, path)
    return read


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return para_dedup.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT * FROM r WHERE rank <= 5
"""



def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda n: list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])))) AS g FROM w
), c AS (
  SELECT lang, g, count(*)::HUGEINT AS f FROM g GROUP BY lang, g
), n AS (
  SELECT lang, sum(f)::HUGEINT AS n FROM c WHERE len(g) = 1 GROUP BY lang
), k AS (
  SELECT lang, g, f FROM c WHERE len(g) > 1 AND f >= 100
), inside AS (
  SELECT DISTINCT lang, part FROM (
    SELECT lang, f, unnest(flatten(list_transform(range(2, len(g)), lambda m: list_transform(range(1, len(g) - m + 2), lambda i: g[i:i + m - 1])))) AS part FROM k
  ) x JOIN (SELECT lang, g AS part, f AS a FROM k) y USING (lang, part) WHERE 100 * x.f >= 100 * y.a
), cuts AS (
  SELECT k.lang, k.g, k.f AS a, unnest(range(1, len(k.g))) AS cut FROM k ANTI JOIN inside ON k.lang = inside.lang AND k.g = inside.part
), s AS (
  SELECT cuts.lang, cuts.g, a, l.f AS l, r.f AS r, n.n, (1000 * a * n.n) // (l.f * r.f) AS score, cut
  FROM cuts JOIN n ON n.lang = cuts.lang JOIN c l ON l.lang = cuts.lang AND l.g = cuts.g[1:cut] JOIN c r ON r.lang = cuts.lang AND r.g = cuts.g[cut + 1:]
), b AS (
  SELECT *, array_to_string(g, ' ') AS phrase FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""


def op12_leaderboard_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.change_feed(*(table(spark, sf_dir, name) for name in ("sale_lines", "items", "vendors")))


OP12_SQL = """
WITH t AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
), k AS (
  SELECT *, concat_ws(',', coalesce(sale_id::VARCHAR, ''), coalesce(item_id::VARCHAR, ''), coalesce(vendor_id::VARCHAR, ''), coalesce(line_no::VARCHAR, '')) AS key FROM sale_lines
), h AS (
  SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)), lambda a, b: xor(a >> 8, t.t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM k, t
), s AS (
  SELECT *, coalesce(CAST(shipped_at AS DATE) - DATE '1970-01-01', 19723 + h % 150)::BIGINT AS s FROM h
), a AS (
  SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM s
), b AS (
  SELECT *, least(10, 1 + (a - 19723) * 10 // 180)::INTEGER AS batch FROM a
), m AS (
  SELECT batch, max(max(s)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM b GROUP BY batch
), c AS (
  SELECT nation_id, item_id, a, sum(CASE WHEN flag = 'swapped' THEN -1 ELSE 1 END * coalesce(floor(100 * amount + 0.5), quantity * floor(100 * price + 0.5), 0)) AS cents
  FROM b JOIN m USING (batch) JOIN vendors USING (vendor_id) JOIN items USING (item_id)
  WHERE nation_id IS NOT NULL AND s + 3 >= coalesce(newest, s) GROUP BY nation_id, item_id, a
), d AS (
  SELECT a, lead(a) OVER (ORDER BY a) AS next FROM (SELECT DISTINCT a FROM c)
), r AS (
  SELECT nation_id, item_id, a AS since, sum(cents) OVER w AS revenue, lead(a) OVER w AS until FROM c WINDOW w AS (PARTITION BY nation_id, item_id ORDER BY a)
), e AS (
  SELECT nation_id, item_id, d.a, d.next, revenue, CASE WHEN revenue > 0 THEN row_number() OVER (PARTITION BY nation_id, d.a ORDER BY revenue DESC, item_id) END AS rank
  FROM r JOIN d ON d.a >= since AND (until IS NULL OR d.a < until)
), f AS (
  SELECT * REPLACE (CASE WHEN rank <= 10 THEN rank END AS rank) FROM e
), p AS (
  SELECT f.nation_id, f.item_id, f.a, f.revenue, o.rank AS old_rank, f.rank AS new_rank FROM f LEFT JOIN f o ON o.nation_id = f.nation_id AND o.item_id = f.item_id AND o.next = f.a
)
SELECT nation_id, a AS arrival_day, item_id, least(10, 1 + (a - 19723) * 10 // 180)::INTEGER AS batch, CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change,
       old_rank::INTEGER AS old_rank, new_rank::INTEGER AS new_rank, revenue::BIGINT AS revenue
FROM p WHERE old_rank IS DISTINCT FROM new_rank
"""


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, row_number() OVER () AS r FROM documents
), x AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key
), m AS (
  SELECT k.*, coalesce(f.first < k.doc_id, FALSE) AS gone FROM k LEFT JOIN f USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, sum(gone::BIGINT)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_html_main_text": op2_html_main_text,
    "op3_ngram_join": op3_ngram_join,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_token_store": op6_token_store,
    "op7_toxicity": op7_toxicity,
    "op8_passage_dedup": op8_passage_dedup,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_exact_topk": op10_exact_topk,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_leaderboard_feed": op12_leaderboard_feed,
    "op13_line_dedup": op13_line_dedup,
}

ORACLE_SQL = {
    "op4_exact_dedup": OP4_SQL,
    "op5_source_mixing": OP5_SQL,
    "op9_chat_formatting": OP9_SQL,
    "op10_exact_topk": OP10_SQL,
    "op11_phrase_collocations": OP11_SQL,
    "op12_leaderboard_feed": OP12_SQL,
    "op13_line_dedup": OP13_SQL,
}
