"""q47 to q60: splits, folds, leak checks, subsets, guards, balancing and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import augment, augmenter, cluster, split
from weftline.queries.base import SQL_ARRAYS, arrays, joined
from weftline.queries.registry import query
from weftline.runtime import table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("signature"), "lang", "source")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").withColumn("label", F.coalesce("quality", F.lit(0)))


DOCS = "dd AS (SELECT doc_id, md5(text) AS signature, lang, source, coalesce(quality, 0) AS label FROM documents LEFT JOIN labels USING (doc_id))"


def _units(unit: str, stratum: str | None) -> str:
    if stratum is None:
        return f"un AS (SELECT DISTINCT {unit} AS unit, 'all' AS stratum FROM dd)"
    return f"mo AS (SELECT {unit} AS unit, {stratum} AS s, count(*) AS k FROM dd GROUP BY 1, 2), un AS (SELECT unit, arg_min(s, (-k, s)) AS stratum FROM mo GROUP BY 1)"


def _cut_sql(unit: str, stratum: str | None, parts: list[tuple[str, str, float]], rest: str, seed: int, made: str | None = None, order: str = "unit") -> str:
    rule = {"plain": "{r}", "floor1": "greatest(1, {r})", "keep1": "CASE WHEN n <= 1 THEN 0 ELSE least(n - 1, greatest(1, {r})) END"}
    end, cases = "0", []
    for name, kind, share in parts:
        end = f"least(n, {end} + {rule[kind].format(r=f'CAST(round_even(n * {share}::DOUBLE, 0) AS BIGINT)')})"
        cases.append(f"WHEN r <= {end} THEN '{name}'")
    return f"""WITH {DOCS}, {made or _units(unit, stratum)}, ra AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY md5('{seed}|' || unit::VARCHAR), unit) AS r FROM un)
SELECT unit AS {unit}, stratum, CASE {' '.join(cases)} ELSE '{rest}' END AS split FROM ra"""


@query(_cut_sql("source", None, [("train", "floor1", 0.7), ("val", "floor1", 0.15)], "test", 1))
def q47_split_groups(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_groups(_docs(spark, sf), "source", 1)


@query(_cut_sql("signature", "lang", [("test", "keep1", 0.2)], "dev", 2))
def q48_stratified_holdout(spark: SparkSession, sf: str) -> DataFrame:
    return split.stratified_holdout(_docs(spark, sf), "signature", "lang", 0.2, 2)


@query(_cut_sql("signature", "lang", [("train", "floor1", 0.8), ("test", "plain", 0.1)], "val", 3))
def q49_three_way_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.stratified_three_way(_docs(spark, sf), "signature", "lang", 3)


@query(_cut_sql("signature", "source", [("test", "keep1", 0.2)], "train", 4))
def q49b_train_test_by_stratum(spark: SparkSession, sf: str) -> DataFrame:
    return split.train_test_by_stratum(_docs(spark, sf), "signature", "source", 4)


@query("""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'g' || (doc_id // 7) ELSE ' ' END AS g, md5(text) AS signature, coalesce(nullif(trim(lang), ''), 'Unknown') AS lang FROM documents),
e AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY g) AS b FROM d WHERE trim(g) <> '' UNION ALL SELECT doc_id, min(doc_id) OVER (PARTITION BY signature) FROM d WHERE signature IS NOT NULL),
x AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c AS (SELECT doc_id AS n, doc_id AS r FROM d UNION SELECT x.b, c.r FROM c JOIN x ON x.a = c.n),
k AS (SELECT n AS doc_id, min(r) AS component FROM c GROUP BY n), m AS (SELECT component, lang, count(*) AS n FROM k JOIN d USING (doc_id) GROUP BY 1, 2),
u AS (SELECT component, arg_min(lang, (-n, lang)) AS stratum FROM m GROUP BY 1),
o AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY md5('31|' || component), component) AS r FROM u)
SELECT doc_id, component, stratum, CASE WHEN n <= 1 OR r <= least(n - 1, greatest(1, round_even(n * 0.8, 0))) THEN 'train_test' ELSE 'val' END AS split FROM k JOIN o USING (component)
""")
def q49c_dev_of_components(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    g = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("g"), F.expr("doc_id div 7").cast("string"))).otherwise(" ")
    rows = d.select("doc_id", g.alias("g"), F.md5("text").alias("signature"), "lang")
    return split.dev_of_components(rows, "doc_id", "g", ["signature"], "lang", 31)


@query(_cut_sql("signature", "label", [("test", "floor1", 0.2)], "train", 5))
def q50_split_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return split.train_test_by_label(_docs(spark, sf), "signature", "label", 5)


@query(_cut_sql("doc_id", None, [("test", "keep1", 0.2)], "train", 6, "un AS (SELECT doc_id AS unit, lang || '|' || label AS stratum FROM dd)"))
def q51_split_by_label_and_stratum(spark: SparkSession, sf: str) -> DataFrame:
    return split.by_label_and_stratum(_docs(spark, sf), "doc_id", "lang", "label", 6)


@query(_cut_sql("signature", "lang", [("train", "keep1", 0.8)], "val", 7))
def q51b_dev_pool(spark: SparkSession, sf: str) -> DataFrame:
    return split.dev_pool(_docs(spark, sf), "signature", "lang", "stratum", 7)


@query(f"""WITH {DOCS}, {_units('signature', 'lang')} SELECT unit AS signature, stratum, fold, CASE WHEN fold = 2 THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, CAST((row_number() OVER (PARTITION BY stratum ORDER BY md5('8|' || unit), unit) - 1) % 5 AS BIGINT) AS fold FROM un)""")
def q52_folds(spark: SparkSession, sf: str) -> DataFrame:
    return split.use_fold(split.folds(_docs(spark, sf), "signature", "lang", 5, 8), 2)


_LEAKY = _cut_sql("doc_id", None, [("test", "keep1", 0.2)], "train", 6, "un AS (SELECT doc_id AS unit, lang || '|' || label AS stratum FROM dd)")


@query(f"SELECT md5(text) AS signature, count(DISTINCT split) AS splits FROM ({_LEAKY}) JOIN documents USING (doc_id) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def q53_signature_leaks(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    return split.leaks(split.by_label_and_stratum(docs, "doc_id", "lang", "label", 6).join(docs.select("doc_id", "signature"), "doc_id"), "signature", "split")


COMPONENTS = """WITH RECURSIVE gd AS (SELECT doc_id, source || '|' || lang || '|' || (doc_id // 20) AS g, md5(text) AS s FROM documents),
e AS (SELECT g.doc_id AS a, m.h AS b FROM gd g JOIN (SELECT g, min(doc_id) AS h FROM gd GROUP BY 1) m USING (g) UNION SELECT g.doc_id, m.h FROM gd g JOIN (SELECT s, min(doc_id) AS h FROM gd GROUP BY 1) m USING (s)),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c AS (SELECT doc_id AS n, doc_id AS r FROM gd UNION SELECT b.b, c.r FROM c JOIN b ON b.a = c.n)
SELECT n AS doc_id, min(r) AS component FROM c GROUP BY n"""


@query(COMPONENTS)
def q54_group_or_signature_components(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    g = F.concat_ws("|", "source", "lang", F.expr("doc_id div 20").cast("string"))
    return cluster.group_or_signature_components(d.select("doc_id", g.alias("g"), F.md5("text").alias("signature")), "doc_id", "g", ["signature"])


@query(f"""WITH {SQL_ARRAYS}, s AS (SELECT id, elements, unnest(range(1, (1 << len(elements))::BIGINT)) AS mask FROM ar WHERE len(elements) > 2)
SELECT id, mask, array_to_string(list_filter(elements, lambda x, i: (mask >> (i - 1)) & 1 = 1), ',') AS subset FROM s WHERE bit_count(mask) BETWEEN 2 AND len(elements) - 1""")
def q55_subset_enumerate(spark: SparkSession, sf: str) -> DataFrame:
    out = augment.enumerate_subsets(arrays(spark, sf), 2)
    return out.select("id", "mask", joined(F.col("subset")).alias("subset"))


RANDOM = f"""WITH {SQL_ARRAYS}, a AS (SELECT id, elements, attempt FROM ar, (SELECT unnest([0, 1, 2]) AS attempt) WHERE len(elements) > 2),
z AS (SELECT *, CAST(('0x' || substr(md5('11|' || id || '|' || attempt), 1, 15))::BIGINT % (len(elements) - 2) + 2 AS INTEGER) AS size FROM a),
p AS (SELECT *, list_slice(list_sort(list_transform(range(0, len(elements)), lambda i: md5('11|' || id || '|' || attempt || '|' || i) || '#' || i)), 1, size) AS picked FROM z)
SELECT id, attempt, size, array_to_string(list_filter(elements, lambda x, i: list_contains(list_transform(picked, lambda q: split_part(q, '#', 2)::INTEGER), (i - 1)::INTEGER)), ',') AS subset FROM p"""


@query(RANDOM)
def q56_subset_random(spark: SparkSession, sf: str) -> DataFrame:
    out = augment.random_subsets(arrays(spark, sf), 2, 3, 11)
    return out.select("id", "attempt", "size", joined(F.col("subset")).alias("subset"))


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    """id, spacers and repeats: parts modulo 60 as the one, modulo 7 as the other list."""
    named = lambda m: F.transform("elements", lambda x: (x % m).cast("string"))
    return arrays(spark, sf).select("id", named(60).alias("spacers"), named(7).alias("repeats"))


@query(f"""WITH {SQL_ARRAYS}, ex AS (SELECT id, list_transform(elements, lambda x: (x % 60)::VARCHAR) AS sp, list_transform(elements, lambda x: (x % 7)::VARCHAR) AS rp FROM ar),
tk AS (SELECT DISTINCT id, unnest(list_concat(list_transform(sp, lambda x: 'S:' || x), list_transform(rp, lambda x: 'R:' || x))) AS t FROM ex), nn AS (SELECT id, count(*) AS n FROM tk GROUP BY 1),
pa AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM tk x JOIN tk y ON x.t = y.t AND x.id % 10 <> 0 AND y.id % 10 = 0 GROUP BY 1, 2),
ds AS (SELECT a, min(1 - k::DOUBLE / (p.n + q.n - k)) AS d FROM pa JOIN nn p ON p.id = a JOIN nn q ON q.id = b GROUP BY a),
ct AS (SELECT DISTINCT a FROM pa JOIN ex x ON x.id = a JOIN ex y ON y.id = b WHERE
  (len(list_filter(range(1, greatest(len(y.sp) - len(x.sp), -1) + 2), lambda i: y.sp[i:i + len(x.sp) - 1] = x.sp AND y.rp[i:i + len(x.sp) - 1] = x.rp)) > 0)
  OR (len(list_filter(range(1, greatest(len(x.sp) - len(y.sp), -1) + 2), lambda i: x.sp[i:i + len(y.sp) - 1] = y.sp AND x.rp[i:i + len(y.sp) - 1] = y.rp)) > 0))
SELECT id FROM ex LEFT JOIN ds ON a = id WHERE id % 10 <> 0 AND coalesce(d, 1) >= 0.6 AND id NOT IN (SELECT a FROM ct)""")
def q57_guarded_candidates(spark: SparkSession, sf: str) -> DataFrame:
    ex = _examples(spark, sf)
    return augment.guarded(ex.where("id % 10 <> 0"), ex.where("id % 10 = 0"), 0.6).select("id")


@query()
def q57b_bulk_subsets(spark: SparkSession, sf: str) -> DataFrame:
    ex = _examples(spark, sf)
    out = augment.bulk_subsets(ex.where("id % 10 <> 0"), ex.where("id % 10 = 0"), 2, 2, 13, 0.3)
    return out.select("id", "source_id", F.array_join("spacers", ",").alias("spacers"), F.array_join("repeats", ",").alias("repeats"))


@query()
def q57c_retry_subsets(spark: SparkSession, sf: str) -> DataFrame:
    ex = _examples(spark, sf)
    out = augmenter.retry_subsets(ex.where("id % 10 <> 0"), ex.where("id % 10 = 0"), 13, 0.9, 3, 0.3)
    return out.withColumns({c: F.array_join(c, ",") for c in ("spacers", "repeats")})


@query()
def q57d_bulk_counters(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every subset tried, for each training array: two of each, far apart, past the guard."""
    ex = _examples(spark, sf)
    return augmenter.bulk(ex.where("id % 10 <> 0"), ex, ex.where("id % 10 = 0"), per_array=2, seed=13, least_distance=0.3).counters


@query()
def q57e_augmented_set(spark: SparkSession, sf: str) -> DataFrame:
    """A training set with random subsets, then the reverse complements of all of it."""
    ex = _examples(spark, sf)
    out = augmenter.augmented(ex.where("id % 10 <> 0"), ex.where("id % 10 = 0"), "after", 0.3, mode="random", per_array=1, prob=0.5, seed=13)
    return out.withColumns({c: F.array_join(c, ",") for c in ("spacers", "repeats")})


@query("SELECT lang, count(*) AS n, greatest(0, 400 - count(*)) AS need FROM documents GROUP BY 1")
def q58_balance_need(spark: SparkSession, sf: str) -> DataFrame:
    return augment.need(table(spark, sf, "documents"), "lang", 400)


@query("""WITH h AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('17|' || doc_id), doc_id) AS r FROM documents WHERE doc_id % 2 = 1)
SELECT doc_id, lang FROM s LEFT JOIN h USING (lang) WHERE r <= 120 - coalesce(n, 0)""")
def q58b_balance(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return augment.balance(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "lang", "doc_id", 120, 17)


@query("WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, least(10.0::DOUBLE, pow(max(n) OVER () / n, 1.0::DOUBLE)) AS raw FROM c) SELECT lang, n, round_even(raw * sum(n) OVER () / sum(raw * n) OVER (), 9) AS weight FROM r")
def q59_inverse_weights(spark: SparkSession, sf: str) -> DataFrame:
    from weftline.functions.seq import round_half_even

    out = augment.inverse_weights(table(spark, sf, "documents"), "lang")
    return out.select("lang", "n", round_half_even(F.col("weight"), 9).alias("weight"))


@query("""WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, least(10.0::DOUBLE, pow(max(n) OVER () / n, 1.0::DOUBLE)) AS raw FROM c),
w AS (SELECT lang, raw * sum(n) OVER () / sum(raw * n) OVER () AS weight FROM r), k AS (SELECT doc_id, CAST(round(weight * 1000000) AS BIGINT) AS w FROM documents JOIN w USING (lang)),
l AS (SELECT doc_id, sum(w) OVER (ORDER BY doc_id) - w AS lo, sum(w) OVER (ORDER BY doc_id) AS hi FROM k),
d AS (SELECT i AS draw, ('0x' || substr(md5('19|' || i), 1, 15))::BIGINT % (SELECT max(hi) FROM l)::BIGINT AS place FROM range(500) t(i))
SELECT draw, doc_id FROM d JOIN l ON place >= lo AND place < hi""")
def q59b_weighted_sample(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang")
    weights = augment.inverse_weights(d, "lang").select("lang", "weight")
    return augment.weighted_sample(d.join(weights, "lang"), "doc_id", "weight", 500, 19)


@query()
def q60_diverse_select(spark: SparkSession, sf: str) -> DataFrame:
    drawn = augment.random_subsets(arrays(spark, sf), 2, 8, 23)
    rows = drawn.select(F.col("id").alias("source_id"), F.concat_ws("#", F.col("id").cast("string"), F.col("attempt").cast("string")).alias("id"), F.col("subset").alias("elements"))
    return augment.diverse(rows, "source_id", 3)


@query("""WITH na AS (SELECT l_orderkey AS id, list(p_name ORDER BY l_linenumber, l_partkey) AS names FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT id, array_to_string(list_transform(list_reverse(names), lambda x: reverse(translate(x, 'ACGTacgtNn', 'TGCAtgcaNn'))), '|') AS spacers, CAST(1 - id % 2 AS INTEGER) AS label, CASE id % 2 WHEN 1 THEN 'Reverse' ELSE 'Forward' END AS evor_direction FROM na""")
def q60b_reverse_complement_examples(spark: SparkSession, sf: str) -> DataFrame:
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    lists = li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))).alias("e"))
    label = (F.col("id") % 2).cast("int")
    rows = lists.select(
        "id", F.transform("e", lambda x: x["p_name"]).alias("spacers"), F.array().cast("array<string>").alias("repeats"), label.alias("label"),
        F.when(label == 1, "Forward").otherwise("Reverse").alias("evor_direction"), F.lit("").alias("left_flank"), F.lit("").alias("right_flank"),
    )
    return augment.reverse_complement_examples(rows).select("id", F.array_join("spacers", "|").alias("spacers"), "label", "evor_direction")
