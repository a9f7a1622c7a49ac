"""q61 to q79: ranking metrics, early stopping, logs, features, similarity matrices, histograms, encoding, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import seq, textfmt
from weftline.operators import augment, ml, quality, similarity
from weftline.queries.base import SQL_ARRAYS, SQL_ELEMENTS, arrays, joined
from weftline.queries.registry import query
from weftline.runtime import table

R9 = "round_even({0}, 9)"


def _r(c: str) -> Column:
    return seq.round_half_even(F.col(c), 9).alias(c)


SCORED = "sc AS (SELECT doc_id, lang, quality AS y, n_chars // 200 AS score, CAST(n_chars > 1500 AS INTEGER) AS yhat FROM documents JOIN labels USING (doc_id))"


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select("doc_id", "lang", F.col("quality").alias("y"), F.expr("n_chars div 200").alias("score"), (F.col("n_chars") > 1500).cast("int").alias("yhat"))


def _ranked_sql(by: str) -> str:
    part, key = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH {SCORED}, st AS (SELECT {key}score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS q FROM sc GROUP BY {key}score),
w AS (SELECT *, sum(q) OVER ({part}ORDER BY score) - q AS below, sum(p) OVER ({part}ORDER BY score DESC) AS tp, sum(q) OVER ({part}ORDER BY score DESC) AS fp FROM st)
SELECT {key}(sum(p) + sum(q))::BIGINT AS n, sum(p)::BIGINT AS positives, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN round_even(sum(p * (below + q / 2.0::DOUBLE)) / (sum(p) * sum(q)), 9) END AS auc,
CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN round_even(sum(p * tp::DOUBLE / (tp + fp)) / sum(p), 9) END AS average_precision FROM w {group}"""


@query(_ranked_sql(""))
def q61_auc_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return quality.ranking_metrics(_scored(spark, sf), "y", "score").select("n", "positives", _r("auc"), _r("average_precision"))


def _prf_sql(by: str) -> str:
    tp, fp, fn = (f"count(*) FILTER (WHERE y = {a} AND yhat = {b})::DOUBLE" for a, b in ((1, 1), (0, 1), (1, 0)))
    n, pos = "count(*)::DOUBLE", "count(*) FILTER (WHERE y = 1)::DOUBLE"
    key = f"{by}, " if by else ""
    return f"""WITH {SCORED} SELECT {key}count(*) AS n, count(*) FILTER (WHERE y = yhat) / {n} AS accuracy, coalesce({tp} / nullif({tp} + {fp}, 0), 0) AS precision, coalesce({tp} / nullif({tp} + {fn}, 0), 0) AS recall,
coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0) AS f1, {pos} / {n} AS positive_rate, ({tp} + {fp}) / {n} AS predicted_rate, greatest({pos}, {n} - {pos}) / {n} AS majority FROM sc {'GROUP BY ' + by if by else ''}"""


@query(_prf_sql(""))
def q62_threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.threshold_metrics(_scored(spark, sf), "y", "yhat")


@query(_ranked_sql("lang"))
def q63_ranking_per_stratum(spark: SparkSession, sf: str) -> DataFrame:
    return quality.ranking_metrics(_scored(spark, sf), "y", "score", ["lang"]).select("lang", "n", "positives", _r("auc"), _r("average_precision"))


@query(_prf_sql("lang"))
def q63b_threshold_per_stratum(spark: SparkSession, sf: str) -> DataFrame:
    return quality.threshold_metrics(_scored(spark, sf), "y", "yhat", ["lang"])


@query(f"WITH {SCORED}, c AS (SELECT y, yhat, count(*) AS n FROM sc GROUP BY 1, 2) SELECT y, yhat, n, n / (sum(n) OVER (PARTITION BY y))::DOUBLE AS row_share, n / (sum(n) OVER ())::DOUBLE AS share FROM c")
def q64_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return quality.confusion(_scored(spark, sf), "y", "yhat")


LOSSES = "lo AS (SELECT event_type AS run, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS epoch, (sum(CAST(round_even(value * 100, 0) AS BIGINT)) // count(*))::DOUBLE AS loss FROM events GROUP BY 1, 2)"


def _losses(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.rint(F.col("value") * 100).cast("long")
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("run"), F.unix_date(F.to_date("ts")).cast("long").alias("epoch")).agg(F.sum(cents).alias("s"), F.count(F.lit(1)).alias("k")).select("run", "epoch", F.expr("s div k").cast("double").alias("loss"))


@query(f"""WITH {LOSSES}, a AS (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(loss) OVER (PARTITION BY run ORDER BY epoch) AS best FROM lo),
i AS (SELECT *, coalesce(loss < b, TRUE) AS improved FROM a), w AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS waited FROM i)
SELECT run, epoch, loss, best, improved, waited, coalesce(epoch >= min(CASE WHEN waited >= 3 THEN epoch END) OVER (PARTITION BY run), FALSE) AS stopped FROM w""")
def q65_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    return quality.early_stop(_losses(spark, sf), "run", "epoch", "loss", 3)


@query(f"""WITH RECURSIVE {LOSSES}, n AS (SELECT run, loss, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM lo),
f AS (SELECT DISTINCT run, 0::BIGINT AS i, 'inf'::DOUBLE AS best, 0 AS bad, 0.001::DOUBLE AS rate FROM lo
UNION ALL SELECT f.run, n.i, CASE WHEN loss < best * (1 - 1e-4::DOUBLE) THEN loss ELSE best END, CASE WHEN loss < best * (1 - 1e-4::DOUBLE) OR bad = 3 THEN 0 ELSE bad + 1 END,
CASE WHEN bad = 3 AND NOT loss < best * (1 - 1e-4::DOUBLE) THEN greatest(rate * 0.5, 1e-6::DOUBLE) ELSE rate END FROM f JOIN n ON n.run = f.run AND n.i = f.i + 1)
SELECT run, arg_max(rate, i) AS final_rate FROM f GROUP BY run""")
def q65b_plateau_rate(spark: SparkSession, sf: str) -> DataFrame:
    return quality.plateau_rates(_losses(spark, sf), "run", "epoch", "loss", 1e-3)


RUNS = "ru AS (SELECT event_type AS name, count(*) AS n, count(*) FILTER (WHERE value > 50) AS hi, count(DISTINCT user_id) AS users FROM events GROUP BY 1)"


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("hi"), F.count_distinct("user_id").alias("users"))
    text = F.format_string(
        "=== %s ===\nSplit sizes: train=%d, val=%d, test=%d\nLabel distribution test={0: %d, 1: %d}\nepoch=%d loss=1 (STOP)\ntest_loss=0.5 test_accuracy=0.%d auc=0.75 aupr=0.5 precision=0.25 recall=1.0 f1=0.%d\nPer-cas_subtype test metrics:\ncas_subtype            n  accuracy       auc      aupr precision    recall        f1\nI-E              %7d    0.5000    0.7500    0.6250    0.5000    0.1250    0.2500\nV-A                    4    1.0000       nan       nan    1.0000    1.0000    0.5000\n",
        "name", "n", "hi", "users", F.col("n") - F.col("hi"), "hi", F.col("n") % 50, F.col("n") % 9 + 1, F.col("hi") % 9 + 1, "users",
    )
    return e.select("name", text.alias("text"))


@query(f"""WITH {RUNS} SELECT name, name AS label, n AS n_train, hi AS n_val, users AS n_test, n - hi AS test_0, hi AS test_1, 0.5::DOUBLE AS test_loss, ('0.' || (n % 9 + 1))::DOUBLE AS test_accuracy, 0.75::DOUBLE AS auc, 0.5::DOUBLE AS aupr,
0.25::DOUBLE AS precision, 1.0::DOUBLE AS recall, ('0.' || (hi % 9 + 1))::DOUBLE AS f1, n % 50 AS stop_epoch FROM ru""")
def q66_log_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _logs(spark, sf).select("name", *[v.alias(k) for k, v in textfmt.log_fields(F.col("text")).items()])


@query(f"WITH {RUNS} SELECT name, 'I-E' AS stratum, users AS n, 0.5::DOUBLE AS accuracy, 0.75::DOUBLE AS auc, 0.625::DOUBLE AS aupr, 0.5::DOUBLE AS precision, 0.125::DOUBLE AS recall, 0.25::DOUBLE AS f1 FROM ru UNION ALL SELECT name, 'V-A', 4, 1.0, 'nan'::DOUBLE, 'nan'::DOUBLE, 1.0, 1.0, 0.5 FROM ru")
def q66b_log_strata(spark: SparkSession, sf: str) -> DataFrame:
    return textfmt.stratum_rows(_logs(spark, sf))


@query(f"WITH {RUNS}, x AS (SELECT name, ('0.' || (n % 9 + 1))::DOUBLE AS test_accuracy, 0.5::DOUBLE AS test_loss FROM ru) SELECT 'test_accuracy' AS metric, arg_min(name, (-test_accuracy, name)) AS run, max(test_accuracy) AS value FROM x UNION ALL SELECT 'test_loss', min(name), 0.5 FROM x")
def q67_best_runs(spark: SparkSession, sf: str) -> DataFrame:
    fields = textfmt.log_fields(F.col("text"))
    runs = _logs(spark, sf).select("name", fields["test_accuracy"].alias("test_accuracy"), fields["test_loss"].alias("test_loss"))
    return quality.best_runs(runs, "name", "name", ["test_accuracy"], ["test_loss"])


@query(f"WITH {RUNS} SELECT stratum, max(n) AS most FROM (SELECT 'I-E' AS stratum, users AS n FROM ru UNION ALL SELECT 'V-A', 4 FROM ru) GROUP BY 1 HAVING max(n) >= 5")
def q67b_reliable_strata(spark: SparkSession, sf: str) -> DataFrame:
    return quality.reliable_strata(textfmt.stratum_rows(_logs(spark, sf)), "stratum", "n")


_RUN_SCORES = f"{SCORED}, rs AS (SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE y = yhat) / count(*)::DOUBLE AS accuracy, coalesce(2 * count(*) FILTER (WHERE y = 1 AND yhat = 1) / nullif((2 * count(*) FILTER (WHERE y = 1 AND yhat = 1) + count(*) FILTER (WHERE y <> yhat))::DOUBLE, 0), 0) AS f1 FROM sc JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY 1, 2)"


@query(f"""WITH {_RUN_SCORES}, b AS (SELECT source, max(n) AS most, arg_max(lang, (f1, -ord_)) AS best_f1, arg_max(lang, (accuracy, -ord_)) AS best_accuracy FROM (SELECT *, dense_rank() OVER (ORDER BY lang) AS ord_ FROM rs) GROUP BY 1 HAVING max(n) >= 5)
SELECT source, most AS n, lang AS run, round_even(f1, 9) AS f1, round_even(accuracy, 9) AS accuracy, lang = best_f1 AS is_best_f1, lang = best_accuracy AS is_best_accuracy FROM rs JOIN b USING (source)""")
def q67c_compare_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Languages as runs and sources as strata: maps of run to metric in each stratum, an entry a row here."""
    rows = _scored(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    scores = quality.threshold_metrics(rows, "y", "yhat", ["lang", "source"])
    out = quality.compare_runs(scores, "lang", "lang", "source", "n", ["f1", "accuracy"])
    out = out.select("source", "n", "accuracy", "best_f1", "best_accuracy", F.explode("f1").alias("run", "v"))
    nine = lambda c, name: seq.round_half_even(c, 9).alias(name)
    return out.select("source", "n", "run", nine(F.col("v"), "f1"), nine(F.col("accuracy")[F.col("run")], "accuracy"), (F.col("run") == F.col("best_f1")).alias("is_best_f1"), (F.col("run") == F.col("best_accuracy")).alias("is_best_accuracy"))


@query("SELECT n_name AS stratum, (row_number() OVER (ORDER BY n_name) - 1) // 4 AS page, (row_number() OVER (ORDER BY n_name) - 1) % 4 AS place FROM (SELECT DISTINCT n_name FROM customer JOIN nation ON n_nationkey = c_nationkey)")
def q67d_strata_pages(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return quality.pages(c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("stratum")), "stratum")


@query("""WITH na AS (SELECT l_orderkey AS id, list(upper(p_name) ORDER BY l_linenumber, l_partkey) AS e FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
l AS (SELECT id, e, len(e)::BIGINT AS n, list_sum(list_transform(e, lambda x: length(x)))::BIGINT AS total, array_to_string(e, '') AS t FROM na),
m AS (SELECT *, total / n::DOUBLE AS mean_len FROM l)
SELECT id, n, total, round_even(mean_len, 9) AS mean_len, round_even(sqrt(list_sum(list_transform(e, lambda x: (length(x) - mean_len) * (length(x) - mean_len))) / n), 9) AS std_len,
round_even(length(regexp_replace(t, '[^GC]', '', 'g')) / length(t)::DOUBLE, 9) AS gc FROM m""")
def q68_array_features(spark: SparkSession, sf: str) -> DataFrame:
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    rows = li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", F.upper("p_name").alias("name")))).alias("s"))
    rows = rows.select("id", F.transform("s", lambda x: x["name"]).alias("e"))
    return rows.select("id", *[v.alias(k) for k, v in ml.array_features(F.col("e")).items()]).select("id", "n", "total", _r("mean_len"), _r("std_len"), _r("gc"))


@query(f"""WITH {SCORED}, s AS (SELECT 'score' AS feature, score::DOUBLE AS v, y FROM sc)
SELECT feature, min(v) AS min, max(v) AS max, round_even(avg(v), 6) AS mean, round_even(stddev_pop(v), 6) AS std, round_even(abs(avg(v) FILTER (WHERE y = 1) - avg(v) FILTER (WHERE y = 0)), 6) AS difference FROM s GROUP BY 1""")
def q69_class_difference(spark: SparkSession, sf: str) -> DataFrame:
    out = ml.class_statistics(_scored(spark, sf), "y", ["score"])
    six = lambda c: seq.round_half_even(F.col(c), 6).alias(c)
    return out.select("feature", "min", "max", six("mean"), six("std"), six("difference"))


_SETS = "st AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS element FROM lineitem)"


def _matrix_sql(group: str) -> str:
    return f"""WITH {_SETS}, sz AS (SELECT id, count(*) AS n FROM st GROUP BY id), gr AS (SELECT o_orderkey AS id, {group} AS g FROM orders WHERE o_orderkey IN (SELECT id FROM st)),
pr AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM st x JOIN st y ON x.element = y.element AND x.id < y.id GROUP BY 1, 2),
s AS (SELECT least(p.g, q.g) AS group_a, greatest(p.g, q.g) AS group_b, sum(k::DOUBLE / (u.n + v.n - k)) AS s FROM pr JOIN sz u ON u.id = a JOIN sz v ON v.id = b JOIN gr p ON p.id = a JOIN gr q ON q.id = b GROUP BY 1, 2),
n AS (SELECT g, count(*) AS n FROM gr GROUP BY 1)
SELECT x.g AS group_a, y.g AS group_b, CASE WHEN x.g = y.g THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END AS n_pairs, round_even(coalesce(s, 0) / nullif(CASE WHEN x.g = y.g THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END, 0), 9) AS mean_similarity
FROM n x JOIN n y ON x.g <= y.g LEFT JOIN s ON s.group_a = x.g AND s.group_b = y.g"""


def _matrix(spark: SparkSession, sf: str, group: Column) -> DataFrame:
    sets = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("element")).distinct()
    groups = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), group.alias("g")).join(sets.select("id").distinct(), "id", "left_semi")
    return similarity.mean_similarity(sets, groups, "g").select("group_a", "group_b", "n_pairs", _r("mean_similarity"))


@query(_matrix_sql("CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'val' ELSE 'test' END"))
def q70_split_similarity_matrix(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 10
    return _matrix(spark, sf, F.when(k < 7, "train").when(k < 8, "val").otherwise("test"))


@query(_matrix_sql("o_orderpriority || '|' || (o_orderkey % 2)"))
def q71_similarity_per_stratum(spark: SparkSession, sf: str) -> DataFrame:
    return _matrix(spark, sf, F.concat_ws("|", "o_orderpriority", (F.col("o_orderkey") % 2).cast("string")))


@query("""
WITH st AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS e FROM lineitem), m AS (SELECT o_orderpriority AS g, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS at FROM orders),
n AS (SELECT g, count(*) AS n FROM m GROUP BY 1), c AS (SELECT x.g AS group_a, y.g AS group_b, y.n AS nb, CASE WHEN x.g = y.g THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END AS p FROM n x JOIN n y ON x.g <= y.g),
d AS (SELECT *, unnest(range(least(2000, p))) AS s, least(2000, p) AS c FROM c WHERE p > 0),
r AS (SELECT *, s * p // c + ('0x' || substr(md5('37|' || group_a || '|' || group_b || '|' || s), 1, 15))::BIGINT % ((s + 1) * p // c - s * p // c) AS r FROM d),
u AS (SELECT *, floor((1 + sqrt(8 * r::DOUBLE + 1)) / 2)::BIGINT AS tj FROM r),
v AS (SELECT group_a, group_b, p, CASE WHEN group_a = group_b THEN r - tj * (tj - 1) // 2 ELSE r // nb END AS i, CASE WHEN group_a = group_b THEN tj ELSE r % nb END AS j FROM u),
w AS (SELECT row_number() OVER () AS q, v.group_a, v.group_b, v.p, a.id AS a, b.id AS b FROM v JOIN m a ON a.g = v.group_a AND a.at = v.i JOIN m b ON b.g = v.group_b AND b.at = v.j),
k AS (SELECT q, count(*) AS k FROM w JOIN st x ON x.id = w.a JOIN st y ON y.id = w.b AND y.e = x.e GROUP BY 1), z AS (SELECT id, count(*) AS n FROM st GROUP BY 1)
SELECT group_a, group_b, p AS n_pairs, count(*) AS sampled, round_even(avg(coalesce(coalesce(k, 0)::DOUBLE / nullif(coalesce(za.n, 0) + coalesce(zb.n, 0) - coalesce(k, 0), 0), 0)), 9) AS mean_similarity
FROM w LEFT JOIN k USING (q) LEFT JOIN z za ON za.id = w.a LEFT JOIN z zb ON zb.id = w.b GROUP BY 1, 2, 3
""")
def q70b_sampled_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Mean similarity of 2,000 pairs at most of every two priorities."""
    sets = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("element")).distinct()
    groups = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("g"))
    return similarity.sampled_similarity(sets, groups, "g", 2000, 37).select("group_a", "group_b", "n_pairs", "sampled", _r("mean_similarity"))


@query("WITH s AS (SELECT l_orderkey, count(*) AS size FROM lineitem GROUP BY 1) SELECT o_orderpriority AS stratum, size, count(*) AS n FROM s JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2")
def q72_size_histogram(spark: SparkSession, sf: str) -> DataFrame:
    s, o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("size")), table(spark, sf, "orders")
    return ml.histogram(s.join(o, s["l_orderkey"] == o["o_orderkey"]).select(F.col("o_orderpriority").alias("stratum"), "size"), "size", ["stratum"])


@query("""WITH v AS (SELECT p_size AS v FROM part), e AS (SELECT min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi, least(30, greatest(5, count(DISTINCT v))) AS bins FROM v),
b AS (SELECT CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / bins)), bins - 1) END::BIGINT AS bin, lo, (hi - lo) / bins AS w FROM v, e) SELECT bin, any_value(lo) + bin * any_value(w) AS low, count(*) AS n FROM b GROUP BY bin""")
def q72b_binned_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return ml.binned(table(spark, sf, "part"), "p_size")


CHARS = "ch AS (SELECT p_partkey AS key, i - 1 AS pos, upper(p_name)[i] AS token FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part)), vo AS (SELECT token, row_number() OVER (ORDER BY min((key, pos))) + 7 AS id FROM ch WHERE token NOT IN ('A', 'C', 'G', 'T', 'N') GROUP BY token UNION ALL SELECT DISTINCT token, list_position(['PAD', 'CLS', 'SEP', 'A', 'C', 'G', 'T', 'N'], token) - 1 FROM ch WHERE token IN ('A', 'C', 'G', 'T', 'N'))"


def _chars(spark: SparkSession, sf: str) -> DataFrame:
    return ml.characters(table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_name"), "key", "p_name")


@query(f"WITH {CHARS} SELECT * FROM vo")
def q73_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return ml.vocabulary(_chars(spark, sf), "token", ["key", "pos"])


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    chars = _chars(spark, sf)
    return ml.encode(chars, ml.vocabulary(chars, "token", ["key", "pos"]), "key")


@query(f"WITH {CHARS} SELECT key, string_agg(id::VARCHAR, ',' ORDER BY pos) AS ids, count(*) AS n FROM ch JOIN vo USING (token) GROUP BY key")
def q74_encode(spark: SparkSession, sf: str) -> DataFrame:
    return _encoded(spark, sf).select("key", joined(F.col("ids")).alias("ids"), "n")


@query(f"""WITH {CHARS}, e AS (SELECT key, list(id ORDER BY pos)[1:12] AS ids FROM ch JOIN vo USING (token) GROUP BY key), b AS (SELECT key, ids, p_brand, max(len(ids)) OVER (PARTITION BY p_brand) AS w FROM e JOIN part ON p_partkey = key)
SELECT key, array_to_string(list_concat(ids, list_transform(range(0, w - len(ids)), lambda x: 0)), ',') AS padded, array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(0, w - len(ids)), lambda x: 0)), ',') AS mask FROM b""")
def q75_collate(spark: SparkSession, sf: str) -> DataFrame:
    brand = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_brand")
    out = ml.collate(_encoded(spark, sf).join(brand, "key"), "p_brand", most=12)
    return out.select("key", joined(F.col("padded")).alias("padded"), joined(F.col("mask")).alias("mask"))


_CODES = "list_transform(string_split({0}, ''), lambda c: list_position(['A', 'C', 'G', 'T'], c) + 2)"
_CODE = "translate({0}::VARCHAR, '0123456789', 'ACGTACGTAC')"
_PAD = "list_concat({0}, list_transform(range(0, {1} - len({0})), lambda z: 0))"
_ROWS = "array_to_string(list_transform(list_concat({0}, list_transform(range(0, n - len({0})), lambda z: []::BIGINT[])), lambda x: array_to_string(list_concat(x, list_transform(range(0, {1} - len(x)), lambda z: 0)), ',')), '|')"


@query(f"""WITH {SQL_ARRAYS}, e AS (SELECT id, o_custkey AS b, list_transform(elements, lambda x: {_CODES.format(_CODE.format('x'))}) AS e, list_transform(list_concat(elements, [7]), lambda x: {_CODES.format(_CODE.format('(x * 11)'))}) AS r,
CASE WHEN id % 3 = 0 THEN []::BIGINT[] ELSE {_CODES.format(_CODE.format('id'))} END AS f FROM ar JOIN orders ON o_orderkey = id),
w AS (SELECT *, max(len(e)) OVER p AS n, max(list_max(list_transform(e, lambda x: len(x)))) OVER p AS we, max(list_max(list_transform(r, lambda x: len(x)))) OVER p AS wr, max(len(f)) OVER p AS wf FROM e WINDOW p AS (PARTITION BY b)),
c AS (SELECT * REPLACE (r[1:n] AS r) FROM w)
SELECT id, {_ROWS.format('e', 'we')} AS elements, array_to_string(list_concat(list_transform(e, lambda x: 1), list_transform(range(0, n - len(e)), lambda z: 0)), ',') AS mask, {_ROWS.format('r', 'wr')} AS repeats, array_to_string({_PAD.format('f', 'wf')}, ',') AS left_flank,
array_to_string(list_transform(e, lambda x: len(x)), ',') AS lengths FROM c""")
def q75b_collate_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as examples, a batch a customer, padded on both axes; one repeat more than elements, so the longest order's last one is cut."""
    letters = lambda x: F.translate(x.cast("string"), "0123456789", "ACGTACGTAC")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("b"))
    repeats = F.transform(F.concat("elements", F.array(F.lit(7).cast("long"))), lambda x: letters(x * 11))
    coded = ml.encode_example(F.transform("elements", letters), repeats, F.when(F.col("id") % 3 != 0, letters(F.col("id"))))
    out = ml.collate_examples(arrays(spark, sf).join(o, "id").select("id", "b", *[c.alias(k) for k, c in coded.items()]), "b")
    lists = lambda c: F.array_join(F.transform(c, joined), "|")
    return out.select("id", lists("element_tokens").alias("elements"), joined(F.col("element_mask")).alias("mask"), lists("repeat_tokens").alias("repeats"), joined(F.col("left_tokens")).alias("left_flank"), joined(F.col("element_lengths")).alias("lengths"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), h AS (SELECT vec_id, e, e[1:32] AS a, e[33:64] AS b FROM e)
SELECT vec_id, round_even(list_sum(list_transform(range(1, 33), lambda i: (a[i] + b[i]) / 2)), 6) AS mean_pool, round_even(list_sum(list_transform(range(1, 33), lambda i: greatest(a[i], b[i]))), 6) AS max_pool FROM h""")
def q76_pooling(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    halves = F.array(F.slice(v, 1, 32), F.slice(v, 33, 32))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    six = lambda c, n: seq.round_half_even(c, 6).alias(n)
    rows = table(spark, sf, "embeddings").select("vec_id", halves.alias("h"))
    return rows.select("vec_id", six(total(ml.pool(F.col("h"), "mean")), "mean_pool"), six(total(ml.pool(F.col("h"), "max")), "max_pool"))


@query("""WITH h AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), w AS (SELECT *, list_transform([e[1], e[17], e[33], e[49]], lambda x: exp(x)) AS u FROM h)
SELECT vec_id, round_even(list_sum(list_transform(range(1, 17), lambda i: i * (u[1] * e[i] + u[2] * e[16 + i] + u[3] * e[32 + i] + u[4] * e[48 + i]) / list_sum(u))), 6) AS attention_pool FROM w""")
def q76b_attention_pooling(spark: SparkSession, sf: str) -> DataFrame:
    """Four vectors of sixteen summed by the softmax of their first components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", F.array(*[F.slice(v, 16 * k + 1, 16) for k in range(4)]).alias("h"))
    pooled = ml.pool(F.col("h"), "attention", F.transform("h", lambda x: F.get(x, F.lit(0))))
    total = F.aggregate(F.transform(pooled, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return rows.select("vec_id", seq.round_half_even(total, 6).alias("attention_pool"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
SELECT vec_id, round_even(list_sum(list_transform(range(0, 64), lambda i: (i + 1) * CASE WHEN i % 2 = 0 THEN e[i + 1] * cos(vec_id % 100 * pow(10000.0::DOUBLE, -2.0 * (i // 2) / 64)) - e[i + 2] * sin(vec_id % 100 * pow(10000.0::DOUBLE, -2.0 * (i // 2) / 64))
ELSE e[i] * sin(vec_id % 100 * pow(10000.0::DOUBLE, -2.0 * (i // 2) / 64)) + e[i + 1] * cos(vec_id % 100 * pow(10000.0::DOUBLE, -2.0 * (i // 2) / 64)) END)), 5) AS rotated,
round_even(0.25::DOUBLE * (vec_id % 64 - vec_id % 7) / 63, 9) AS bias FROM e""")
def q77_rotary_alibi(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", v.alias("v"))
    turned = F.transform(ml.rotate(F.col("v"), F.col("vec_id") % 100), lambda x, i: x * (i + 1))
    bias = ml.alibi_bias(F.col("vec_id") % 7, F.col("vec_id") % 64, F.size("v"), ml.alibi_slopes(4)[0])
    return rows.select("vec_id", seq.round_half_even(F.aggregate(turned, F.lit(0.0), lambda a, b: a + b), 5).alias("rotated"), seq.round_half_even(bias, 9).alias("bias"))


@query(f"""WITH {SQL_ARRAYS}, s AS (SELECT id, len(elements) AS n, unnest(range(1, (1 << len(elements))::BIGINT)) AS mask FROM ar WHERE len(elements) > 2),
f AS (SELECT id, CASE WHEN id % 3 = 0 THEN 0.5::DOUBLE ELSE (n - bit_count(mask))::DOUBLE / n END AS fraction FROM s WHERE bit_count(mask) BETWEEN 2 AND n - 1)
SELECT o_orderpriority AS stratum, count(*) AS n, round_even(avg(fraction), 9) AS mean_fraction FROM f JOIN orders ON o_orderkey = id GROUP BY 1""")
def q78_deletion_fraction(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("stratum"))
    # Arrays are joined, not their subsets: these only pass through an aggregation of a few strata and are never shuffled or sorted.
    rows = augment.enumerate_subsets(arrays(spark, sf).join(o, "id"), 2)
    stated = F.when(F.col("id") % 3 == 0, 0.5).otherwise(0.0)
    fraction = seq.deletion_fraction(stated, F.size("elements") - F.size("subset"), F.size("elements"))
    out = rows.select("stratum", fraction.alias("f")).groupBy("stratum").agg(F.count("f").alias("n"), F.avg("f").alias("mean_fraction"))
    return out.select("stratum", "n", _r("mean_fraction"))


@query()
def q79_logistic_features(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality")
    rows = d.join(lab, "doc_id").select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") / 1000.0).alias("thousands"), seq.gc_fraction(F.upper("text")).alias("gc"), F.size(F.split("text", "\n")).cast("double").alias("lines"))
    return ml.logistic_cv(rows, "doc_id", "y", ["thousands", "gc", "lines"])


@query(f"WITH {SQL_ELEMENTS}, s AS (SELECT id, count(*) AS n, sum(length(element::VARCHAR))::BIGINT AS bp FROM el GROUP BY id) SELECT min(n) AS n_min, max(n) AS n_max, avg(n) AS n_mean, min(bp) AS bp_min, max(bp) AS bp_max, avg(bp) AS bp_mean FROM s")
def q80_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    from weftline.operators.stats import describe

    rows = arrays(spark, sf).select(F.size("elements").cast("long").alias("n"), seq.total_length(F.transform("elements", lambda x: x.cast("string"))).alias("bp"))
    return rows.agg(*describe(F.col("n"), "n"), *describe(F.col("bp"), "bp"))


