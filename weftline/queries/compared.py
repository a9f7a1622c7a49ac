"""q30 to q45: two tools' calls compared, clusterings compared, duplicates collapsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import compare
from weftline.operators.index import first_per_key
from weftline.queries.registry import query
from weftline.runtime import table

CALLS = """
ca AS (SELECT o_orderkey AS name, CASE o_orderstatus WHEN 'F' THEN 'Forward' WHEN 'O' THEN 'Reverse' ELSE 'Unknown' END AS call_a FROM orders WHERE o_orderkey % 7 <> 0),
fl AS (SELECT l_orderkey, l_returnflag, count(*) AS k FROM lineitem GROUP BY 1, 2),
md AS (SELECT l_orderkey AS name, arg_max(l_returnflag, (k, -ascii(l_returnflag))) AS flag FROM fl GROUP BY 1),
cb AS (SELECT name, CASE flag WHEN 'R' THEN 'Forward' WHEN 'A' THEN 'Reverse' ELSE 'Unknown' END AS call_b,
  CASE o_custkey % 10 WHEN 0 THEN 'singleton' WHEN 1 THEN NULL ELSE 'g' || (o_custkey % 50) END AS group_name FROM md JOIN orders ON o_orderkey = name WHERE name % 5 <> 0),
an AS (SELECT o_orderkey AS name, c_mktsegment AS segment, n_name AS nation FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
oj AS (SELECT coalesce(ca.name, cb.name) AS name, coalesce(call_a, 'Unknown') AS call_a, coalesce(call_b, 'Unknown') AS call_b, group_name FROM ca FULL JOIN cb ON ca.name = cb.name),
dt AS (SELECT oj.*, CASE WHEN call_a = 'Unknown' OR call_b = 'Unknown' THEN 'not_comparable' WHEN call_a = call_b THEN 'agree' ELSE 'disagree' END AS agreement, segment, nation FROM oj LEFT JOIN an USING (name))"""


def _a(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("name"), F.when(status == "F", "Forward").when(status == "O", "Reverse").otherwise("Unknown").alias("call_a"))


def _b(spark: SparkSession, sf: str) -> DataFrame:
    flags = table(spark, sf, "lineitem").where("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("name")).agg(compare.modal("l_returnflag").alias("flag"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), "o_custkey")
    k = F.col("o_custkey") % 10
    group = F.when(k == 0, "singleton").when(k != 1, F.concat(F.lit("g"), (F.col("o_custkey") % 50).cast("string")))
    return flags.join(o, "name").select("name", F.when(F.col("flag") == "R", "Forward").when(F.col("flag") == "A", "Reverse").otherwise("Unknown").alias("call_b"), group.alias("group_name"))


def _detail(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    notes = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("o_orderkey").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))
    return compare.outer_calls(_a(spark, sf), _b(spark, sf), "name", "call_a", "call_b", ["group_name"], notes)


@query(f"WITH {CALLS} SELECT * FROM dt")
def q30_outer_compare(spark: SparkSession, sf: str) -> DataFrame:
    return _detail(spark, sf)


def _pct(a: str, b: str) -> str:
    return f"round_even(100.0::DOUBLE * ({a}) / nullif({b}, 0), 2)"


def _stats_sql(by: str = "", where: str = "TRUE", prefix: str = "") -> str:
    count = lambda c: f"count(*) FILTER (WHERE ({where}) AND {c})"
    A, B = "call_a <> 'Unknown'", "call_b <> 'Unknown'"
    n, comp, agree = count("TRUE"), count(f"{A} AND {B}"), count(f"{A} AND {B} AND call_a = call_b")
    a_only, b_only = count(f"{A} AND NOT {B}"), count(f"NOT {A} AND {B}")
    cols = {
        "total": n, "comparable": comp, "agree": agree, "disagree": count(f"{A} AND {B} AND call_a <> call_b"), "a_only": a_only, "b_only": b_only, "neither": count(f"NOT {A} AND NOT {B}"),
        "n_skipped": f"{n} - {comp}", "pct_disagree": _pct(f"{comp} - {agree}", comp), "pct_full_agree": _pct(count("call_a = call_b"), n),
        "pct_agree": _pct(agree, comp), "pct_effective": _pct(agree, n), "pct_coverage": _pct(comp, n), "pct_asymmetric": _pct(f"{a_only} + {b_only}", n),
        "pct_a_only": _pct(a_only, n), "pct_b_only": _pct(b_only, n), "pct_a_called": _pct(count(A), n), "pct_b_called": _pct(count(B), n),
    }
    keys = f"{by}, " if by else ""
    return f"SELECT {keys}{', '.join(f'{v} AS {prefix}{k}' for k, v in cols.items())} FROM dt" + (f" GROUP BY {by}" if by else "")


@query(f"WITH {CALLS} {_stats_sql()}")
def q31_pair_stats(spark: SparkSession, sf: str) -> DataFrame:
    return compare.pair_stats(_detail(spark, sf), "call_a", "call_b")


SINGLE = "group_name IS DISTINCT FROM 'singleton'"


@query(f"WITH {CALLS} {_stats_sql(where=SINGLE)}")
def q31b_pair_stats_no_singletons(spark: SparkSession, sf: str) -> DataFrame:
    return compare.pair_stats(_detail(spark, sf), "call_a", "call_b", where=compare.not_singleton("group_name"))


@query(f"""WITH {CALLS} SELECT count(*) AS total, count(*) FILTER (WHERE call_a <> 'Unknown') AS n_a, count(*) FILTER (WHERE call_b <> 'Unknown') AS n_b,
count(*) FILTER (WHERE call_a <> 'Unknown' AND call_b <> 'Unknown') AS n_both, count(*) FILTER (WHERE call_a <> 'Unknown' OR call_b <> 'Unknown') AS n_either, {_pct("count(*) FILTER (WHERE call_a <> 'Unknown')", 'count(*)')} AS a_pct, {_pct("count(*) FILTER (WHERE call_b <> 'Unknown')", 'count(*)')} AS b_pct,
{_pct("count(*) FILTER (WHERE call_a <> 'Unknown' AND call_b <> 'Unknown')", 'count(*)')} AS both_pct, {_pct("count(*) FILTER (WHERE call_a <> 'Unknown' OR call_b <> 'Unknown')", 'count(*)')} AS either_pct FROM dt""")
def q32_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return compare.confidence(_detail(spark, sf), "call_a", "call_b")


@query(f"""WITH {CALLS}, f AS (SELECT group_name, arg_min(call_b, name) AS call FROM cb WHERE group_name IS NOT NULL AND group_name <> 'singleton' GROUP BY 1)
SELECT count(*) AS groups, count(*) FILTER (WHERE call <> 'Unknown') AS confident, {_pct("count(*) FILTER (WHERE call <> 'Unknown')", 'count(*)')} AS confident_pct FROM f""")
def q33_group_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return compare.group_confidence(_b(spark, sf), "group_name", "call_b", ["name"])


@query(f"WITH {CALLS} SELECT call_a, coalesce(call_b, 'Unknown') AS call_b, count(*) AS n FROM dt GROUP BY 1, 2")
def q34_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return compare.crosstab(_detail(spark, sf), "call_a", "call_b")


@query(f"""WITH {CALLS} SELECT segment, count(*) FILTER (WHERE call_b = 'Forward') AS "Forward", count(*) FILTER (WHERE call_b = 'Reverse') AS "Reverse", count(*) FILTER (WHERE call_b = 'Unknown') AS "Unknown"
FROM (SELECT coalesce(segment, 'Unknown') AS segment, call_b FROM dt) GROUP BY 1""")
def q34b_crosstab_wide(spark: SparkSession, sf: str) -> DataFrame:
    return compare.crosstab_wide(_detail(spark, sf), "segment", "call_b", ["Forward", "Reverse", "Unknown"])


@query(f"WITH {CALLS}, x AS ({_stats_sql('segment')}), y AS ({_stats_sql('segment', SINGLE, 'ns_')}) SELECT * FROM x JOIN y USING (segment)")
def q35_strata_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Both regimes from one read of the joined rows, which AQE's exchange reuse shares."""
    rows = _detail(spark, sf)
    return compare.pair_stats(rows, "call_a", "call_b", ["segment"]).join(compare.pair_stats(rows, "call_a", "call_b", ["segment"], compare.not_singleton("group_name"), "ns_"), "segment")


@query(f"WITH {CALLS}, x AS ({_stats_sql('nation')}), m AS (SELECT nation, segment, count(*) AS k FROM dt GROUP BY 1, 2), o AS (SELECT nation, arg_min(segment, (-k, segment)) AS modal_segment FROM m GROUP BY 1) SELECT * FROM x JOIN o USING (nation)")
def q36_substrata_modal(spark: SparkSession, sf: str) -> DataFrame:
    rows = _detail(spark, sf)
    return compare.pair_stats(rows, "call_a", "call_b", ["nation"]).join(rows.groupBy("nation").agg(compare.modal("segment").alias("modal_segment")), "nation")


@query(f"WITH {CALLS}, x AS ({_stats_sql('nation')}) SELECT count(*) AS strata, round_even(avg(pct_agree), 2) AS macro_pct_agree, round_even(avg(pct_coverage), 2) AS macro_pct_coverage FROM x WHERE comparable > 0")
def q37_macro_average(spark: SparkSession, sf: str) -> DataFrame:
    return compare.macro_average(compare.pair_stats(_detail(spark, sf), "call_a", "call_b", ["nation"]), ["pct_agree", "pct_coverage"])


@query(f"WITH {CALLS}, x AS ({_stats_sql('nation')}) SELECT nation, comparable, pct_agree FROM x ORDER BY pct_agree ASC NULLS LAST, comparable DESC, nation LIMIT 5")
def q37b_worst_strata(spark: SparkSession, sf: str) -> DataFrame:
    x = compare.pair_stats(_detail(spark, sf), "call_a", "call_b", ["nation"])
    return x.orderBy(F.col("pct_agree").asc_nulls_last(), F.col("comparable").desc(), "nation").limit(5).select("nation", "comparable", "pct_agree")


@query(f"WITH {CALLS} SELECT name, call_a, call_b FROM dt WHERE agreement = 'disagree'")
def q37c_disagreements(spark: SparkSession, sf: str) -> DataFrame:
    return _detail(spark, sf).where("agreement = 'disagree'").select("name", "call_a", "call_b")


TRIPLE = """tr AS (SELECT o_orderkey AS name, 'status' AS clustering, CASE o_orderstatus WHEN 'F' THEN 'Forward' WHEN 'O' THEN 'Reverse' ELSE 'Unknown' END AS call FROM orders
UNION ALL SELECT o_orderkey, 'priority', CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Forward' WHEN o_orderpriority = '5-LOW' THEN 'Singleton' ELSE 'Reverse' END FROM orders
UNION ALL SELECT o_orderkey, 'none', 'Unknown' FROM orders)"""


@query(f"""WITH {TRIPLE}, u AS (SELECT * FROM tr WHERE call NOT IN ('Unknown', 'Singleton')), g AS (SELECT x.clustering AS a, y.clustering AS b, {_pct('count(*) FILTER (WHERE x.call = y.call)', 'count(*)')} AS pct FROM u x JOIN u y ON x.name = y.name AND x.clustering <> y.clustering GROUP BY 1, 2),
c AS (SELECT DISTINCT clustering AS a FROM tr) SELECT p.a, q.a AS b, CASE WHEN p.a = q.a THEN 100.0::DOUBLE ELSE pct END AS pct FROM c p CROSS JOIN c q LEFT JOIN g ON g.a = p.a AND g.b = q.a""")
def q38_agreement_matrix(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    calls = {
        "status": F.when(status == "F", "Forward").when(status == "O", "Reverse").otherwise("Unknown"),
        "priority": F.when(priority.isin("1-URGENT", "2-HIGH"), "Forward").when(priority == "5-LOW", "Singleton").otherwise("Reverse"),
        "none": F.lit("Unknown"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("clustering"), v.alias("call")) for k, v in calls.items()]))
    return compare.agreement_matrix(o.select(F.col("o_orderkey").alias("name"), each.alias("e")).select("name", "e.*"), "name", "clustering", "call")


@query("""
WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2), t AS (
  SELECT (SELECT sum(n::DOUBLE * (n - 1) / 2) FROM c) AS s, (SELECT sum(n::DOUBLE * (n - 1) / 2) FROM (SELECT sum(n)::BIGINT AS n FROM c GROUP BY p_brand)) AS sa,
  (SELECT sum(n::DOUBLE * (n - 1) / 2) FROM (SELECT sum(n)::BIGINT AS n FROM c GROUP BY p_type)) AS sb, (SELECT sum(n)::BIGINT FROM c) AS n
), e AS (SELECT *, sa * sb / (n::DOUBLE * (n - 1) / 2) AS expected FROM t)
SELECT n, round_even((s - expected) / ((sa + sb) / 2 - expected), 4) AS ari FROM e
""")
def q39_adjusted_rand(spark: SparkSession, sf: str) -> DataFrame:
    return compare.adjusted_rand(table(spark, sf, "part"), "p_brand", "p_type")


@query("""
WITH r AS (SELECT p_name AS a, CASE WHEN p_size % 9 = 0 THEN p_brand ELSE p_name END AS b FROM part), d AS (SELECT a, count(DISTINCT b) AS targets FROM r GROUP BY a), u AS (SELECT b, count(DISTINCT a) AS sources FROM r GROUP BY b)
SELECT (SELECT count(*) FROM r) AS n_shared, (SELECT count(*) FROM d) AS n_clusters_a, (SELECT count(*) FROM u) AS n_clusters_b, (SELECT count(*) FROM d WHERE targets = 1) AS intact_a, (SELECT count(*) FROM d WHERE targets > 1) AS split_a,
  (SELECT count(*) FROM u WHERE sources = 1) AS intact_b, (SELECT count(*) FROM u WHERE sources > 1) AS merged_b
""")
def q40_overlap_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_name").alias("a"), F.when(F.col("p_size") % 9 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("b"))
    return compare.overlap_stats(rows, "a", "b")


@query("""
WITH k AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 1.0 ELSE 0.0 END AS f FROM orders)
SELECT o_custkey, count(*) AS n, avg(f) AS forward, CASE avg(f) WHEN 1 THEN 'all_forward' WHEN 0 THEN 'all_reverse' ELSE 'mixed' END AS kind FROM k GROUP BY 1
""")
def q41_forward_fraction(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "Forward").when(F.col("o_orderstatus") == "O", "Reverse").otherwise("Unknown").alias("call"))
    return compare.forward_fractions(rows, "o_custkey", "call")


@query("""
WITH r AS (SELECT o_orderstatus AS x, o_orderpriority = '1-URGENT' AS y FROM orders WHERE o_orderstatus IN ('F', 'O')), t AS (
  SELECT count(*) FILTER (WHERE x = 'F' AND NOT y)::DOUBLE AS a, count(*) FILTER (WHERE x = 'F' AND y)::DOUBLE AS b, count(*) FILTER (WHERE x = 'O' AND NOT y)::DOUBLE AS c, count(*) FILTER (WHERE x = 'O' AND y)::DOUBLE AS d, count(*) AS n FROM r)
SELECT n, n * greatest(abs(a * d - b * c) - n / 2, 0.0::DOUBLE) * greatest(abs(a * d - b * c) - n / 2, 0.0::DOUBLE) / ((a + b) * (c + d) * (a + c) * (b + d)) AS chi2 FROM t
""")
def q42_chi_square(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").where("o_orderstatus IN ('F', 'O')").select(F.col("o_orderstatus").alias("x"), (F.col("o_orderpriority") == "1-URGENT").alias("y"))
    return compare.chi_square_2x2(rows, "x", "y")


@query(f"""WITH {CALLS}, f AS (SELECT o_orderkey AS name, o_orderkey % 3 = 0 AS flip FROM orders WHERE o_orderkey % 4 <> 0),
r AS (SELECT cb.name, call_b, call_a, CASE WHEN coalesce(flip, FALSE) THEN CASE call_b WHEN 'Forward' THEN 'Reverse' WHEN 'Reverse' THEN 'Forward' ELSE call_b END ELSE call_b END AS fixed FROM cb LEFT JOIN f USING (name) JOIN ca USING (name))
SELECT count(*) AS n, count(*) FILTER (WHERE call_b = call_a) AS before, count(*) FILTER (WHERE fixed = call_a) AS after, {_pct('count(*) FILTER (WHERE call_b = call_a)', 'count(*)')} AS before_pct, {_pct('count(*) FILTER (WHERE fixed = call_a)', 'count(*)')} AS after_pct
FROM r WHERE call_a <> 'Unknown' AND call_b <> 'Unknown'""")
def q43_flip_correction(spark: SparkSession, sf: str) -> DataFrame:
    flips = table(spark, sf, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("name"), (F.col("o_orderkey") % 3 == 0).alias("was_flipped"))
    return compare.flip_correction(_b(spark, sf).select("name", "call_b"), flips, _a(spark, sf), "name", "call_b", "call_a")


@query("""
WITH s AS (SELECT c_mktsegment, c_custkey, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS m FROM s)
SELECT c_mktsegment, count(*) AS clusters, median(n)::DOUBLE AS median, max(CASE WHEN r = m // 2 + 1 THEN n END) AS upper_median, max(n) AS largest, avg(n) AS mean, count(*) FILTER (WHERE n = 1) AS singletons FROM r GROUP BY 1
""")
def q44_size_stats(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    sizes = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_mktsegment", "c_custkey").agg(F.count(F.lit(1)).alias("n"))
    return compare.size_stats(sizes, "n", ["c_mktsegment"])


@query("""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS first FROM documents), g AS (SELECT text, count(DISTINCT lang) > 1 AS across FROM documents GROUP BY text HAVING count(DISTINCT lang) > 1)
SELECT lang, count(*) AS before, count(*) FILTER (WHERE first) AS after, count(*) FILTER (WHERE NOT first) AS removed, (SELECT count(*) FROM g) AS cross_groups FROM f GROUP BY lang
""")
def q45_collapse_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Exact duplicates collapsed to the first row, with counts before and after by stratum."""
    from weftline.operators.quality import collapse_summary

    return collapse_summary(table(spark, sf, "documents"), ["text"], "doc_id", "lang")


@query("""
WITH c AS (SELECT p_size AS size, p_type AS container, coalesce(nullif(p_brand, ''), 'Unknown') AS brand, count(*) AS n, min((p_partkey, coalesce(nullif(p_brand, ''), 'Unknown'))) AS first FROM part GROUP BY 1, 2, 3),
g AS (SELECT size, container, min(first) AS f, sum(n) - 1 AS removed FROM c GROUP BY 1, 2 HAVING count(*) > 1)
SELECT size, container, f[1] AS first, f[2] AS stays, CAST(removed AS BIGINT) AS removed, brand, n FROM g JOIN c USING (size, container)
""")
def q45b_cross_strata(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicates found in several strata: how many go, which one stays, how many of each; a row for each entry of the map."""
    from weftline.operators.quality import cross_strata

    parts = table(spark, sf, "part").select(F.col("p_size").alias("size"), F.col("p_type").alias("container"), "p_partkey", "p_brand")
    out = cross_strata(parts, ["size", "container"], "p_partkey", "p_brand")
    return out.select("size", "container", "first", "stays", "removed", F.explode("counts").alias("brand", "n"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, min((l_orderkey, l_linenumber)) LIMIT 20")
def q46b_top_counts(spark: SparkSession, sf: str) -> DataFrame:
    from weftline.operators.stats import top_counts

    return top_counts(table(spark, sf, "lineitem"), "l_partkey", ["l_orderkey", "l_linenumber"], 20)


@query("WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders) SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, o_orderkey)) AS o_orderkey, min(o_orderpriority) AS o_orderpriority FROM r GROUP BY 1")
def q46c_preferred_source(spark: SparkSession, sf: str) -> DataFrame:
    return first_per_key(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], ["o_orderpriority", "o_orderkey"])




_REPORT = {k: v for k, v in (("overall", "NULL"), ("type", "coalesce(segment, 'Unknown')"), ("subtype", "coalesce(nation, 'Unknown')"))}


def _report_sql() -> str:
    """The levels one by one, each with both regimes."""
    levels = []
    for level, name in _REPORT.items():
        by = {"overall": "", "type": " GROUP BY segment", "subtype": " GROUP BY nation"}[level]
        kind = "(SELECT coalesce(arg_max(m.segment, (m.k, -m.r)), 'Unknown') FROM md2 m WHERE m.nation IS NOT DISTINCT FROM dt.nation)" if level == "subtype" else "NULL::VARCHAR"
        both = _stats_sql().removeprefix("SELECT ").removesuffix(" FROM dt") + ", " + _stats_sql("", SINGLE, "ns_").removeprefix("SELECT ").removesuffix(" FROM dt")
        levels.append(f"SELECT '{level}' AS level, {name}::VARCHAR AS stratum, {kind} AS modal_type, {both} FROM dt{by}")
    counts = "md2 AS (SELECT nation, segment, count(*) AS k, row_number() OVER (ORDER BY segment) AS r FROM dt WHERE segment IS NOT NULL GROUP BY nation, segment)"
    return f"WITH {CALLS}, {counts} " + " UNION ALL ".join(levels)


@query(_report_sql())
def q35b_strata_report(spark: SparkSession, sf: str) -> DataFrame:
    """Overall, by segment and by nation, with and without singletons, from one shuffle by grouping sets."""
    return compare.strata_report(_detail(spark, sf), "call_a", "call_b", "segment", "nation", "group_name")
