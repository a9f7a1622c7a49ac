"""q01 to q16: annotation by intervals, label parsing, sequence functions, element ids, first and last occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import labels, seq
from weftline.operators import interval
from weftline.queries.base import SQL_ARRAYS, SQL_ELEMENTS, SQL_INTERVALS, arrays, elements, intervals, joined
from weftline.queries.registry import query
from weftline.runtime import table
from weftline.sources import readers


@query(f"""
WITH {SQL_INTERVALS}, d AS (
  SELECT a.array_id, b.array_id AS feature, greatest(b."start" - a."end", a."start" - b."end", 0) AS distance, a.parent
  FROM iv a JOIN iv b ON a.parent = b.parent AND a.priority <> '1-URGENT' AND b.priority = '1-URGENT'
), n AS (SELECT array_id, arg_min(feature, (distance, feature)) AS feature, min(distance) AS distance FROM d GROUP BY array_id)
SELECT iv.array_id, iv.parent, n.feature, n.distance FROM iv LEFT JOIN n USING (array_id) WHERE iv.priority <> '1-URGENT'
""")
def q01_nearest_interval(spark: SparkSession, sf: str) -> DataFrame:
    iv = intervals(spark, sf)
    features = iv.where("priority = '1-URGENT'").withColumn("feature", F.col("array_id")).select("parent", "start", "end", "feature")
    out = interval.nearest(iv.where("priority <> '1-URGENT'"), features, "parent", "array_id", "feature", ["feature"])
    return out.select("array_id", "parent", "feature", "distance")


LINKS_SQL = f"""
WITH {SQL_INTERVALS}, l AS (
  SELECT a.parent, a.array_id, b.array_id AS feature, greatest(b."start" - a."end", a."start" - b."end", 0) AS distance, b."start" AS s, b."end" AS e
  FROM iv a JOIN iv b ON a.parent = b.parent AND a.priority <> '1-URGENT' AND b.priority = '1-URGENT'
), r AS (
  SELECT parent, array_id, feature, distance, CAST(row_number() OVER (PARTITION BY array_id ORDER BY distance, s, e, feature) AS INTEGER) AS rank FROM l WHERE distance <= 60
)
"""


def _links(spark: SparkSession, sf: str) -> DataFrame:
    iv = intervals(spark, sf)
    features = iv.where("priority = '1-URGENT'").select("parent", "start", "end", F.col("array_id").alias("feature"))
    return interval.within(iv.where("priority <> '1-URGENT'"), features, "parent", "array_id", "feature", 60)


@query(LINKS_SQL + "SELECT * FROM r")
def q02_links_within_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf)


@query(LINKS_SQL + "SELECT count(DISTINCT array_id) AS linked, count(*) AS links, round_even(count(*) / count(DISTINCT array_id), 3) AS mean_links FROM r")
def q02b_link_summary(spark: SparkSession, sf: str) -> DataFrame:
    per = _links(spark, sf).groupBy("array_id").agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.count(F.lit(1)).alias("linked"), F.sum("n").alias("links"))
    return out.select("linked", "links", seq.round_half_even(F.col("links") / F.col("linked"), 3).alias("mean_links"))


CASCADE_SQL = """
WITH n AS (SELECT l_orderkey, count(*) AS n_elements FROM lineitem GROUP BY 1), c AS (SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY'), d AS (
  SELECT o_orderkey AS array_id, CASE WHEN o_totalprice < 1000 THEN 'low_evidence' WHEN coalesce(n_elements, 0) < 2 THEN 'few_elements' WHEN o_orderpriority = '5-LOW' THEN 'no_type'
    WHEN c.c_custkey IS NULL THEN 'not_in_clusters' WHEN o_orderstatus = 'P' THEN 'disagree' END AS drop_reason
  FROM orders LEFT JOIN n ON l_orderkey = o_orderkey LEFT JOIN c ON c.c_custkey = o_custkey)
"""


@query(CASCADE_SQL + "SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS n FROM d GROUP BY 1")
def q03_drop_reason_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered filters with the first failure named: one CASE column, one count."""
    o = table(spark, sf, "orders")
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_elements"))
    c = table(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select("c_custkey").distinct()
    rows = o.join(n, o["o_orderkey"] == n["l_orderkey"], "left").join(c, o["o_custkey"] == c["c_custkey"], "left")
    reason = (
        F.when(F.col("o_totalprice") < 1000, "low_evidence")
        .when(F.coalesce("n_elements", F.lit(0)) < 2, "few_elements")
        .when(F.col("o_orderpriority") == "5-LOW", "no_type")
        .when(F.col("c_custkey").isNull(), "not_in_clusters")
        .when(F.col("o_orderstatus") == "P", "disagree")
        .otherwise("kept")
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


#: Endings of the synthetic labels of q04, by p_partkey mod 8.
ENDINGS = ["Class1-Subtype-I-E", "Class1-Type-IV", "Class1-Subtype-I-Z", "Subtype-V-F1", "Subtype-XI-A", "Class2-Type_II", "", "class1-subtype-iii-a"]
_SUBTYPES_SQL = ", ".join(f"'{x}'" for x in labels.KNOWN_SUBTYPES)
_TYPES_SQL = ", ".join(f"'{x}'" for x in labels.TYPE_CLASS)
PARSED_SQL = f"""
WITH raw AS (
  SELECT p_partkey, 'seq' || p_partkey || '_CAS_' || CASE p_partkey % 8 {' '.join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(ENDINGS))} END || '_' || p_size AS raw FROM part
), a AS (
  SELECT *, regexp_replace(substr(raw, instr(raw, '_CAS_') + 5), '_[0-9]+$', '') AS bare FROM raw
), b AS (
  SELECT *, CASE WHEN bare = '' THEN '<EMPTY>' ELSE bare END AS canonical FROM a
), c AS (
  SELECT *, regexp_extract(canonical, '(?i)Class([12])', 1) AS stated, upper(regexp_extract(canonical, '(?i)(?:Subtype|Type)[_-]?([IVX]+(?:-[A-Z0-9]+)?)', 1)) AS found FROM b
), d AS (
  SELECT *, CASE WHEN found = '' THEN 'Unknown' ELSE split_part(found, '-', 1) END AS cas_type, CASE WHEN found IN ({_SUBTYPES_SQL}, {_TYPES_SQL}) THEN found ELSE 'Unknown' END AS cas_subtype FROM c
), e AS (
  SELECT p_partkey, canonical, cas_type, cas_subtype,
    CASE WHEN stated <> '' THEN 'Class' || stated WHEN cas_type IN ('I', 'III', 'IV', 'VII') THEN 'Class1' WHEN cas_type IN ('II', 'V', 'VI') THEN 'Class2' ELSE 'Unknown' END AS cas_class,
    CASE WHEN cas_type NOT IN ({_TYPES_SQL}) THEN 'unknown_type'
      WHEN cas_subtype IN ({_TYPES_SQL}) AND regexp_matches(canonical, '(?i)Type[_-][IVX]+($|[_-])') AND NOT regexp_matches(canonical, '(?i)Subtype') THEN 'coarse_type_only'
      WHEN cas_subtype = 'Unknown' THEN 'unknown_subtype' ELSE 'ok' END AS status FROM d)
"""


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    raw = F.concat(F.lit("seq"), F.col("p_partkey").cast("string"), F.lit("_CAS_"), ending, F.lit("_"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", labels.parse_type_label(raw).alias("l"), labels.coarse_type(raw).alias("coarse")).select("p_partkey", "l.*", "coarse")


@query(PARSED_SQL + "SELECT * FROM e")
def q04_type_label_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).drop("coarse")


@query(PARSED_SQL + "SELECT status, cas_class, cas_type, count(*) AS n, round_even(100.0::DOUBLE * count(*) / (sum(count(*)) OVER ())::DOUBLE, 2) AS pct FROM e GROUP BY 1, 2, 3")
def q04b_label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    from weftline.operators.stats import distribution

    return distribution(_parsed(spark, sf), ["status", "cas_class", "cas_type"])


@query(PARSED_SQL + f"""
, known AS (SELECT unnest([{_SUBTYPES_SQL}]) AS s), seen AS (SELECT DISTINCT cas_subtype AS s FROM e WHERE cas_subtype IN ({_SUBTYPES_SQL}))
SELECT (SELECT count(*) FROM seen) AS covered, (SELECT count(*) FROM known WHERE s NOT IN (SELECT s FROM seen)) AS missing, (SELECT count(*) FROM seen)::DOUBLE / (SELECT count(*) FROM known) AS fraction
""")
def q04c_dictionary_coverage(spark: SparkSession, sf: str) -> DataFrame:
    from weftline.operators.stats import coverage

    known = spark.createDataFrame([(x,) for x in labels.KNOWN_SUBTYPES], "value string")
    return coverage(_parsed(spark, sf).select(F.col("cas_subtype").alias("value")), known)


@query("SELECT p_partkey, reverse(translate(p_name, 'ACGTacgtNn', 'TGCAtgcaNn')) AS rc FROM part")
def q05_reverse_complement(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", seq.reverse_complement(F.col("p_name")).alias("rc"))


@query("SELECT p_partkey, regexp_replace(upper(p_name), '[^ACGT]', 'N', 'g') AS dna, length(p_name) AS n FROM part")
def q06_normalize_dna(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", seq.normalize_dna(F.col("p_name")).alias("dna"), F.length("p_name").cast("long").alias("n"))


NAMED_SQL = "na AS (SELECT l_orderkey AS id, list(p_name ORDER BY l_linenumber, l_partkey) AS names, any_value(o_orderstatus) AS status FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    li, p, o = table(spark, sf, "lineitem"), table(spark, sf, "part"), table(spark, sf, "orders")
    lists = (
        li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy(F.col("l_orderkey").alias("id"))
        .agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))).alias("e"))
        .select("id", F.transform("e", lambda x: x["p_name"]).alias("names"))
    )
    return lists.join(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), "id")


@query(f"WITH {NAMED_SQL} SELECT id, array_to_string(list_transform(list_reverse(names), lambda x: reverse(translate(x, 'ACGTacgtNn', 'TGCAtgcaNn'))), '|') AS rc FROM na")
def q07_reverse_complement_array(spark: SparkSession, sf: str) -> DataFrame:
    return _named(spark, sf).select("id", F.array_join(seq.reverse_complement_array(F.col("names")), "|").alias("rc"))


@query(f"""
WITH {NAMED_SQL}, d AS (SELECT *, CASE status WHEN 'F' THEN '+' WHEN 'O' THEN ' - ' ELSE 'ND' END AS direction FROM na)
SELECT id, trim(direction) = '-' AS flipped, array_to_string(CASE WHEN trim(direction) = '-' THEN list_transform(list_reverse(names), lambda x: reverse(translate(x, 'ACGTacgtNn', 'TGCAtgcaNn'))) ELSE names END, '|') AS oriented FROM d
""")
def q08_orient_array(spark: SparkSession, sf: str) -> DataFrame:
    d = F.when(F.col("status") == "F", "+").when(F.col("status") == "O", " - ").otherwise("ND")
    return _named(spark, sf).select("id", seq.is_flipped(d).alias("flipped"), F.array_join(seq.orient(F.col("names"), d), "|").alias("oriented"))


@query("""
WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'F note' WHEN 'O' THEN ' - ' ELSE 'FR' END AS a, CASE o_orderkey % 4 WHEN 0 THEN 'forward' WHEN 1 THEN ' REVERSE' WHEN 2 THEN NULL ELSE 'nd' END AS b FROM orders),
n AS (SELECT o_orderkey, CASE WHEN trim(a) = '+' OR trim(a) = 'F' OR trim(a) LIKE 'F %' THEN 'Forward' WHEN trim(a) = '-' OR trim(a) = 'R' OR trim(a) LIKE 'R %' THEN 'Reverse' ELSE 'Unknown' END AS call_a,
  CASE WHEN lower(trim(b)) = 'forward' THEN 'Forward' WHEN lower(trim(b)) = 'reverse' THEN 'Reverse' ELSE 'Unknown' END AS call_b FROM r)
SELECT *, CASE call_b WHEN 'Forward' THEN 'Reverse' WHEN 'Reverse' THEN 'Forward' ELSE call_b END AS flipped_b,
  CASE WHEN call_a = 'Unknown' OR call_b = 'Unknown' THEN 'not_comparable' WHEN call_a = call_b THEN 'agree' ELSE 'disagree' END AS agreement,
  o_orderkey % 4 IN (0, 2) AS truth FROM n
""")
def q09_direction_calls(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey") % 4
    a = F.when(F.col("o_orderstatus") == "F", "F note").when(F.col("o_orderstatus") == "O", " - ").otherwise("FR")
    b = F.when(key == 0, "forward").when(key == 1, " REVERSE").when(key == 3, "nd")
    truth = labels.parse_bool(F.when(key == 0, " Yes").when(key == 1, "no").when(key == 2, "TRUE"))
    rows = table(spark, sf, "orders").select("o_orderkey", labels.direction_a(a).alias("call_a"), labels.direction_b(b).alias("call_b"), truth.alias("truth"))
    return rows.select("*", labels.flip(F.col("call_b")).alias("flipped_b"), labels.agreement(F.col("call_a"), F.col("call_b")).alias("agreement"))


@query("""
WITH r AS (SELECT l_orderkey AS id, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 'Spacer' WHEN 'A' THEN 'DR' ELSE 'LeftFlank' END AS t FROM lineitem)
SELECT id, coalesce(string_agg(CASE WHEN t = 'Spacer' THEN l_partkey::VARCHAR END, ',' ORDER BY l_linenumber, l_partkey, t), '') AS spacers,
  coalesce(string_agg(CASE WHEN t = 'DR' THEN l_partkey::VARCHAR END, ',' ORDER BY l_linenumber, l_partkey, t), '') AS repeats,
  coalesce(arg_max(CASE WHEN t = 'LeftFlank' THEN l_partkey::VARCHAR END, CASE WHEN t = 'LeftFlank' THEN (l_linenumber, l_partkey) END), '') AS left_flank FROM r GROUP BY id
""")
def q10_region_split(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as nested JSON, written and parsed back, then split by type."""
    kind = F.when(F.col("l_returnflag") == "R", "Spacer").when(F.col("l_returnflag") == "A", "DR").otherwise("LeftFlank")
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", kind.alias("Type"), F.col("l_partkey").cast("string").alias("Sequence")).alias("r"))
    doc = rows.groupBy("id").agg(F.to_json(F.transform(F.sort_array(F.collect_list("r")), lambda r: F.struct(r["Type"].alias("Type"), r["Sequence"].alias("Sequence")))).alias("json"))
    parsed = doc.select("id", F.from_json("json", "array<struct<Type:string,Sequence:string>>").alias("regions"))
    return parsed.select(
        "id", F.array_join(seq.regions_of(F.col("regions"), "spacer"), ",").alias("spacers"), F.array_join(seq.regions_of(F.col("regions"), "DR", True), ",").alias("repeats"),
        seq.last_region(F.col("regions"), "LeftFlank").alias("left_flank"),
    )


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def q11_json_property(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf, "events").groupBy("event_type", (k % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_ARRAYS} SELECT id::VARCHAR AS id, array_to_string(elements, ',') AS elements, len(list_distinct(elements)) AS n_distinct FROM ar")
def q12_indexed_text_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays written as indexed text and parsed back."""
    from weftline.sources.writers import indexed_text

    record = indexed_text(F.col("id").cast("string"), F.col("elements"))
    parsed = readers.parse_indexed_text(arrays(spark, sf).select(record.alias("value")))
    return parsed.select("id", joined(F.col("elements")).alias("elements"), F.size(F.array_distinct("elements")).cast("long").alias("n_distinct"))


@query(f"WITH {SQL_ELEMENTS}, m AS (SELECT element, min((id, pos)) AS first_at FROM el GROUP BY element) SELECT element, CAST(row_number() OVER (ORDER BY first_at) - 1 AS BIGINT) AS idx FROM m")
def q13_first_seen_id(spark: SparkSession, sf: str) -> DataFrame:
    from weftline.operators.index import first_seen_ids

    return first_seen_ids(elements(spark, sf), "element", ["id", "pos"])


@query(f"""
WITH {SQL_ELEMENTS}, m AS (SELECT o_custkey AS parent, element, min((id, pos)) AS first_at FROM el JOIN orders ON o_orderkey = id GROUP BY 1, 2)
SELECT parent, element, CAST(row_number() OVER (PARTITION BY parent ORDER BY first_at) - 1 AS BIGINT) AS idx FROM m
""")
def q14_local_id(spark: SparkSession, sf: str) -> DataFrame:
    from weftline.operators.index import first_seen_ids

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent"))
    return first_seen_ids(elements(spark, sf).join(o, "id"), "element", ["id", "pos"], within=["parent"])


@query(f"WITH {SQL_ELEMENTS} SELECT element, arg_min(id, (id, pos)) AS id, CAST(arg_min(pos, (id, pos)) AS INTEGER) AS pos FROM el GROUP BY element")
def q15_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    from weftline.operators.index import first_per_key

    return first_per_key(elements(spark, sf), ["element"], ["id", "pos"])


@query(f"WITH {SQL_ELEMENTS} SELECT element, arg_max(id, (id, pos)) AS id, CAST(arg_max(pos, (id, pos)) AS INTEGER) AS pos FROM el GROUP BY element")
def q16_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    from weftline.operators.index import last_per_key

    return last_per_key(elements(spark, sf), ["element"], ["id", "pos"])
