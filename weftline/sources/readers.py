"""Sources: nested JSON results, delimited tables, JSON lines, indexed text and free text. Every ordered input carries its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import labels, seq
from weftline.operators.index import first_per_key, last_per_key
from weftline.operators.interval import gap
from weftline.sources import schemas


def read_results(spark: SparkSession, root: str, recursive: bool = True, pattern: str = "result.json", lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(source, Sequences of the readable documents; source of the broken ones).

    All files of that name at any depth, or result.json in Result_* folders one level down. A broken file costs its own rows only.
    lines: a file holds a document a line, and a broken line costs its own rows only.
    """
    reader = spark.read.option("wholetext", not lines)
    if recursive:
        files = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    else:
        files = reader.text(f"{root}/Result_*/result.json")
    parsed = F.from_json("value", schemas.RESULT + ", _corrupt_record string", {"mode": "PERMISSIVE"})
    rows = files.select(F.col("_metadata.file_path").alias("source"), parsed.alias("d")).select("source", "d.*")
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record"), rows.where("_corrupt_record IS NOT NULL").select("source")


def read_results_or_single(spark: SparkSession, root: str) -> DataFrame:
    """Result_*/result.json, else root/result.json; an error if neither is there."""
    from pyspark.errors import AnalysisException

    try:
        return read_results(spark, root, recursive=False)[0]
    except AnalysisException:
        reader = spark.read.schema(schemas.RESULT).option("multiLine", True)
        return reader.json(f"{root}/result.json").select(F.col("_metadata.file_path").alias("source"), "Sequences")


def explode_arrays(results: DataFrame) -> DataFrame:
    """A row an array: source, seq_pos, array_pos, s (its sequence without the arrays) and a (the array)."""
    seqs = results.select("source", F.posexplode("Sequences").alias("seq_pos", "s"))
    rows = seqs.select("source", "seq_pos", F.col("s").dropFields("Crisprs").alias("s"), F.posexplode("s.Crisprs").alias("array_pos", "a"))
    return rows


def nearest_cassette(s: Column, a: Column) -> Column:
    """The cassette nearest to the array, both in one row; first in the list on a tie; null if there are none."""
    keyed = F.transform(s["Cas"], lambda c, i: F.struct(gap(a["Start"], a["End"], c["Start"], c["End"]).alias("distance"), i.alias("pos"), c["Type"].alias("Type"), c["Start"].alias("Start"), c["End"].alias("End"), F.size(c["Genes"]).alias("n_genes")))
    return F.array_min(keyed)


def annotated_arrays(results: DataFrame) -> DataFrame:
    """Arrays with the nearest cassette, its parsed type and distance."""
    rows = explode_arrays(results)
    near = nearest_cassette(F.col("s"), F.col("a"))
    rows = rows.withColumn("n", near).withColumn("l", labels.parse_type_label(F.col("n.Type")))
    return rows.select(
        "source", "seq_pos", "array_pos", F.col("s.Id").alias("sequence_id"), F.col("s.Version").alias("sequence_version"), F.col("s.Description").alias("sequence_description"),
        F.col("s.Length").alias("sequence_length"), F.col("a.Name").alias("array_name"), F.col("a.Start").alias("array_start"), F.col("a.End").alias("array_end"),
        F.coalesce("a.Evidence_Level", F.lit(0)).alias("evidence_level"), F.coalesce("a.Spacers", F.lit(0)).alias("n_spacers"), F.col("a.Repeat_ID").alias("repeat_id"),
        F.col("a.DR_Consensus").alias("dr_consensus"), F.col("a.DR_Length").alias("dr_length"), F.col("a.Potential_Orientation").alias("potential_orientation"),
        F.col("a.CRISPRDirection").alias("crispr_direction"), F.col("a.Conservation_DRs").alias("conservation_drs"), F.col("a.Conservation_Spacers").alias("conservation_spacers"),
        F.when(F.col("n").isNull(), "NoCas").otherwise(F.col("l.cas_class")).alias("cas_class"), F.when(F.col("n").isNull(), "NoCas").otherwise(F.col("l.cas_type")).alias("cas_type"),
        F.when(F.col("n").isNull(), "NoCas").otherwise(F.col("l.cas_subtype")).alias("cas_subtype"), F.col("n.distance").alias("cas_distance"), F.col("n.Type").alias("cas_raw"),
        F.col("l.status").alias("cas_status"), F.col("n.n_genes").alias("cas_genes"), F.col("a.Regions").alias("regions"),
    )


def extracted_arrays(results: DataFrame, least_evidence: int = 4) -> DataFrame:
    """Arrays with a name, a consensus and elements, of at least that evidence; empty elements are kept."""
    rows = explode_arrays(results).select(
        "source", "seq_pos", "array_pos", F.col("a.Name").alias("array_id"), F.coalesce("a.Evidence_Level", F.lit(0)).alias("evidence"), F.col("a.DR_Consensus").alias("repeat"),
        F.coalesce("a.CRISPRDirection", F.lit("ND")).alias("direction"), seq.regions_of(F.col("a.Regions"), "Spacer", True).alias("spacers"),
    )
    return rows.where((F.col("evidence") >= least_evidence) & (F.col("array_id") != "") & (F.size("spacers") > 0) & (F.col("repeat") != ""))


def oriented_arrays(results: DataFrame, least_evidence: int = 4) -> DataFrame:
    """Extracted arrays without empty elements, oriented by their direction, with the coarse type nearest to them; the first of an id wins."""
    rows = explode_arrays(results).select(
        "source", "seq_pos", "array_pos", F.col("a.Name").alias("array_id"), F.coalesce("a.Evidence_Level", F.lit(0)).alias("evidence"), F.coalesce("a.DR_Consensus", F.lit("")).alias("repeat"),
        F.coalesce("a.CRISPRDirection", F.lit("ND")).alias("direction"), labels.coarse_type(nearest_cassette(F.col("s"), F.col("a"))["Type"]).alias("cas_type"),
        F.filter(seq.regions_of(F.col("a.Regions"), "Spacer", True), lambda x: x != "").alias("raw"),
    )
    rows = rows.where((F.col("evidence") >= least_evidence) & (F.col("array_id") != "") & (F.size("raw") > 0))
    rows = rows.select("source", "seq_pos", "array_pos", "array_id", "repeat", "cas_type", seq.orient(F.col("raw"), F.col("direction")).alias("spacers"), seq.is_flipped(F.col("direction")).alias("was_flipped"))
    return first_per_key(rows, ["array_id"], ["source", "seq_pos", "array_pos"])


def calls_from_results(results: DataFrame) -> DataFrame:
    """array_name and direction of arrays with evidence 4 exactly."""
    rows = explode_arrays(results).where("a.Evidence_Level = 4")
    return rows.select("source", "seq_pos", "array_pos", F.col("a.Name").alias("array_name"), labels.direction_a(F.col("a.CRISPRDirection")).alias("direction"))


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = "\t") -> DataFrame:
    """All columns as text, and the file each row is from."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False).withColumn("source", F.col("_metadata.file_path"))


def calls_from_report(report: DataFrame) -> DataFrame:
    """array_name and direction of the report's rows with evidence 4; evidence that is no number counts as 0."""
    evidence = F.coalesce(F.expr("try_cast(try_cast(Evidence_Level AS double) AS int)"), F.lit(0))
    return report.where(evidence == 4).select("source", F.trim("CRISPR_Id").alias("array_name"), labels.direction_a(F.col("CRISPRDirection")).alias("direction"))


def calls_by_folder(from_json: DataFrame, from_report: DataFrame, folder: str = "folder", order: list[str] | None = None) -> DataFrame:
    """Calls of each folder's JSON, or of its report where it has no JSON; the first of a name wins."""
    rest = from_report.join(from_json.select(folder).distinct(), folder, "left_anti")
    return first_per_key(from_json.unionByName(rest), ["array_name"], order or [folder])


def python_list(cell: Column) -> Column:
    """array<string> of a Python list written as text; split at commas where it is no such list."""
    strict = F.from_json(F.translate(cell, "'", '"'), "array<string>")
    loose = F.filter(F.transform(F.split(F.translate(cell, "[]'\"", ""), ","), lambda t: F.trim(t)), lambda x: x != "")
    return F.coalesce(strict, loose)


def group_calls(rows: DataFrame) -> DataFrame:
    """Group calls handed to each member: array_name, group_name, evor_direction, recommend_reverse."""
    members = rows.withColumn("array_name", F.explode(python_list(F.col("array names"))))
    return members.select("array_name", F.col("name").alias("group_name"), labels.direction_b(F.col("predicted orientation")).alias("evor_direction"), labels.parse_bool(F.col("recommend reversing array")).alias("recommend_reverse"))


def text_ids(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Ids of the `>` lines: the first word after the mark."""
    lines = spark.read.text(paths)
    return lines.where(F.col("value").startswith(">")).select(F.split(F.trim(F.substring("value", 2, 1 << 30)), r"\s+")[0].alias("array_name")).where("array_name <> ''")


def text_ids_in(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the folder's *.fa files or, if it has none, of its *.fasta files; an error if it has neither."""
    from pyspark.errors import AnalysisException

    try:
        return text_ids(spark, f"{folder}/*.fa")
    except AnalysisException:
        return text_ids(spark, f"{folder}/*.fasta")


def read_clusters(spark: SparkSession, path: str, cluster: str = "cluster_id", bundled: bool = False) -> DataFrame:
    """kind, cluster, id, elements (integers in order) of indexed text by cluster, a folder each or bundled."""
    if bundled:
        records = spark.read.schema(f"`{cluster}` string, value string, kind string").json(path)
        return parse_indexed_text(records.withColumn(cluster, F.nullif(F.col(cluster), F.lit(""))), keep=["kind", cluster])
    records = spark.read.option("lineSep", ">").schema(f"value string, kind string, `{cluster}` string").text(path).where("trim(value) <> ''")
    return parse_indexed_text(records, keep=["kind", cluster])


def read_indexed_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """id, elements (integers in order) of indexed text, one record between marks."""
    return parse_indexed_text(spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''"))


def parse_indexed_text(records: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep, id and elements of records `>id`, newline, `0, 1, 2`. Tokens that are no integers are dropped; signs are allowed."""
    lines = F.split(F.regexp_replace(value, "^>", ""), "\n")
    tokens = F.transform(F.split(F.array_join(F.slice(lines, F.lit(2), F.size(lines)), ","), ","), lambda t: F.trim(t))
    whole = F.filter(tokens, lambda t: t.rlike("^-*[0-9]+$"))
    return records.select(*(keep or []), F.trim(lines[0]).alias("id"), F.filter(F.transform(whole, lambda t: t.try_cast("int")), lambda t: t.isNotNull()).alias("elements")).where("id <> ''")


def element_sets(arrays: DataFrame) -> DataFrame:
    """Distinct elements of each array; empty arrays are left out."""
    return arrays.select("id", F.array_distinct("elements").alias("elements")).where(F.size("elements") > 0)


def read_map_json(spark: SparkSession, path: str, kind: str, lines: bool = False) -> DataFrame:
    """key, value rows of a JSON file that is one object, or of files with an object a line."""
    return spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", kind)).alias("key", "value"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """element, idx of an index written in shards."""
    return read_map_json(spark, path, "map<string,bigint>", lines=True).select(F.col("key").alias("element"), F.col("value").alias("idx"))


def read_metadata(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """array_id, repeat, direction, of one object or of an object a line; no rows if the file is missing."""
    from pyspark.errors import AnalysisException

    try:
        return read_map_json(spark, path, schemas.METADATA, lines).select(F.col("key").alias("array_id"), "value.*")
    except AnalysisException:
        return spark.createDataFrame([], "array_id string, repeat string, direction string")


def read_flip_map(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """array_name, was_flipped of cluster metadata, over both levels of the object (or of an object a line)."""
    rows = read_map_json(spark, path, schemas.CLUSTERS, lines).select(F.explode("value.arrays").alias("array_name", "v"))
    return rows.select("array_name", F.coalesce("v.was_flipped", F.lit(False)).alias("was_flipped"))


def read_annotations(spark: SparkSession, path: str, required: tuple[str, ...] = ("array_name", "cas_class", "cas_type", "cas_subtype")) -> DataFrame:
    """Trimmed annotation rows: rows without a name dropped, blanks Unknown, the first of a name wins. Missing columns are an error."""
    rows = read_delimited(spark, path)
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    rows = rows.withColumn("__at", F.monotonically_increasing_id())
    clean = rows.select(F.trim(required[0]).alias(required[0]), *[labels.fill(F.nullif(F.trim(c), F.lit(""))).alias(c) for c in required[1:]], "__at")
    return first_per_key(clean.where(f"{required[0]} <> ''"), [required[0]], ["__at"]).drop("__at")


def read_cluster_table(spark: SparkSession, path: str, key: str = "array_name") -> DataFrame:
    """Cluster rows by name, the last of a name wins."""
    rows = read_delimited(spark, path, ",").withColumn("__at", F.monotonically_increasing_id())
    return last_per_key(rows, [key], ["__at"]).drop("__at", "source")


def read_lookup(spark: SparkSession, path: str, key: str = "array_name", sep: str = "\t") -> DataFrame:
    """Curated rows by name, the first of a name wins."""
    rows = read_delimited(spark, path, sep).withColumn("__at", F.monotonically_increasing_id())
    return first_per_key(rows, [key], ["__at"]).drop("__at", "source")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Training examples of JSON lines; blank lines are skipped, missing texts are empty, lists empty, counts 0."""
    rows = spark.read.schema(schemas.EXAMPLE).json(path)
    fills = {"string": F.lit(""), "int": F.lit(0), "bigint": F.lit(0), "array<string>": F.array().cast("array<string>")}
    keep = {"label", "cas_subtype"}
    rows = rows.where("array_name IS NOT NULL")
    return rows.select(*[F.col(c) if c in keep else F.coalesce(F.col(c), fills[t]).alias(c) for c, t in rows.dtypes])


def read_predictions(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Prediction tables of several clusterings with their name; singletons are out, rows without a group stay. Missing tables are skipped."""
    from pyspark.errors import AnalysisException

    out = None
    for name, path in paths.items():
        try:
            rows = read_delimited(spark, path, ",").drop("source").withColumn("clustering", F.lit(name))
        except AnalysisException:
            continue
        rows = rows.where(~F.col("group_name").eqNullSafe(F.lit(schemas.SINGLETON)))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "array_name string, group_name string, evor_direction string, clustering string")


def read_logs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name (file), text of whole log files."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("name"), F.col("value").alias("text"))
