"""Readers of every stage's input. Parquet is the form between stages; the text forms are imported."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import DEPENDENCY, strip, walk_nodes
from weftgraph.operators.ranking import indexed


def there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def require(spark: SparkSession, *paths: str) -> None:
    """Fails, naming all paths that aren't there."""
    gone = [p for p in paths if not there(spark, p)]
    if gone:
        raise FileNotFoundError(", ".join(gone))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines numbered from 1 in each file. A file's lines come in order from its splits."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value")
    rows = indexed(raw.withColumn("_at", F.monotonically_increasing_id()).withColumnRenamed("_at", "_seq"), "file", "_block", "_seq", out="_n")
    first = rows.groupBy("file").agg(F.min("_n").alias("_first"))
    return rows.join(first, "file").select("file", (F.col("_n") - F.col("_first") + 1).alias("line"), "value")


def datasets(spark: SparkSession, glob: str, suffixes: Sequence[str] = (), include: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """(dataset, file) of files under a glob; the name is the file's without a suffix."""
    from weftgraph.functions.text import without_suffix

    files = spark.read.format("binaryFile").load(glob).select(F.col("path").alias("file"))
    found = files.withColumn("dataset", F.regexp_extract("file", r"([^/]+)$", 1))
    found = found.withColumn("dataset", without_suffix(F.col("dataset"), suffixes)) if suffixes else found
    if include is not None:
        found = found.where(F.col("dataset").isin(list(include)))
    return found.where(~F.col("dataset").isin(list(exclude))).select("dataset", "file")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a JSONL file; blank and malformed lines are skipped, columns are the union of all keys."""
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def json_rejects(lines: DataFrame) -> DataFrame:
    """Lines (value) that aren't blank and aren't JSON."""
    return lines.where((strip(F.col("value")) != "") & F.expr("try_parse_json(value)").isNull())


def extraction_lines(lines: DataFrame, delimiter: str = "##@@B", most: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, question), and the columns to keep, of lines (line, value) with a delimiter; split once, trimmed. most: only the first lines."""
    kept = lines if most is None else lines.where(F.col("line") <= most)
    parts = F.split("value", delimiter, 2)
    return kept.where(F.size(parts) == 2).select(strip(parts[0]).alias("doc_id"), strip(parts[1]).alias("question"), *keep)


def groups_of_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(problem_id, pos, kp) of a text whose groups are parted by blank lines. Blank lines part the records of the scan itself,
    so one large file is read by many tasks; blank lines with spaces part a record again."""
    raw = spark.read.option("lineSep", "\n\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_s"), "value")
    each = raw.select("file", "_b", "_s", F.posexplode(F.split("value", r"\n\s*\n")).alias("_p", "_g"))
    items = F.filter(F.transform(F.split("_g", "\n"), strip), lambda x: x != "")
    groups = each.select("file", "_b", "_s", "_p", items.alias("_i")).where(F.size("_i") > 0)
    numbered = indexed(groups, "file", "_b", "_s", "_p", out="problem_id")
    return numbered.select("problem_id", F.posexplode("_i").alias("pos", "kp"))


def groups_of_json(text: DataFrame) -> DataFrame:
    """(problem_id, pos, kp) of a row (value) that is a JSON array of arrays."""
    return text.select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("problem_id", "_g")).select("problem_id", F.posexplode("_g").alias("pos", "kp"))


def weighted_edges(lines: DataFrame, least: float = 1.0) -> DataFrame:
    """(u, v, w) of `u##v - w` lines (value): exactly two parts each time, a number as weight, ends in order."""
    parts = F.split(strip(F.col("value")), " - ")
    ends = F.split(parts[0], "##")
    w = F.expr("try_cast(_w as double)")
    good = lines.where((F.size(parts) == 2) & (F.size(ends) == 2)).select(strip(ends[0]).alias("_a"), strip(ends[1]).alias("_b"), strip(parts[1]).alias("_w"))
    return good.select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v"), w.alias("w")).where(F.col("w").isNotNull() & (F.col("w") >= least))


#: An item of a literal list of texts: in single or double quotes, with backslashes before what they protect.
QUOTED = r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""
#: A cluster's line: known keys in their order; what stands between two of them is a value, whatever marks it holds.
CLUSTER = (
    r'(?s)^\s*\[main_keyword: "?(.*?)"?\]##\[main_index: (\d+)\](?:##\[main_description: "?(.*?)"?\])?##\[indices: (\[.*?\])\]'
    r"(?:##\[descriptions: (\[.*?\])\])?##\[topics: (\[.*?\])\](?:##\[contents: (\[.*?\])\])?\s*$"
)


def quoted_list(c: Column) -> Column:
    """The texts of a literal list in either kind of quotes."""
    each = F.regexp_extract_all(c, F.lit(QUOTED), F.lit(1))
    return F.transform(each, lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))


def cluster_lines(lines: DataFrame) -> DataFrame:
    """(main_name, main_index, main_description, indices, descriptions, members) of `[key: value]##[key: value]` lines (value). Members
    are the contents, or the topics where a line has no contents; other lines are skipped."""
    part = lambda n: F.regexp_extract("value", CLUSTER, n)
    return lines.where(F.col("value").rlike(CLUSTER)).select(
        part(1).alias("main_name"), part(2).cast("long").alias("main_index"), part(3).alias("main_description"),
        F.from_json(part(4), "array<bigint>").alias("indices"), quoted_list(part(5)).alias("descriptions"),
        F.when(part(7) != "", quoted_list(part(7))).otherwise(quoted_list(part(6))).alias("members"),
    )


def walks(lines: DataFrame) -> DataFrame:
    """(nodes) of walk lines (value); other lines are skipped."""
    return lines.select(walk_nodes(F.col("value")).alias("nodes")).where("nodes is not null")


def dependency_lines(lines: DataFrame) -> DataFrame:
    """(line_index, knowledge_points, dependencies) of JSONL lines (value); malformed lines are skipped."""
    kinds = f"line_index bigint, knowledge_points array<string>, dependencies {DEPENDENCY.simpleString()}"
    return lines.select(F.from_json("value", kinds).alias("_r")).where("_r is not null and _r.knowledge_points is not null").select("_r.*")


def combinations(lines: DataFrame) -> DataFrame:
    """(combo) of `a##b##c` lines (value), blank parts dropped."""
    parts = F.filter(F.transform(F.split("value", "##"), strip), lambda x: x != "")
    return lines.select(parts.alias("combo")).where(F.size("combo") > 0)


def json_map(text: DataFrame) -> DataFrame:
    """(name, description) of a row (value) that is a JSON object; of a repeated key the last value counts."""
    each = text.select(F.posexplode(F.from_json("value", "map<string,string>")).alias("pos", "name", "description"))
    return each.groupBy("name").agg(F.max_by("description", "pos").alias("description"))


def mapping_file(text: DataFrame) -> DataFrame:
    """(name, representative) of a row (value) that is a JSON object with a section original_to_representative."""
    found = F.from_json("value", "original_to_representative map<string,string>")["original_to_representative"]
    return text.select(F.explode(found).alias("name", "representative"))


def statistics_file(text: DataFrame) -> DataFrame:
    """(section, name, value) of a row (value) that is a JSON object of objects; values as text."""
    each = text.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("section", "_m"))
    return each.select("section", F.explode("_m").alias("name", "value"))


def graph_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(node table, edge table) of a GEXF file, with the attributes that it declares as a map; fails if there are no nodes, or an edge has no
    weight."""
    values = "attvalues struct<attvalue:array<struct<_for:string,_value:string>>>"
    named = F.coalesce(F.map_from_entries(F.transform("attvalues.attvalue", lambda a: F.struct(a["_for"], a["_value"]))), F.create_map().cast("map<string,string>"))
    nodes = spark.read.schema(f"_id string, _label string, {values}").format("xml").option("rowTag", "node").load(path)
    edges = spark.read.schema(f"_source string, _target string, _weight double, {values}").format("xml").option("rowTag", "edge").load(path)
    edges = edges.select(F.col("_source").alias("u"), F.col("_target").alias("v"), F.col("_weight").alias("weight"), named.alias("attributes"))
    if nodes.isEmpty() or edges.where("weight is null").limit(1).count():
        raise ValueError("the graph has no nodes, or an edge without a weight")
    return nodes.select(F.col("_id").alias("id"), named.alias("attributes")), edges


def edge_list(lines: DataFrame) -> DataFrame:
    """(u, v, weight) of tab-separated lines (value)."""
    parts = F.split("value", "\t")
    return lines.where(F.size(parts) == 3).select(parts[0].alias("u"), parts[1].alias("v"), parts[2].cast("double").alias("weight"))


def name_lines(lines: DataFrame) -> DataFrame:
    """(idx, name) of `idx\tname` lines (value); split once."""
    parts = F.split("value", "\t", 2)
    return lines.where(F.size(parts) == 2).select(parts[0].cast("long").alias("idx"), parts[1].alias("name"))


def embeddings(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """(idx, name, vec) of stored vectors (idx, vec); fails unless every name has one."""
    found = spark.read.parquet(path).select("idx", "vec").join(names, "idx")
    if found.count() != names.count():
        raise ValueError("vectors and names differ in number")
    return found.select("idx", "name", "vec")


def explore(df: DataFrame, n: int = 3) -> dict:
    """Columns with their types, the number of rows and a few rows."""
    return {"columns": dict(df.dtypes), "rows": df.count(), "sample": [r.asDict(recursive=True) for r in df.limit(n).collect()]}


def file_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines, filled) of text files: all lines, and those that aren't blank."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(strip(F.col("value")) != "").alias("filled"))


def saved_groups(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """(problem_id, pos, kp) of a saved list: parquet, json (an array of arrays) or text (blank lines between groups)."""
    if form == "parquet":
        return spark.read.parquet(path).select("problem_id", "pos", "kp")
    return groups_of_json(spark.read.text(path, wholetext=True)) if form == "json" else groups_of_blocks(spark, path)
