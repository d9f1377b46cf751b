"""Consolidation of concept lists: dictionary, statistics, group sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import POINTS, description_of, last_value, name_of, strip
from weftgraph.operators.ranking import at_shares, top


def parsed_points(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (dataset, file, line, value) as points (dataset, file, line, doc_id, pos, point, name, description), and rejects.

    Blank lines are skipped. A line counts whole or not at all: what isn't an object with a map of points is a reject. Lines
    without an id are unknown_{line}. Of a repeated point key the last value counts; points without a name are dropped.
    """
    kept = lines.where(strip(F.col("value")) != "")
    read = kept.withColumn("_r", F.from_json("value", "doc_id string, knowledge_points string", {"mode": "PERMISSIVE"})).withColumn("_p", F.from_json("_r.knowledge_points", POINTS))
    bad = F.col("_r").isNull() | (F.col("_r.knowledge_points").isNotNull() & F.col("_p").isNull()) | ~strip(F.col("value")).startswith("{")
    keys = ["dataset", "file", "line", "doc_id"]
    named = read.where(~bad & F.col("_p").isNotNull()).withColumn("doc_id", F.coalesce("_r.doc_id", F.concat(F.lit("unknown_"), F.col("line").cast("string"))))
    points = last_value(named, "_p", keys).withColumns({"name": name_of(F.col("point")), "description": description_of(F.col("point")), "point": strip(F.col("point"))})
    return points.where("name <> ''").select(*keys, "pos", "point", "name", "description"), read.where(bad).select("dataset", "file", "line", "value")


def dictionary(points: DataFrame, *order: str) -> DataFrame:
    """(name, description): of a repeated name the last one in the order counts."""
    return points.groupBy("name").agg(F.max_by("description", F.struct(*order)).alias("description"))


def dataset_statistics(points: DataFrame, dataset: str = "dataset", item: str = "name") -> DataFrame:
    """Rows, distinct items and missing items by dataset, and over all (dataset null); distinct over all is over the union."""
    return points.rollup(dataset).agg(F.count("*").alias("rows"), F.countDistinct(item).alias("distinct_items"), F.count_if(F.col(item).isNull()).alias("missing"))


def status_counts(results: DataFrame) -> DataFrame:
    """Successes, failures and success rate by dataset, and over all (dataset null)."""
    ok = F.count_if(F.col("status") == "ok")
    return results.rollup("dataset").agg(F.count("*").alias("total"), ok.alias("ok"), (F.count("*") - ok).alias("failed"), F.round(100.0 * ok / F.count("*"), 6).alias("ok_percent"))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"))


def group_statistics(sizes: DataFrame) -> DataFrame:
    """One row: groups, items, mean, greatest, least and upper median size."""
    one = sizes.agg(F.count("*").alias("groups"), F.sum("n").cast("long").alias("items"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("greatest"), F.min("n").alias("least"))
    return one.crossJoin(at_shares(sizes, "n", median=0.5))


def point_statistics(df: DataFrame, group: str, name: str) -> DataFrame:
    """One row: instances, distinct names, ordered pairs of all groups, share of instances that repeat a name in percent."""
    sizes = group_sizes(df, group)
    pairs = sizes.agg(F.sum(F.expr("n * (n - 1) div 2")).cast("long").alias("pairs"))
    one = df.agg(F.count(name).alias("instances"), F.countDistinct(name).alias("names"))
    return one.crossJoin(pairs).withColumn("reuse_percent", F.round(F.when(F.col("instances") > 0, 100.0 * (F.col("instances") - F.col("names")) / F.col("instances")), 6))


def top_names(df: DataFrame, name: str, n: int = 10) -> DataFrame:
    counts = df.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
    return top(counts, n, F.desc("n"), "name")
