"""Sinks: Parquet between stages, text forms and reports for export."""

from __future__ import annotations

import json
from collections.abc import Mapping
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import edge_line, walk_line
from weftgraph.operators.cooccur import ordered_pairs
from weftgraph.operators.ranking import indexed


def json_lines(df: DataFrame, path: str, first: str | None = None, mode: str = "overwrite") -> None:
    """JSONL; `first` names the column that comes first."""
    (df.select(first, *(c for c in df.columns if c != first)) if first else df).write.mode(mode).json(path)


def delimited(df: DataFrame, path: str, *columns: str, delimiter: str = "##@@B") -> None:
    df.select(F.concat_ws(delimiter, *columns).alias("value")).write.mode("overwrite").text(path)


def three_way(results: DataFrame, path: str, parsed: Column) -> None:
    """Raw replies of all rows, then what could be parsed and what couldn't, appended. The results must be stored."""
    results.write.mode("append").json(f"{path}/raw")
    results.where("status = 'ok'").withColumn("parsed", parsed).drop("raw").write.mode("append").json(f"{path}/parsed")
    results.where("status <> 'ok'").write.mode("append").json(f"{path}/error")


def blocks(groups: DataFrame, path: str, group: str = "problem_id", pos: str = "pos", item: str = "kp") -> None:
    """Groups as lines, parted by blank lines."""
    lists = groups.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct(pos, item))), lambda x: x[item]).alias("_l"))
    lists.orderBy(group).select(F.array_join("_l", "\n").alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def cooccurrence(pairs: DataFrame, path: str) -> None:
    """`u##v - w` lines, heaviest first."""
    pairs.orderBy(F.desc("w"), "u", "v").select(edge_line(F.col("u"), F.col("v"), F.col("w")).alias("value")).write.mode("overwrite").text(path)


def walks(found: DataFrame, path: str) -> None:
    found.where("reason is null").orderBy("start", "number").select(walk_line(F.col("start"), F.col("nodes"), F.col("weights")).alias("value")).write.mode("overwrite").text(path)


def combinations(found: DataFrame, path: str) -> None:
    lines = found.select(F.array_join("combo", "##").alias("value"))
    lines.orderBy("value").write.mode("overwrite").text(path)


def valid_json(lines: DataFrame) -> DataFrame:
    """One row: total, valid and invalid lines (value)."""
    bad = F.count_if(F.expr("try_parse_json(value)").isNull())
    return lines.agg(F.count("*").alias("total"), (F.count("*") - bad).alias("valid"), bad.alias("invalid"))


def literal_list(c: Column) -> Column:
    """Texts as a literal list in single quotes; quotes and backslashes are protected by a backslash."""
    each = F.transform(c, lambda x: F.concat(F.lit("'"), F.regexp_replace(x, r"([\\'])", r"\\$1"), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))


def clusters(records: DataFrame, path: str) -> None:
    """Cluster records as `[key: value]##[key: value]` lines of seven keys, by main index."""
    part = lambda k, c: F.concat(F.lit(f"[{k}: "), c.cast("string"), F.lit("]"))
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    indices = F.concat(F.lit("["), F.array_join(F.col("indices").cast("array<string>"), ", "), F.lit("]"))
    line = F.concat_ws(
        "##", part("main_keyword", quoted("main_name")), part("main_index", F.col("main_index")), part("main_description", quoted("main_description")), part("indices", indices),
        part("descriptions", literal_list(F.col("descriptions"))), part("topics", indices), part("contents", literal_list(F.col("members"))),
    )
    records.orderBy("main_index").select(line.alias("value")).write.mode("overwrite").text(path)


def edge_list(edges: DataFrame, path: str) -> None:
    edges.orderBy("u", "v").select(F.concat_ws("\t", "u", "v", "weight").alias("value")).write.mode("overwrite").text(path)


def json_object(df: DataFrame, path: str, key: str, value: str) -> None:
    """Two columns as one JSON object in one file: a small table's exchange form. Lines are sorted by ranges and follow each other, so
    that no row holds the whole object. An empty table is an empty object."""
    entry = F.concat(F.to_json(F.array(F.col(key).cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(key).cast("string")))) - 2), F.lit(": "), F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2))
    rows = indexed(df.select(F.col(key).cast("string").alias("_k"), entry.alias("_e")), "_k", out="_n")
    last = rows.count() - 1
    line = F.concat(F.when(F.col("_n") == 0, "{").otherwise(""), "_e", F.when(F.col("_n") == last, "}").otherwise(","))
    lines = rows.select("_n", line.alias("value")) if last >= 0 else df.sparkSession.createDataFrame([(0, "{}")], "_n long, value string")
    lines.coalesce(1).sortWithinPartitions("_n").select("value").write.mode("overwrite").text(path)


def mapping(found: DataFrame, path: str) -> None:
    """(name, representative) as the three sections of a mapping file, in one JSON object: a row a section, so for tables that fit one
    row; larger mappings stay Parquet."""
    own = found.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "representative")))).alias("original_to_representative"))
    groups = found.groupBy("representative").agg(F.sort_array(F.collect_list("name")).alias("_m"))
    all_ = groups.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("representative", "_m")))).alias("representative_to_members"))
    many = groups.where(F.size("_m") > 1).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("representative", "_m")))).alias("actual_clusters_only"))
    totals = found.agg(F.struct(F.count("*").alias("total_original_points"), F.countDistinct("representative").alias("total_representatives")).alias("metadata"))
    totals.crossJoin(own).crossJoin(all_).crossJoin(many).select(F.to_json(F.struct("metadata", "original_to_representative", "representative_to_members", "actual_clusters_only")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def statistics(sections: Mapping[str, DataFrame], path: str) -> None:
    """One-row frames of statistics as one JSON object of objects."""
    both = None
    for name, df in sections.items():
        own = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(f"_{name}"))
        both = own if both is None else both.crossJoin(own)
    parts = [F.concat(F.lit(f'"{name}": '), F.col(f"_{name}")) for name in sections]
    both.select(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def pairs_text(groups: DataFrame, path: str, group: str = "problem_id", pos: str = "pos", item: str = "kp") -> None:
    """`a##b` lines of every two places of a group, the earlier first."""
    ordered_pairs(groups, group, pos, item).orderBy("g", "first", "second").select(F.concat_ws("##", "first", "second").alias("value")).write.mode("overwrite").text(path)


def flat_text(groups: DataFrame, path: str, group: str = "problem_id", pos: str = "pos", item: str = "kp") -> None:
    """A line for each item, groups in order."""
    groups.orderBy(group, pos).select(F.col(item).alias("value")).write.mode("overwrite").text(path)


def titled_blocks(groups: DataFrame, path: str, group: str = "problem_id", pos: str = "pos", item: str = "kp") -> None:
    """Groups as `Problem_n:` with an indented line for each item, parted by blank lines; n counts from 1."""
    lists = groups.groupBy(group).agg(F.transform(F.sort_array(F.collect_list(F.struct(pos, item))), lambda x: F.concat(F.lit("  "), x[item])).alias("_l"))
    text = F.concat(F.lit("Problem_"), (F.col(group) + 1).cast("string"), F.lit(":\n"), F.array_join("_l", "\n"))
    lists.orderBy(group).select(text.alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def array_of_arrays(groups: DataFrame, path: str, group: str = "problem_id", pos: str = "pos", item: str = "kp") -> None:
    """Groups as one JSON array of arrays in one file, a line for each group."""
    lists = groups.groupBy(group).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(pos, item))), lambda x: x[item])).alias("_l"))
    rows = indexed(lists, group, out="_n")
    last = rows.count() - 1
    line = F.concat(F.when(F.col("_n") == 0, "[").otherwise(""), "_l", F.when(F.col("_n") == last, "]").otherwise(","))
    lines = rows.select("_n", line.alias("value")) if last >= 0 else groups.sparkSession.createDataFrame([(0, "[]")], "_n long, value string")
    lines.coalesce(1).sortWithinPartitions("_n").select("value").write.mode("overwrite").text(path)


def embeddings(found: DataFrame, path: str) -> None:
    """Vectors (idx, name, vec, and lex if it is there) as Parquet under vectors, `idx\tname` lines under names, and one JSON object of
    counts under metadata."""
    found.write.mode("overwrite").parquet(f"{path}/vectors")
    stored_rows = found.sparkSession.read.parquet(f"{path}/vectors")
    stored_rows.orderBy("idx").select(F.concat_ws("\t", "idx", "name").alias("value")).write.mode("overwrite").text(f"{path}/names")
    facts = stored_rows.agg(F.count("*").alias("rows"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dimensions"), F.count_if(F.col("vec").isNull()).alias("missing"))
    statistics({"embeddings": facts}, f"{path}/metadata")


def attribute(c: Column) -> Column:
    """A text as a quoted XML attribute."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return F.concat(F.lit('"'), c, F.lit('"'))


def graph_file(ids: DataFrame, edges: DataFrame, path: str) -> None:
    """GEXF, a graph's exchange form, in one file under a folder that all executors share. Columns beside id, and beside u, v and weight,
    are declared and written as attributes."""
    def declared(kind: str, names: list[str]) -> str:
        return f'<attributes class="{kind}">' + "".join(f"<attribute id={quoteattr(n)} title={quoteattr(n)} type=\"string\"/>" for n in names) + "</attributes>"

    def values(names: list[str]) -> Column:
        each = [F.concat(F.lit(f"<attvalue for={quoteattr(n)} value="), attribute(F.col(f"`{n}`").cast("string")), F.lit("/>")) for n in names]
        return F.concat(F.lit("<attvalues>"), F.concat_ws("", *each), F.lit("</attvalues>"))

    own, more = [c for c in ids.columns if c != "id"], [c for c in edges.columns if c not in ("u", "v", "weight")]
    key = attribute(F.col("id").cast("string"))
    node = F.concat(F.lit("<node id="), key, F.lit(" label="), key, F.lit(">"), values(own), F.lit("</node>"))
    edge = F.concat(F.lit("<edge source="), attribute(F.col("u").cast("string")), F.lit(" target="), attribute(F.col("v").cast("string")), F.lit(' weight="'), F.col("weight").cast("string"), F.lit('">'), values(more), F.lit("</edge>"))
    line = lambda n, text: ids.sparkSession.createDataFrame([(n, "", "", text)], "_n int, _a string, _b string, value string")
    head = '<?xml version="1.0" encoding="UTF-8"?><gexf xmlns="http://www.gexf.net/1.2draft" version="1.2"><graph defaultedgetype="undirected">'
    rows = line(0, f"{head}{declared('node', own)}{declared('edge', more)}<nodes>")
    rows = rows.unionByName(ids.select(F.lit(1).alias("_n"), F.col("id").cast("string").alias("_a"), F.lit("").alias("_b"), node.alias("value"))).unionByName(line(2, "</nodes><edges>"))
    rows = rows.unionByName(edges.select(F.lit(3).alias("_n"), F.col("u").cast("string").alias("_a"), F.col("v").cast("string").alias("_b"), edge.alias("value"))).unionByName(line(4, "</edges></graph></gexf>"))
    rows.orderBy("_n", "_a", "_b").coalesce(1).select("value").write.mode("overwrite").text(path)


def one_row(df: DataFrame) -> dict:
    """A one-row frame of statistics as a dict."""
    return df.first().asDict(recursive=True)


def report(title: str, sections: Mapping[str, DataFrame], most: int = 1000) -> str:
    """Text of one-row statistics and of tables; of a table with over `most` rows the text says how many more there are."""
    lines = [title, "=" * len(title)]
    for name, df in sections.items():
        lines += ["", name, "-" * len(name)]
        rows = df.limit(most + 1).collect()
        if len(rows) == 1:
            lines += [f"{k}: {v}" for k, v in rows[0].asDict().items()]
        else:
            lines += [" | ".join(map(str, r)) for r in rows[:most]]
            if len(rows) > most:
                lines.append(f"({df.count() - most} rows more)")
    return "\n".join(lines) + "\n"


def report_file(text: str, spark: SparkSession, path: str) -> None:
    """A report as one text file of a shared folder."""
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def report_json(sections: Mapping[str, DataFrame], most: int = 1000) -> str:
    """Sections as lists of rows; a list of over `most` rows ends with {"more": how many}."""
    out = {}
    for k, df in sections.items():
        rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
        out[k] = rows if len(rows) <= most else [*rows[:most], {"more": df.count() - most}]
    return json.dumps(out, default=str, indent=1)
