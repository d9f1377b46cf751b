"""Text, key and reply functions on columns. Blanks are Unicode white space, as in Python's strip()."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.config import Ingest

NAME_MARK = " - "

DEPENDENCY = T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("to", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("reason", T.StringType())]))
POINTS = T.MapType(T.StringType(), T.StringType())


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """White space to single spaces, trimmed; null gives an empty text."""
    return F.coalesce(strip(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def first_filled(df: DataFrame, names: Sequence[str] = Ingest.question_columns) -> Column:
    """The first of the columns that exist whose text isn't empty; null if there is none."""
    have = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def doc_id(dataset: Column | str, df: DataFrame, line: Column, names: Sequence[str] = Ingest.id_columns) -> Column:
    """{dataset}{id}: the first id column that the schema has, else the line number. A null id is written as None."""
    name = F.lit(dataset) if isinstance(dataset, str) else dataset
    own = next((F.coalesce(F.col(n).cast("string"), F.lit("None")) for n in names if n in df.columns), line.cast("string"))
    return F.concat(F.lit("{"), name, F.lit("}{"), own, F.lit("}"))


def name_of(point: Column) -> Column:
    """What stands before the first ` - ` of `name - description`."""
    return strip(F.split(point, NAME_MARK, 2)[0])


def description_of(point: Column) -> Column:
    """What stands after the first ` - `; empty if there is none."""
    return strip(F.coalesce(F.get(F.split(point, NAME_MARK, 2), F.lit(1)), F.lit("")))


def fill(template: str | Column, **values: Column) -> Column:
    """Each {key} of a template replaced by a column."""
    out = F.lit(template) if isinstance(template, str) else template
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def object_text(reply: Column) -> Column:
    """The JSON object of a reply: inside the first fenced json block, else from the first { to the last }; null if none."""
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```json(.*?)```", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(fenced, bare)


def points_of(reply: Column) -> Column:
    """A reply's object as a map; null if it isn't an object."""
    found = object_text(reply)
    return F.when(F.get_json_object(found, "$").startswith("{"), F.from_json(found, POINTS))


def array_text(reply: Column) -> Column:
    """The JSON array of a reply: from the first [ to the last ]; null if none."""
    return F.nullif(F.regexp_extract(reply, r"(?s)\[.*\]", 0), F.lit(""))


def dependencies_of(reply: Column) -> Column:
    return F.from_json(array_text(reply), DEPENDENCY)


def last_value(df: DataFrame, points: str, keys: Sequence[str]) -> DataFrame:
    """keys, point_id and point of a map column; of a repeated key the last entry counts."""
    each = df.select(*keys, F.posexplode(points).alias("_pos", "point_id", "point"))
    return each.groupBy(*keys, "point_id").agg(F.max_by("point", "_pos").alias("point"), F.max("_pos").alias("pos"))


def clean_key(c: Column) -> Column:
    """Without backslashes, trimmed, without surrounding quotes."""
    return F.regexp_replace(strip(F.replace(c, F.lit("\\"), F.lit(""))), "^[\"']+|[\"']+$", "")


def plain_key(c: Column) -> Column:
    """Without backslashes, trimmed."""
    return strip(F.replace(c, F.lit("\\"), F.lit("")))


def without_suffix(c: Column, suffixes: Sequence[str]) -> Column:
    """A dataset's name without one of the suffixes at its end."""
    import re

    return F.regexp_replace(c, "(?:" + "|".join(map(re.escape, suffixes)) + ")$", "")


def edge_line(u: Column, v: Column, w: Column) -> Column:
    return F.concat(u, F.lit("##"), v, F.lit(NAME_MARK), w.cast("string"))


WALK_PREFIX = "Diverse Random Walk from "


def walk_line(start: Column, nodes: Column, weights: Column) -> Column:
    """A walk as a line; weights as text, N/A if there are none."""
    steps = F.when(F.size(weights) > 0, F.array_join(weights, " -> ")).otherwise("N/A")
    return F.concat(F.lit(WALK_PREFIX), start, F.lit("##@@B"), F.array_join(nodes, "##"), F.lit("##@@BStep Weights: "), steps)


def walk_nodes(line: Column) -> Column:
    """Start and nodes of a walk's line, first occurrences in order; null for other lines and walks shorter than two."""
    parts = F.split(strip(line), "##@@B")
    start = strip(F.replace(parts[0], F.lit(WALK_PREFIX), F.lit("")))
    nodes = F.filter(F.transform(F.split(F.get(parts, F.lit(1)), "##"), strip), lambda x: x != "")
    found = F.array_distinct(F.filter(F.concat(F.array(start), nodes), lambda x: x != ""))
    return F.when(strip(line).startswith(WALK_PREFIX) & (F.size(parts) >= 2) & (F.size(found) >= 2), found)
