"""Prompts from combinations: look-up of descriptions, templates, and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import clean_key, fill, plain_key

#: Templates are data; this one is the default.
TEMPLATES = {"synthesis": "Write one demanding problem whose solution needs all of these concepts: [{concepts}]. State it fully, then solve it step by step."}
EXTRACTION = 'List the concepts that the following problem relies on, as a JSON object from "1", "2", ... to "name - explanation".\n\n{text}'
DEPENDENCY = 'For the concepts below give each prerequisite as a JSON array of {"from", "to", "score", "reason"}, score 1 to 5.\n\n{points}'


def template(name: str) -> str | None:
    """A template by name; None if there is none."""
    return TEMPLATES.get(name)


def templates() -> dict[str, str]:
    """All templates; a copy."""
    return dict(TEMPLATES)


def looked_up(combos: DataFrame, dictionary: DataFrame, raw_first: bool = False) -> DataFrame:
    """combos (key, combo) as (key, pos, raw, name, description): a name is sought cleaned of backslashes, then of quotes; with
    raw_first as it is before that. description is null where nothing is found."""
    each = combos.select("key", F.posexplode("combo").alias("pos", "raw"))
    tries = ([F.col("raw")] if raw_first else []) + [plain_key(F.col("raw")), clean_key(F.col("raw"))]
    found = each.withColumn("_tries", F.array_distinct(F.array(*tries))).select("key", "pos", "raw", F.posexplode("_tries").alias("_n", "name"))
    hit = found.join(dictionary.select("name", "description"), "name", "left")
    best = F.min_by(F.struct("name", "description"), F.struct(F.col("description").isNull(), "_n"))
    return hit.groupBy("key", "pos", "raw").agg(best.alias("_b")).select("key", "pos", "raw", "_b.name", "_b.description")


def prompt_rows(combos: DataFrame, dictionary: DataFrame, templates: dict[str, str] | None = None, base: str = "combinations", raw_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, method, prompt) of combinations all of whose names are known, one for each template; and (key, combo, missing,
    missing_count) of the others. key numbers the combinations from 1."""
    each = looked_up(combos, dictionary, raw_first)
    text = F.concat("name", F.lit(" - "), "description")
    lists = each.groupBy("key").agg(
        F.bool_and(F.col("description").isNotNull()).alias("_all"),
        F.sort_array(F.collect_list(F.struct("pos", "raw", text.alias("text"), F.col("description").isNull().alias("gone")))).alias("_l"),
    )
    joined = F.array_join(F.transform("_l", lambda x: x["text"]), "] and [")
    made = F.array(*(F.struct(F.lit(k).alias("method"), fill(t, concepts=joined).alias("prompt")) for k, t in (templates or TEMPLATES).items()))
    good = lists.where("_all").select(F.format_string(f"{base}_line_%07d", "key").alias("doc_id"), F.explode(made).alias("_p")).select("doc_id", "_p.*")
    missing = F.transform(F.filter("_l", lambda x: x["gone"]), lambda x: x["raw"])
    bad = lists.where(~F.col("_all")).select("key", F.transform("_l", lambda x: x["raw"]).alias("combo"), missing.alias("missing"), F.size(missing).alias("missing_count"))
    return good, bad


def prompt_totals(good: DataFrame, bad: DataFrame) -> DataFrame:
    """One row: prompts, combinations missing a name, and the share of combinations that became prompts in percent."""
    one = good.agg(F.count("*").alias("prompts"), F.countDistinct("doc_id").alias("combos")).crossJoin(bad.agg(F.count("*").alias("missing")))
    return one.withColumn("ok_percent", F.round(F.when(F.col("combos") + F.col("missing") > 0, 100.0 * F.col("combos") / (F.col("combos") + F.col("missing"))), 6))
