"""Quality rules with risk-controlled thresholds (operator 10, DataFrame functions only).

Rules reject documents whose measure lies beyond a cutoff. The cutoffs come from labelled documents that are good
(quality 1): a rule's cutoffs are tried from lenient to strict in a fixed order, and each is accepted while an exact
binomial test shows, per stratum, that it rejects at most its share of alpha of the good documents. A fixed order needs no
correction among the cutoffs of one rule; over rules and strata the error rate delta is divided (Bonferroni). A stratum
with too few labels gets no cutoff: its documents are only held to the base rules.

Null texts count as empty: no words, base_failed. Null strata form one stratum. Repeated rows each give a row and each
count in the holdout; a document with several labels is good if all are. A measure equal to a cutoff is not over it. Null keys
match no label. Empty tables give no rows, and without labels there are no cutoffs. Other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import skew_join, stored, table

#: Fixed by the contract: what separates words, and the symbols that are counted.
BLANK, SYMBOLS = r"[\x20\x09-\x0D]", r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 50, 50


@dataclass(frozen=True)
class Rule:
    """measure: SQL over the counts of features(); a document is rejected when it is over a cutoff. cutoffs: lenient first."""

    name: str
    measure: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / n_words", (5.0, 2.0, 1.0, 0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05)),
    Rule("dup_lines", "n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2)),
    Rule("repeats", "n_repeat_words / n_words", (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2)),
    Rule("long_words", "word_chars / n_words", (100.0, 50.0, 30.0, 20.0, 16.0, 14.0, 12.0)),
)


@dataclass(frozen=True)
class Risk:
    """alpha: most of a stratum's good documents that all rules together may reject. delta: chance that this fails anywhere.
    broadcast: most strata whose cutoffs are broadcast; beyond it they are joined by a shuffle."""

    alpha: float = 0.02
    delta: float = 0.05
    broadcast: int = 10_000
    rules: tuple[Rule, ...] = field(default=RULES)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k), exact to rounding: the regularised incomplete beta function by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return 1 - front * h if flip else front * h


def features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every whole text.

    Each projection holds the arrays that the next one's lambdas refer to, so that none is computed once an element.
    """
    empty = F.array().cast("array<bigint>")
    split = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t")).select(
        *keep, "_t",
        F.filter(F.split("_t", BLANK + "+"), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    windows = split.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", BLANK + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") > 2, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(empty).alias("_h"),
    )
    counts = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")
    placed = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = windows.select(*keep, *counts, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), placed).alias("_o"))
    again = F.filter("_o", lambda x, i: (x["h"] == F.get("_o", i - 1)["h"]) | (x["h"] == F.get("_o", i + 1)["h"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    repeated = F.when(F.col("_o").isNull(), 0).otherwise(covered).cast("long")
    # a generated row: filters on the counts can't be pushed below it, which would compute the arrays again for each mention
    return ordered.select(*keep, F.inline(F.array(F.struct(*counts, repeated.alias("n_repeat_words")))))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, risk: Risk = Risk(), key: str = "doc_id") -> dict[str, dict[str, float]]:
    """Accepted cutoffs by stratum and rule. Sent to the driver: one row of counts for each stratum that has labels.

    measured: features() with the key as _id and a column stratum that holds no nulls.
    """
    good = labels.groupBy(F.col(key).alias("_good")).agg(F.min("quality").alias("_q")).where("_q = 1").select("_good")
    held = measured.where(~base_failed()).join(good, F.col("_id") == F.col("_good"), "left_semi")
    tries = [(r, c, F.count_if(F.expr(r.measure) > c).alias(f"{r.name}:{n}")) for r in risk.rules for n, c in enumerate(r.cutoffs)]
    rows = held.groupBy(stratum).agg(F.count("*").alias("n"), *(x for *_, x in tries)).collect()
    level = risk.delta / max(1, len(rows) * len(risk.rules))
    share = risk.alpha / len(risk.rules)
    found: dict[str, dict[str, float]] = {}
    for row in rows:
        for rule in risk.rules:
            for n, cut in enumerate(rule.cutoffs):
                if binomial_cdf(row[f"{rule.name}:{n}"], row["n"], share) > level:
                    break
                found.setdefault(row[stratum], {})[rule.name] = cut
    return found


def judging(measured: DataFrame, labels: DataFrame, risk: Risk, key: str) -> Callable[[DataFrame], DataFrame]:
    """A function that adds base_failed and kept to features(); learned from stored features with _id and _stratum."""
    name = F.coalesce(F.concat(F.lit("="), F.col("_stratum").cast("string")), F.lit("null"))
    found = cutoffs(measured.withColumn("_s", name), labels, "_s", risk, key)
    spark = measured.sparkSession
    cut = "map<string,double>"
    if len(found) <= risk.broadcast:
        literal = F.create_map(*(x for s, c in sorted(found.items()) for x in (F.lit(s), F.create_map(*(F.lit(y) for kv in sorted(c.items()) for y in kv)))))
        cuts = lambda df: df.withColumn("_cuts", F.element_at(literal, name) if found else F.lit(None).cast(cut))
    else:
        side = spark.createDataFrame(sorted(found.items()), f"_s string, _cuts {cut}")
        cuts = lambda df: skew_join(stored(df.withColumn("_s", name), "strata"), side, "_s").drop("_s")
    rejected = F.lit(False)
    for rule in risk.rules:
        rejected = rejected | F.coalesce(F.expr(rule.measure) > F.element_at("_cuts", rule.name), F.lit(False))
    return lambda df: cuts(df).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_cuts")


def measured_rows(docs: DataFrame, stratum: str, key: str, text: str, rows: bool = False) -> DataFrame:
    """features() with _id and _stratum; with rows also _row, a struct of all columns, which no name can clash with."""
    whole = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if rows else []
    named = docs.select(F.col(key).alias("_id"), F.col(stratum).alias("_stratum"), F.col(text).alias("_text"), *whole)
    return features(named, "_text", ("_id", "_stratum", *("_row" for _ in whole)))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the counts, base_failed and kept of every document."""
    measured = stored(measured_rows(docs, stratum, key, text), "quality")
    return judging(measured, labels, risk, key)(measured).withColumnRenamed("_id", key).drop("_stratum")


def kept_rows(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: Risk = Risk(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with the columns they have. Texts are measured twice rather than stored or shuffled."""
    judge = judging(stored(measured_rows(docs, stratum, key, text), "quality"), labels, risk, key)
    return judge(measured_rows(docs, stratum, key, text, rows=True)).where("kept").select("_row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
