"""Co-occurrence within groups, and its aggregation on to cluster representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.meet import met
from weftgraph.operators.ranking import at_shares
from weftgraph.storage import stored


def initial(groups: DataFrame, group: str, name: str) -> DataFrame:
    """(u, v, w), u <= v: how many pairs of places of a group hold the two names, over all groups.

    A name m times in a group meets another n times m * n times, and itself m * (m - 1) / 2 times; so rows are counted by
    (group, name) before the pairs are made. Large groups are dealt to many tasks.
    """
    rows = groups.where(F.col(group).isNotNull() & F.col(name).isNotNull()).select(F.col(group).alias("g"), F.col(name).alias("x"))
    counts = rows.groupBy("g", "x").agg(F.count("*").alias("n"))
    pairs = met(counts, "g", "x", "n").select(F.col("a").alias("u"), F.col("b").alias("v"), (F.col("a_n") * F.col("b_n")).alias("w"))
    selves = counts.where("n > 1").select(F.col("x").alias("u"), F.col("x").alias("v"), F.expr("n * (n - 1) div 2").alias("w"))
    return pairs.unionByName(selves).groupBy("u", "v").agg(F.sum("w").cast("long").alias("w"))


def aggregated(pairs: DataFrame, mapping: DataFrame, drop_self: bool = False) -> DataFrame:
    """Pairs with names replaced by representatives (mapping: name, representative; others stand for themselves). Pairs that
    become a representative with itself go; those that were one before stay, unless drop_self."""
    one = mapping.select(F.col("name").alias("u"), F.col("representative").alias("_ru"))
    two = mapping.select(F.col("name").alias("v"), F.col("representative").alias("_rv"))
    moved = pairs.join(one, "u", "left").join(two, "v", "left").withColumns({"_ru": F.coalesce("_ru", "u"), "_rv": F.coalesce("_rv", "v")})
    became = (F.col("_ru") == F.col("_rv")) & ((F.col("u") != F.col("_ru")) | (F.col("v") != F.col("_rv")) | F.lit(drop_self))
    return moved.where(~became).groupBy(F.least("_ru", "_rv").alias("u"), F.greatest("_ru", "_rv").alias("v")).agg(F.sum("w").cast("long").alias("w"))


def aggregation_counters(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row of what aggregated() does: pairs transferred and their weight, pairs created (none had the name before), modified (one
    had, and gains), deleted (their names are gone), and loops removed."""
    one = mapping.select(F.col("name").alias("u"), F.col("representative").alias("_ru"))
    two = mapping.select(F.col("name").alias("v"), F.col("representative").alias("_rv"))
    moved = pairs.join(one, "u", "left").join(two, "v", "left").withColumns({"_ru": F.coalesce("_ru", "u"), "_rv": F.coalesce("_rv", "v")})
    moved = moved.where((F.col("u") != F.col("_ru")) | (F.col("v") != F.col("_rv")))
    loop = F.col("_ru") == F.col("_rv")
    counts = moved.agg(
        F.count_if(~loop).alias("transferred"), F.coalesce(F.sum(F.when(~loop, F.col("w"))), F.lit(0)).cast("long").alias("weight_transferred"),
        F.count("*").alias("deleted"), F.count_if(loop).alias("loops_removed"),
    )
    targets = moved.where(~loop).select(F.least("_ru", "_rv").alias("u"), F.greatest("_ru", "_rv").alias("v")).distinct()
    hit = targets.join(pairs.select("u", "v", F.lit(1).alias("_had")), ["u", "v"], "left")
    return counts.crossJoin(hit.agg(F.count_if(F.col("_had").isNull()).alias("created"), F.count_if(F.col("_had").isNotNull()).alias("modified")))


def distribution(pairs: DataFrame) -> DataFrame:
    """One row: pairs, total, mean, least and greatest weight, names, and the weights at places n/2, 0.9 n and 0.95 n."""
    pairs = stored(pairs, "pairs")
    sums = pairs.agg(F.count("*").alias("pairs"), F.sum("w").cast("long").alias("total"), F.round(F.avg("w"), 6).alias("mean"), F.min("w").alias("least"), F.max("w").alias("greatest"))
    names = pairs.select(F.explode(F.array("u", "v")).alias("x")).agg(F.countDistinct("x").alias("names"))
    return sums.crossJoin(names).crossJoin(at_shares(pairs, "w", p50=0.5, p90=0.9, p95=0.95))


def impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: pairs, weight and names before and after clustering, and the drop of pairs in percent."""
    one = lambda p, s: p.agg(F.count("*").alias(f"pairs_{s}"), F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias(f"total_{s}"))
    both = one(before, "before").crossJoin(one(after, "after"))
    return both.withColumn("pairs_drop_percent", F.round(F.when(F.col("pairs_before") > 0, 100.0 * (F.col("pairs_before") - F.col("pairs_after")) / F.col("pairs_before")), 6))


def inverse(mapping: DataFrame) -> DataFrame:
    """(representative, members, size) of representatives with more than one name."""
    return mapping.groupBy("representative").agg(F.sort_array(F.collect_list("name")).alias("members"), F.count("*").alias("size")).where("size > 1")


def ordered_pairs(df: DataFrame, group: str, pos: str, name: str) -> DataFrame:
    """(group, first, second) for every two places of a group, the earlier first; repeats stay."""
    a = df.select(F.col(group).alias("g"), F.col(pos).alias("_p"), F.col(name).alias("first"))
    b = df.select(F.col(group).alias("g"), F.col(pos).alias("_q"), F.col(name).alias("second"))
    return a.join(b, "g").where("_p < _q").select("g", "first", "second")


def mapping_statistics(mapping: DataFrame) -> DataFrame:
    """One row: names, representatives, names that moved, and the reduction in percent."""
    one = mapping.agg(F.count("*").alias("names"), F.countDistinct("representative").alias("representatives"), F.count_if(F.col("name") != F.col("representative")).alias("moved"))
    return one.withColumn("reduction_percent", F.round(F.when(F.col("names") > 0, 100.0 * (F.col("names") - F.col("representatives")) / F.col("names")), 6))


def mapping_sizes(mapping: DataFrame) -> DataFrame:
    """(size, n): how many representatives stand for so many names."""
    return mapping.groupBy("representative").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
