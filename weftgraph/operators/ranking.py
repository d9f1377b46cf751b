"""Numbers and order statistics without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.storage import stored


def indexed(df: DataFrame, *order: str, out: str = "idx") -> DataFrame:
    """df with the rows' numbers from 0 in an order. Rows are sorted by range; a task numbers its own, and the counts of the
    tasks (one number each) give where each begins."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), "indexed")
    part = F.shiftright("_at", 33)
    begins, total = [], 0
    for r in held.groupBy(part.alias("p")).count().orderBy("p").collect():
        begins += [F.lit(r["p"]), F.lit(total)]
        total += r["count"]
    begin = F.element_at(F.create_map(*begins), part) if begins else F.lit(0)
    return held.withColumn(out, (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + begin).cast("long")).drop("_at")


def histogram(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n"))


def at_shares(df: DataFrame, value: str, **shares: float) -> DataFrame:
    """One row: for each name the element at zero-based place floor(rows * share) of the sorted values. Runs on the
    histogram: rows with equal values are counted before anything is ordered, and sorted by ranges; running sums stay within
    a range, and one count a range tells where it begins."""
    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_rows")).where("_v is not null")
    held = stored(counts.repartitionByRange("_v").withColumn("_part", F.spark_partition_id()), "histogram")
    begins, total = [], 0
    for r in held.groupBy("_part").agg(F.sum("_rows").alias("n")).orderBy("_part").collect():
        begins += [F.lit(r["_part"]), F.lit(total)]
        total += r["n"]
    begin = F.element_at(F.create_map(*begins), F.col("_part")) if begins else F.lit(0)
    own = F.sum("_rows").over(W.partitionBy("_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    running = held.withColumn("_to", own + begin)
    pick = lambda q: F.min(F.when(F.col("_to") > F.floor(F.lit(total) * F.lit(q)), F.col("_v")))
    return running.agg(*(pick(q).alias(k) for k, q in shares.items()))


def hash_sample(df: DataFrame, n: int, *keys: str, seed: int = 42) -> DataFrame:
    """n rows chosen by a hash of their keys: the same rows however the data are dealt."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)
