"""Pairs of a group's members, with hot groups dealt to many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a group that meet in one task; larger groups are cut into blocks of this size, and every two blocks meet in a task.
BLOCK = 1000


def met(rows: DataFrame, group: str, member: str, *more: str, block: int = BLOCK) -> DataFrame:
    """(g, a, b, a_x, b_x for each x of more) for every two members a < b of a group. rows: distinct (group, member).

    Groups of up to `block` members meet under one key; a larger one under a key for each two of its blocks, where members of two
    different blocks meet once, and members of one block only in that block's own key.
    """
    own = rows.select(F.col(group).alias("g"), F.col(member).alias("x"), *more)
    large = own.groupBy("g").agg(F.count("*").alias("_n")).where(F.col("_n") > block).select("g", F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    dealt = own.join(large, "g", "left").withColumn("_at", F.when(F.col("_blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("x"), F.col("_blocks"))).cast("int"))
    keyed = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1)))
    keyed = keyed.select("g", F.least("_at", "_o").alias("_i"), F.greatest("_at", "_o").alias("_j"), "_at", "x", *more)
    side = lambda n: keyed.select("g", "_i", "_j", F.col("_at").alias(f"_at_{n}"), F.col("x").alias(n), *(F.col(c).alias(f"{n}_{c}") for c in more))
    both = side("a").join(side("b"), ["g", "_i", "_j"]).where("a < b and (_at_a <> _at_b or _i = _j)")
    return both.select("g", "a", "b", *(f"{n}_{c}" for n in "ab" for c in more))
