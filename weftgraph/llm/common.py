"""Helpers shared by the training-data operators: skew-safe joins, gapless ranks and cuts of Arrow batches; stored tables come from weftgraph.storage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.storage import released, stored

__all__ = ["portions", "ranked", "released", "skew_join", "stored", "table"]

#: What a Python worker holds as objects at once: rows, and bytes of texts unless a single one is longer. Spark bounds the
#: bytes of the Arrow batches themselves (spark.sql.execution.arrow.maxBytesPerBatch).
PORTION_ROWS, PORTION_BYTES = 500, 4 << 20

#: A join key with more than this share of a side's rows is hot; at most 1 / HOT_SHARE keys can be.
HOT_SHARE = 1 / 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def portions(batches: Iterator[pa.RecordBatch], text: int, rows: int = PORTION_ROWS, size: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most so many rows, and so many bytes in the column of texts or one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < b.num_rows:
            full = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, side="right"))
            end = max(begin + 1, min(begin + rows, full))
            yield b.slice(begin, end - begin)
            begin = end


def skew_join(left: DataFrame, right: DataFrame, key: str, rows: int | None = None, how: str = "left") -> DataFrame:
    """Join left to right, which has one row a key, though one key may hold a third of left.

    Keys with over HOT_SHARE of left's rows are found by a pre-aggregated count. Fewer than 1 / HOT_SHARE keys can be
    hot, so their right rows have a proven bound and are broadcast; all other keys go through a shuffled join.
    left must be stored, as it is read three times. Null keys match nothing.
    """
    total = left.count() if rows is None else rows
    least = max(1000, int(total * HOT_SHARE))
    hot = [r[0] for r in left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > least).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.where(~is_hot).join(right.where(~is_hot), key, how)
    return cold.unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))


def ranked(df: DataFrame, key: str, spread: str, rows: int, out: str = "rank", per_task: int = 50_000) -> DataFrame:
    """Number the rows of each key from 0 without a gap, however many rows a key has.

    spread: a column whose hash deals a key's rows to buckets. Rows are numbered inside (key, bucket); a running sum over
    the buckets' counts gives where each bucket starts, so no task holds a whole key. df must be stored.
    """
    buckets = max(1, -(-rows // per_task))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)).cast("int"))
    starts = (
        dealt.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_start", F.sum("_n").over(W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)))
        .select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.coalesce("_start", F.lit(0)).alias("_start"))
    )
    inside = dealt.withColumn("_row", F.row_number().over(W.partitionBy(key, "_bucket").orderBy(spread)) - 1)
    both = inside.join(starts, (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_b")))
    return both.withColumn(out, (F.col("_row") + F.col("_start")).cast("long")).drop("_bucket", "_key", "_b", "_start", "_row")
