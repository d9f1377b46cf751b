"""Clusters of similar names: cosine similarity above a threshold, and connected components of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.config import LOCAL_EDGES, Clustering
from weftgraph.functions.text import description_of
from weftgraph.operators.graph_iter import connected_components
from weftgraph.operators.ranking import indexed


def unit(vectors: pa.ListArray) -> np.ndarray:
    """The vectors as doubles of length one; a zero vector stays."""
    size = set(vectors.value_lengths().to_pylist())
    if len(size) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(size)}")
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    square = np.zeros(len(v))
    for x in v.T:
        square += x * x
    norm = np.sqrt(square)[:, None]
    return np.divide(v, norm, out=v, where=norm > 0)


#: Rows of one product at a time, which bounds a task's memory beside its two blocks.
STRIP = 1024


def dealt_blocks(df: DataFrame, key: str, vector: str, block: int) -> tuple[DataFrame, int]:
    """(id, vec, _b, _t): vectors, dealt to blocks of at most about `block` rows, once for each task (two blocks) that
    they meet in; and the number of blocks. Few vectors still give a few tasks."""
    kept = df.where(F.col(vector).isNotNull())
    rows = kept.count()
    blocks = max(1, -(-rows // block), min(4, -(-rows // 256)))
    own = kept.select(F.col(key).alias("id"), F.col(vector).alias("vec")).withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    dealt = own.select("id", "vec", "_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_o"))
    return dealt.withColumn("_t", F.least("_b", "_o") * blocks + F.greatest("_b", "_o")).drop("_o"), blocks


def strips(t: pa.Table, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a task's two blocks: places of some rows, places of others, and their cosines; each two rows once, a row never with itself."""
    task, side = int(t.column("_t")[0].as_py()), np.array(t.column("_b"))
    low, high = divmod(task, blocks)
    v = unit(t.column("vec").combine_chunks())
    i, j = np.flatnonzero(side == low), np.flatnonzero(side == high)
    across = v[j].T
    for at in range(0, len(i), STRIP):
        own, skip = i[at : at + STRIP], at if low == high else 0
        sims = v[own] @ across[:, skip:]
        if low == high:
            sims[:, : len(own)][np.tril_indices(len(own))] = -2.0
        yield own, j[skip:], sims


def similar_pairs(df: DataFrame, least: float, key: str = "id", vector: str = "vec", block: int = Clustering.block) -> DataFrame:
    """(a, b, sim), a < b, of vectors whose cosine is over least.

    Vectors are dealt to blocks and every two blocks meet in one task, which multiplies them strip by strip: a vector is copied
    once for each block, n / block times, and no pair below the threshold leaves a task.
    """
    dealt, blocks = dealt_blocks(df, key, vector, block)
    kind = dict(df.dtypes)[key]

    def products(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(ids[:0], ids[:0], np.empty(0))]
        for own, others, sims in strips(t, blocks):
            x, y = np.divmod(np.flatnonzero(sims > least), max(1, len(others)))
            a, b = ids[own[x]], ids[others[y]]
            out.append((np.where(a < b, a, b), np.where(a < b, b, a), sims[x, y]))
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True))
        names = t.schema.field("id").type
        return pa.table({"a": pa.array(a, names), "b": pa.array(b, names), "sim": s})

    return dealt.groupBy("_t").applyInArrow(products, f"a {kind}, b {kind}, sim double")


def similarity_profile(df: DataFrame, cuts: tuple[float, ...] = Clustering.cuts, key: str = "id", vector: str = "vec", block: int = Clustering.block) -> DataFrame:
    """One row over all pairs with a positive cosine: count, mean, population deviation, least, greatest, and how many are over
    each cut. Tasks return sums, not pairs."""
    dealt, blocks = dealt_blocks(df, key, vector, block)
    kinds = pa.schema([("n", pa.int64()), ("s", pa.float64()), ("q", pa.float64()), ("lo", pa.float64()), ("hi", pa.float64()), ("over", pa.list_(pa.int64()))])

    def sums(t: pa.Table) -> pa.Table:
        rows = []
        for _, _, sims in strips(t, blocks):
            x = sims[sims > 0]
            rows.append({"n": len(x), "s": float(x.sum()), "q": float((x * x).sum()), "lo": float(x.min()) if len(x) else None, "hi": float(x.max()) if len(x) else None, "over": [int((x > c).sum()) for c in cuts]})
        return pa.Table.from_pylist(rows, kinds)

    each = dealt.groupBy("_t").applyInArrow(sums, "n long, s double, q double, lo double, hi double, over array<long>")
    n = F.sum("n")
    over = [F.sum(F.col("over")[i]).cast("long").alias(f"over_{round(c * 100)}") for i, c in enumerate(cuts)]
    mean = F.sum("s") / n
    return each.agg(n.cast("long").alias("positive"), F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.sum("q") / n - mean * mean, F.lit(0.0))), 6).alias("std"), F.round(F.min("lo"), 6).alias("least"), F.round(F.max("hi"), 6).alias("greatest"), *over)


def name_index(df: DataFrame, name: str) -> DataFrame:
    """(idx, name): the distinct names numbered in order."""
    return indexed(df.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct(), "name").select("idx", "name")


def clusters(pairs: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(id, cluster): ids with a similar one; a cluster is named by its smallest id."""
    return connected_components(pairs.select("a", "b"), local).select("id", F.col("label").alias("cluster"))


def cluster_records(found: DataFrame, names: DataFrame) -> DataFrame:
    """(main_index, main_name, main_description, indices, members, descriptions): a record for each cluster; names: (id, name). A
    description is what follows ` - ` in a name, empty if nothing does."""
    named = found.join(names, "id").withColumn("_d", description_of(F.col("name")))
    ordered = F.sort_array(F.collect_list(F.struct("id", "name", "_d")))
    return named.groupBy(F.col("cluster").alias("main_index")).agg(ordered.alias("_m")).select(
        "main_index", F.col("_m")[0]["name"].alias("main_name"), F.col("_m")[0]["_d"].alias("main_description"),
        F.col("_m.id").alias("indices"), F.col("_m.name").alias("members"), F.col("_m._d").alias("descriptions"),
    )


def cluster_summary(found: DataFrame, total: DataFrame) -> DataFrame:
    """One row: clusters, clustered and single points, largest cluster, points after clustering, compression ratio. total: all ids."""
    sizes = found.groupBy("cluster").agg(F.count("*").alias("n"))
    one = sizes.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("clustered"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    both = one.crossJoin(total.agg(F.count("*").alias("_all")))
    return both.select("clusters", "clustered", "largest", (F.col("_all") - F.col("clustered")).alias("singles"), (F.col("_all") - F.col("clustered") + F.col("clusters")).alias("points_after"), F.round(F.when(F.col("clusters") > 0, F.col("clustered") / F.col("clusters")), 6).alias("compression"))


def name_mapping(found: DataFrame, names: DataFrame) -> DataFrame:
    """(name, representative) of every name; by name, not by position. Names outside clusters stand for themselves."""
    main = names.select(F.col("id").alias("cluster"), F.col("name").alias("representative"))
    return names.join(found, "id", "left").join(main, "cluster", "left").select("name", F.coalesce("representative", "name").alias("representative"))
