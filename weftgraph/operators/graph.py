"""Weighted concept graphs as edge and node tables: building, degrees, supernodes, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.config import Graph
from weftgraph.operators.meet import met


def weighted_edges(lines: DataFrame, config: Graph = Graph()) -> DataFrame:
    """(u, v, weight, occurrences): undirected edges; weights are put to a logarithm before repeats are summed."""
    weight = F.log1p(F.col("w").cast("double")) if config.log_weights else F.col("w").cast("double")
    kept = lines.where(F.col("w") >= config.least_weight)
    return kept.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum(weight).alias("weight"), F.count("*").alias("occurrences"))


def repeated_edges(lines: DataFrame) -> DataFrame:
    """(u, v, occurrences, total, positions) of edges that occur more than once; lines has a column pos."""
    return lines.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(
        F.count("*").alias("occurrences"), F.sum("w").alias("total"), F.sort_array(F.collect_list("pos")).alias("positions")
    ).where("occurrences > 1")


def nodes(edges: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """(id, representative, is_representative, cluster_size) of all endpoints; names without a mapping stand for themselves."""
    ids = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    if mapping is None:
        return ids.select("id", F.col("id").alias("representative"), F.lit(True).alias("is_representative"), F.lit(1).cast("long").alias("cluster_size"))
    sizes = mapping.groupBy("representative").agg(F.count("*").alias("cluster_size"))
    named = ids.join(mapping.withColumnRenamed("name", "id"), "id", "left").withColumn("representative", F.coalesce("representative", "id"))
    return named.join(sizes, "representative", "left").select("id", "representative", (F.col("id") == F.col("representative")).alias("is_representative"), F.coalesce("cluster_size", F.lit(1)).alias("cluster_size"))


def degrees(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, degree); an edge from a node to itself counts twice. ids: nodes without an edge get 0."""
    own = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return own if ids is None else ids.select("id").join(own, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def statistics(df: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, population deviation, least, greatest and interpolated median."""
    x = F.col(value).cast("double")
    return df.agg(F.count(value).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"), F.min(x).alias("least"), F.max(x).alias("greatest"), F.round(F.percentile(x, 0.5), 6).alias("median"))


def supernodes(degree: DataFrame, factor: float = Graph.supernode_factor) -> DataFrame:
    """(id, degree) of nodes whose degree is over mean + factor * population deviation."""
    limit = degree.agg((F.avg("degree") + factor * F.stddev_pop("degree")).alias("_limit"))
    return degree.crossJoin(F.broadcast(limit)).where(F.col("degree") > F.col("_limit")).select("id", "degree")


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges none of whose ends is in gone (id). Few nodes can be far over the mean: one in factor ** 2 at most (Chebyshev)."""
    return edges.join(gone.select(F.col("id").alias("u")), "u", "left_anti").join(gone.select(F.col("id").alias("v")), "v", "left_anti").select(*edges.columns)


def density(edges: DataFrame, ids: DataFrame, directed: bool = False) -> DataFrame:
    """One row: nodes, edges, density; 0 with fewer than two nodes."""
    n, m = F.col("nodes").cast("double"), F.col("edges")
    both = ids.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))
    return both.withColumn("density", F.round(F.when(n > 1, (1 if directed else 2) * m / (n * (n - 1))).otherwise(0.0), 9))


def degree_centrality(degree: DataFrame) -> DataFrame:
    """(id, centrality): degree over nodes - 1."""
    n = degree.agg(F.count("*").alias("_n"))
    return degree.crossJoin(F.broadcast(n)).select("id", F.round(F.when(F.col("_n") > 1, F.col("degree") / (F.col("_n") - 1)).otherwise(0.0), 6).alias("centrality"))


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    """(src, dst) of undirected edges in both directions; loops once."""
    one = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), *more)
    return one.unionByName(edges.where("u <> v").select(F.col("v").alias("src"), F.col("u").alias("dst"), *more))


def diverse_weights(edges: DataFrame, beta: float = 1.0, epsilon: float = 1e-6) -> DataFrame:
    """(src, dst, p): weight / (ln(1 + degree of dst) ** beta + epsilon), as shares of each src."""
    degree = degrees(edges)
    raw = both_ways(edges, "weight").join(degree.withColumnRenamed("id", "dst"), "dst")
    raw = raw.withColumn("_w", F.col("weight") / (F.pow(F.log1p(F.col("degree").cast("double")), F.lit(beta)) + epsilon))
    total = raw.groupBy("src").agg(F.sum("_w").alias("_all"), F.count("*").alias("_n"))
    share = F.when(F.col("_all") > 0, F.col("_w") / F.col("_all")).otherwise(1 / F.col("_n"))
    return raw.join(total, "src").select("src", "dst", F.round(share, 9).alias("p"))


def path_weights(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, weights): of paths (path, pos, node) the weight of each step's edge, 0.0 where there is none, in order."""
    step = paths.withColumn("_next", F.lead("node").over(W.partitionBy("path").orderBy("pos"))).where(F.col("_next").isNotNull())
    named = step.select("path", "pos", F.least("node", "_next").alias("u"), F.greatest("node", "_next").alias("v"))
    known = named.join(edges.select("u", "v", "weight"), ["u", "v"], "left")
    return known.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("weight", F.lit(0.0)).alias("w")))), lambda x: x["w"]).alias("weights"))


def path_quality(paths: DataFrame) -> DataFrame:
    """One row over paths (path, node), distinct nodes: paths, mean, population deviation, least and greatest length, distinct nodes, mean and
    deviation of the Jaccard similarity of all pairs of paths, diversity. Pairs that share no node are counted, not made."""
    sizes = paths.groupBy("path").agg(F.count("*").alias("n"))
    common = overlaps(paths)
    j = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    sums = common.select(j.alias("j")).agg(F.coalesce(F.sum("j"), F.lit(0.0)).alias("_s"), F.coalesce(F.sum(F.col("j") * F.col("j")), F.lit(0.0)).alias("_q"))
    one = sizes.agg(F.count("*").alias("paths"), F.round(F.avg("n"), 6).alias("mean_length"), F.round(F.stddev_pop("n"), 6).alias("std_length"), F.min("n").alias("least_length"), F.max("n").alias("greatest_length"))
    all_pairs = F.col("paths") * (F.col("paths") - 1) / 2
    mean = F.when(all_pairs > 0, F.col("_s") / all_pairs).otherwise(0.0)
    spread = F.when(all_pairs > 0, F.sqrt(F.greatest(F.col("_q") / all_pairs - mean * mean, F.lit(0.0)))).otherwise(0.0)
    return one.crossJoin(paths.agg(F.countDistinct("node").alias("nodes"))).crossJoin(sums).select(
        *one.columns, "nodes", F.round(mean, 6).alias("mean_jaccard"), F.round(spread, 6).alias("std_jaccard"), F.round(1 - mean, 6).alias("diversity")
    )


def overlaps(paths: DataFrame) -> DataFrame:
    """(a, b, both, na, nb), a < b, of paths that share a node. A node of many paths is dealt to many tasks."""
    sizes = paths.groupBy("path").agg(F.count("*").alias("n"))
    both = met(paths, "node", "path").groupBy("a", "b").agg(F.count("*").alias("both"))
    return both.join(sizes.select(F.col("path").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("path").alias("b"), F.col("n").alias("nb")), "b")


def length_histogram(paths: DataFrame) -> DataFrame:
    """(length, n): how many paths (path, node) have so many nodes."""
    return paths.groupBy("path").agg(F.count("*").alias("length")).groupBy("length").agg(F.count("*").alias("n"))


def busiest_nodes(paths: DataFrame, n: int = 10) -> DataFrame:
    """(node, paths) of the n nodes that most paths hold; ties by node."""
    return paths.groupBy("node").agg(F.count("*").alias("paths")).orderBy(F.desc("paths"), "node").limit(n)


def coverage(paths: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: nodes in paths, all nodes (id), their share, and mean nodes of a path."""
    one = paths.agg(F.countDistinct("node").alias("covered"), F.round(F.count("*") / F.countDistinct("path"), 6).alias("nodes_per_path"))
    share = F.round(F.when(F.col("nodes") > 0, F.col("covered") / F.col("nodes")).otherwise(0.0), 6)
    return one.crossJoin(ids.agg(F.countDistinct("id").alias("nodes"))).withColumn("share", share)


def step_weights(paths: DataFrame) -> DataFrame:
    """One row over the step weights of path_weights(), steps without an edge left out: count, mean, population deviation, least, greatest."""
    return statistics(paths.select(F.explode("weights").alias("w")).where("w <> 0"), "w").drop("median")


def step_weight_histogram(paths: DataFrame) -> DataFrame:
    """(w, n): step weights at two decimals, halves to even."""
    return paths.select(F.explode("weights").alias("w")).where("w <> 0").groupBy(F.bround("w", 2).alias("w")).agg(F.count("*").alias("n"))
