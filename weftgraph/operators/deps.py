"""Scored prerequisite dependencies as a directed graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.config import LOCAL_EDGES, Combine
from weftgraph.operators.graph import density
from weftgraph.operators.graph_iter import labelled, strong_components
from weftgraph.storage import stored


def probability(score: Column, scores: dict[int, float] | None = None) -> Column:
    """The probability of a score; 0 for scores that have none."""
    known = F.create_map(*(F.lit(x) for k, p in (scores or Combine().scores).items() for x in (float(k), p)))
    return F.coalesce(F.element_at(known, score.cast("double")), F.lit(0.0))


def valid(src: Column, dst: Column, score: Column, scores: dict[int, float] | None = None) -> Column:
    """Both ends and a known score are there, and the ends differ."""
    known = list((scores or Combine().scores))
    return F.coalesce((src != "") & (dst != "") & (src != dst) & score.isin([float(k) for k in known]), F.lit(False))


def dependency_edges(records: DataFrame, config: Combine = Combine()) -> DataFrame:
    """(src, dst, prob, score, reason) from records (line_index, dependencies); of a repeated pair the last one counts."""
    each = records.select("line_index", F.posexplode("dependencies").alias("pos", "d")).select("line_index", "pos", F.col("d.from").alias("src"), F.col("d.to").alias("dst"), F.col("d.score").alias("score"), F.col("d.reason").alias("reason"))
    kept = each.where(valid(F.col("src"), F.col("dst"), F.col("score"), config.scores)).withColumn("prob", probability(F.col("score"), config.scores)).where(F.col("prob") >= config.least_probability)
    last = F.max_by(F.struct("prob", "score", "reason"), F.struct("line_index", "pos"))
    return kept.groupBy("src", "dst").agg(last.alias("_v")).select("src", "dst", "_v.prob", "_v.score", "_v.reason")


def node_pool(records: DataFrame) -> DataFrame:
    """(name): every listed name, with or without a dependency."""
    return records.select(F.explode("knowledge_points").alias("name")).distinct()


def successors(edges: DataFrame, names: DataFrame) -> DataFrame:
    return edges.join(names.select(F.col("name").alias("src")), "src", "left_semi").select("src", "dst", "prob")


def predecessors(edges: DataFrame, names: DataFrame) -> DataFrame:
    return edges.join(names.select(F.col("name").alias("dst")), "dst", "left_semi").select("src", "dst", "prob")


def probabilities(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (src, dst, ...) with prob; 0 where there is no dependency."""
    return pairs.join(edges.select("src", "dst", "prob"), ["src", "dst"], "left").withColumn("prob", F.coalesce("prob", F.lit(0.0)))


def best_bridges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, bridge, p): for pairs (src, dst) the node between them with the greatest product of probabilities; ties by name.

    A pair looks for its bridges from the end with fewer edges, so a hub costs its neighbours' edges, not the square of its own.
    """
    edges = stored(edges.select("src", "dst", "prob"), "arcs")
    a = edges.select("src", F.col("dst").alias("bridge"), F.col("prob").alias("p1"))
    b = edges.select(F.col("src").alias("bridge"), "dst", F.col("prob").alias("p2"))
    out, into = edges.groupBy("src").agg(F.count("*").alias("_out")), edges.groupBy("dst").agg(F.count("*").alias("_in"))
    sized = stored(pairs.select("src", "dst").join(out, "src").join(into, "dst"), "ends")
    ahead = sized.where("_out <= _in").select("src", "dst").join(a, "src").join(b, ["bridge", "dst"])
    behind = sized.where("_out > _in").select("src", "dst").join(b, "dst").join(a, ["src", "bridge"])
    both = ahead.unionByName(behind).where("bridge <> src and bridge <> dst")
    p = F.col("p1") * F.col("p2")
    return both.groupBy("src", "dst").agg(F.min_by(F.struct("bridge", p.alias("p")), F.struct((-p).alias("p"), "bridge")).alias("_b")).select("src", "dst", "_b.bridge", F.round("_b.p", 6).alias("p"))


def greedy_paths(starts: DataFrame, edges: DataFrame, steps: int = Combine.steps) -> DataFrame:
    """(start, path): from each start (name) to the successor of the greatest probability that isn't in the path, at most
    `steps` times; ties by name. Paths end where no successor is left."""
    state = starts.select(F.col("name").alias("start"), F.array("name").alias("path"))
    for _ in range(steps):
        at = state.withColumn("src", F.element_at("path", -1))
        go = at.join(edges.select("src", "dst", "prob"), "src").where(~F.array_contains("path", F.col("dst")))
        best = go.groupBy("start").agg(F.min_by("dst", F.struct((-F.col("prob")).alias("p"), "dst")).alias("_next"))
        # a path that ended stays as it is: its last node keeps having no successor
        state = state.join(best, "start", "left").select("start", F.when(F.col("_next").isNotNull(), F.concat("path", F.array("_next"))).otherwise(F.col("path")).alias("path"))
    return state


def dependency_statistics(edges: DataFrame, pool: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """One row: nodes, edges, density, pool, mean in- and out-degree, weak and strong components."""
    edges = stored(edges, "arcs")
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    weak = labelled(ids, edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), local)
    strong = strong_components(edges, ids, local)
    one = density(edges, ids, directed=True).crossJoin(pool.agg(F.count("*").alias("pool")))
    mean = F.round(F.when(F.col("nodes") > 0, F.col("edges") / F.col("nodes")), 6)
    return one.withColumns({"mean_in": mean, "mean_out": mean}).crossJoin(weak.agg(F.countDistinct("label").alias("weak"))).crossJoin(strong.agg(F.countDistinct("label").alias("strong")))
