"""Iterative graph operators as loops over stored tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.config import LOCAL_EDGES
from weftgraph.operators.compact import MOST_BYTES, compact, reached
from weftgraph.operators.compact import distances as compact_distances
from weftgraph.storage import stored


def roots(pairs: list[tuple]) -> dict:
    """Each end's smallest id in its component."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def strong_roots(arcs: list[tuple], ids: list) -> dict:
    """Each id's smallest id in its strongly connected component: one depth-first pass with an explicit stack."""
    out: dict = {}
    near: dict = {x: [] for x in ids}
    for a, b in arcs:
        near[a].append(b)
    found, low, open_, path = {}, {}, set(), []
    for start in ids:
        if start in found:
            continue
        found[start] = low[start] = len(found)
        open_.add(start)
        path.append(start)
        stack = [(start, iter(near[start]))]
        while stack:
            x, rest = stack[-1]
            y = next(rest, None)
            if y is None:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[x])
                if low[x] == found[x]:
                    own = []
                    while not own or own[-1] != x:
                        own.append(path.pop())
                        open_.discard(own[-1])
                    out.update(dict.fromkeys(own, min(own)))
            elif y not in found:
                found[y] = low[y] = len(found)
                open_.add(y)
                path.append(y)
                stack.append((y, iter(near[y])))
            elif y in open_:
                low[x] = min(low[x], found[y])
    return out


def connected_components(links: DataFrame, local: int = 0) -> DataFrame:
    """(id, label): the smallest id reachable by links (a, b), for all ids in links between different ids.

    Large-star and small-star steps: a number of rounds that grows with the logarithm of the longest chain, and no task
    holds a node's neighbours, as each step joins them to a pre-aggregated minimum. Up to `local` edges one task does it.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    size = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = size(edges)
    if before[0] <= local:
        return in_one_task(edges.select("u", "v"), roots)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        smaller = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stored(smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = size(edges)
        if now == before:
            break
        before = now
    tops = edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(tops)


def in_one_task(pairs: DataFrame, solve) -> DataFrame:
    """(id, label) that solve makes of pairs, of two columns, whose number was checked; the driver doesn't see them."""
    kind = pairs.schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = solve([p for b in batches for p in zip(*(b[c].tolist() for c in b.columns), strict=True)])
        yield pd.DataFrame({"id": list(found), "label": list(found.values())}, dtype=object if kind == "string" else None)

    return pairs.coalesce(1).mapInPandas(run, f"id {kind}, label {kind}") if pairs.limit(1).count() else pairs.toDF("id", "label")


def labelled(ids: DataFrame, links: DataFrame, local: int = 0) -> DataFrame:
    """(id, label) of all ids: those without links are their own label."""
    return ids.select("id").join(connected_components(links, local), "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def hops(edges: DataFrame, starts: DataFrame, most: int | None = None, symmetric: bool = False) -> DataFrame:
    """(src, node, dist) of directed edges (src, dst): breadth-first from every start (id), to a depth or to the end. symmetric: every
    edge is there both ways, so that a step can only lead back to the last two levels."""
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("_to")).distinct()
    seen = stored(starts.select(F.col("id").alias("src"), F.col("id").alias("node"), F.lit(0).alias("dist")).distinct(), "hops")
    edge, parts, n = seen, [seen], 0
    while most is None or n < most:
        n += 1
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        if symmetric and n > 1:
            known = parts[-2].unionByName(parts[-1])
        new = edge.join(step, "node").select("src", F.col("_to").alias("node")).distinct().join(known.select("src", "node"), ["src", "node"], "left_anti")
        edge = stored(new.withColumn("dist", F.lit(n)).select("src", "node", "dist"), "hops")
        if edge.isEmpty():
            break
        parts.append(edge)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distances(edges: DataFrame, starts: DataFrame, depth: int | None = None, symmetric: bool = False, most: int = MOST_BYTES) -> DataFrame:
    """What hops() returns, from bit sets where the graph may be broadcast (`most` bytes)."""
    spark, kind = edges.sparkSession, dict(starts.dtypes)["id"]
    shipped = compact(edges, starts, most=most, once=True)
    return compact_distances(spark, shipped, kind, depth) if shipped else hops(edges, starts, depth, symmetric)


def eccentricity(edges: DataFrame, starts: DataFrame, symmetric: bool = False, depth: int | None = None, most: int = MOST_BYTES) -> DataFrame:
    """(id, eccentricity, reached, total): the greatest distance from a node, how many it reaches, and the sum of distances; up to a
    depth, if one is given. Counted on bit sets where the graph may be broadcast (`most` bytes), else over the rows of hops()."""
    spark, kind = edges.sparkSession, dict(starts.dtypes)["id"]
    shipped = compact(edges, starts, most=most, once=True)
    if shipped:
        return reached(spark, shipped, kind, depth)
    rows = hops(edges, starts, depth, symmetric).groupBy(F.col("src").alias("id"))
    return rows.agg(F.max("dist").cast("long").alias("eccentricity"), F.count("*").alias("reached"), F.sum("dist").cast("long").alias("total"))


def strong_components(edges: DataFrame, ids: DataFrame, local: int = 0) -> DataFrame:
    """(id, label) of strongly connected components of directed edges (src, dst): label is the smallest id in it.

    Forward-backward colouring: nodes without a way in or out are trimmed as their own components; then every node takes the
    smallest id that reaches it as colour, and what reaches its colour's root within the colour is the root's component.
    Up to `local` edges and ids one task does it.
    """
    done, left = [], stored(ids.select("id").distinct(), "left")
    arcs = stored(edges.select("src", "dst").where("src <> dst").distinct(), "arcs")
    if local and arcs.count() + left.count() <= local:
        loops = left.select(F.col("id").alias("src"), F.col("id").alias("dst"))
        return in_one_task(arcs.unionByName(loops), lambda pairs: strong_roots([p for p in pairs if p[0] != p[1]], [a for a, b in pairs if a == b]))
    while not left.isEmpty():
        ends = arcs.select(F.col("src").alias("id")).intersect(arcs.select(F.col("dst").alias("id")))
        trimmed = left.join(ends, "id", "left_anti")
        if not trimmed.isEmpty():
            done.append(stored(trimmed.select("id", F.col("id").alias("label")), "trimmed"))
            left = stored(left.join(ends, "id", "left_semi"), "left")
            arcs = stored(arcs.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"), "arcs")
            continue
        colour = stored(spread(left.select("id", F.col("id").alias("c")), arcs), "colour")
        inside = arcs.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        back = stored(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "back")
        roots = colour.where("id = c").select("id")
        found = hops(back, roots).select(F.col("node").alias("id"), F.col("src").alias("label"))
        found = stored(found, "strong")
        done.append(found)
        left = stored(left.join(found, "id", "left_anti"), "left")
        arcs = stored(arcs.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"), "arcs")
    out = done[0] if done else ids.select("id", F.col("id").alias("label"))
    for p in done[1:]:
        out = out.unionByName(p)
    return out


def spread(state: DataFrame, arcs: DataFrame) -> DataFrame:
    """Each node's smallest c among itself and all that reach it, by rounds of minima over arcs."""
    state = stored(state, "spread")
    while True:
        came = arcs.join(state.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("_m"))
        new = stored(state.join(came, "id", "left").select("id", F.least("c", "_m").alias("c"), (F.col("_m") < F.col("c")).alias("_less")), "spread")
        if not new.where("_less").limit(1).count():
            return new.select("id", "c")
        state = new.select("id", "c")


def component_sizes(ids: DataFrame, links: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(label, n) of the components of all ids, those without links included."""
    return labelled(ids, links, local).groupBy("label").agg(F.count("*").alias("n"))


def distance_profile(edges: DataFrame, ids: DataFrame, below: int | None = 5000) -> DataFrame:
    """One row: nodes, components, largest component, and of a connected graph diameter, radius and mean distance; null when it
    isn't connected, or has `below` nodes or more, as all distances are quadratic in the nodes (None: always told). edges: (u, v)."""
    sizes = stored(component_sizes(ids, edges.select(F.col("u").alias("a"), F.col("v").alias("b"))), "sizes")
    one = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("nodes"), F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))
    nodes, parts, _ = one.first()
    empty = F.lit(None)
    if parts != 1 or below is not None and nodes >= below:
        return one.withColumns({"diameter": empty.cast("long"), "radius": empty.cast("long"), "mean_distance": empty.cast("double")})
    ways = edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst")))
    far = eccentricity(ways, ids, symmetric=True).agg(F.max("eccentricity").alias("diameter"), F.min("eccentricity").alias("radius"), F.round(F.sum("total") / (F.count("*") * (F.count("*") - 1)), 6).alias("mean_distance"))
    return one.crossJoin(far)
