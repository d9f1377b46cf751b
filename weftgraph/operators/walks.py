"""Degree-penalised random walks, and betweenness: kernels over a broadcast of checked size, and rounds of joins beyond."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Mapping
from dataclasses import replace
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.config import Graph, Walk
from weftgraph.operators import graph_iter
from weftgraph.operators.compact import MOST_BYTES, STARTS, TASKS, Compact, blocks_of, compact, made, sizes
from weftgraph.operators.graph import both_ways
from weftgraph.storage import stored


def neighbourhoods(edges: DataFrame, ids: DataFrame | None = None, n: int = Walk.hops, most: int = MOST_BYTES) -> DataFrame:
    """(id, n): nodes within n hops, the node itself included; of ids, or of all ends of edges. Counted on bit sets where the graph may
    be broadcast (`most` bytes), else over the rows of all pairs."""
    shipped = compact(edges.select(F.col("u").alias("src"), F.col("v").alias("dst")), ids, most=most, once=True, both=True)
    if shipped:
        return sizes(edges.sparkSession, shipped, dict(edges.dtypes)["u"] if ids is None else dict(ids.dtypes)["id"], n)
    starts = edges.select(F.explode(F.array("u", "v")).alias("id")) if ids is None else ids
    return graph_iter.hops(both_ways(edges), starts, n, symmetric=True).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))


def gate(sizes: DataFrame, config: Walk = Walk()) -> DataFrame:
    """(id, n, action, reason): walk, take (all nodes are the path) or fail."""
    n = F.col("n")
    action = F.when(n < config.least_nodes, "fail").when(n < config.length, "take").otherwise("walk")
    return sizes.select("id", "n", action.alias("action"), F.when(n < config.least_nodes, F.concat(F.lit("Insufficient neighbors: "), n.cast("string"), F.lit(f" < {config.least_nodes}"))).alias("reason"))


class Walker:
    """Walks over some nodes' neighbours: name to (names in order, weights, how many neighbours each of them has)."""

    def __init__(self, near: Mapping[str, tuple[list[str], list[float], list[int]]], config: Walk):
        self.near, self.config = near, config

    def reach(self, start: str) -> list[str]:
        """Nodes within the hops, nearest first; only the first of them, where there are enough for a walk."""
        seen, edge = {start: 0}, deque([start])
        while edge and len(seen) < self.config.length:
            a = edge.popleft()
            if seen[a] < self.config.hops:
                for b in self.near[a][0]:
                    if b not in seen:
                        seen[b] = seen[a] + 1
                        edge.append(b)
        return list(seen)

    def pulls(self, at: str) -> np.ndarray:
        """The weights of a node's edges, less for neighbours of many."""
        c, (_, weights, degrees) = self.config, self.near[at]
        return np.array([w / (log(1 + d) ** c.beta + c.epsilon if c.degree_penalty else 1.0) for w, d in zip(weights, degrees, strict=True)])

    def free(self, at: str, chosen: set) -> tuple[np.ndarray, np.ndarray]:
        """Places of the neighbours that aren't chosen, and the pulls of their edges."""
        own = np.array([i for i, b in enumerate(self.near[at][0]) if b not in chosen], int)
        return own, self.pulls(at)[own]

    def step(self, at: str, i: int) -> tuple[str, float]:
        """A node's neighbour at a place, and the weight of the edge."""
        return self.near[at][0][i], float(self.near[at][1][i])

    def weight(self, a: str, b: str) -> float:
        return dict(zip(*self.near[a][:2], strict=True)).get(b, 0.0)

    def name(self, at: str) -> str:
        return at

    def chances(self, w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        c, total = self.config, w.sum()
        p = w / total if total > 0 else np.full(len(w), 1 / len(w))
        if c.disturb:
            p = np.maximum(p + c.level * (rng.random(len(p)) - 0.5), 0)
            total = p.sum()
            p = p / total if total > 0 else np.full(len(p), 1 / len(p))
        return p

    def failure(self, near: list) -> str | None:
        return f"Insufficient neighbors: {len(near)} < {self.config.least_nodes}" if len(near) < self.config.least_nodes else None

    def tried(self, start: str, number: int) -> tuple[list[str], list[str], str | None]:
        """What walk() returns where it fails; else no nodes, as nothing is walked."""
        return [], [], self.failure(self.reach(start))

    def walk(self, start: str, number: int) -> tuple[list[str], list[str], str | None]:
        """(nodes, step weights, reason of failure): a depth-first walk that goes back where a node has no neighbour left."""
        c, near = self.config, self.reach(start)
        if reason := self.failure(near):
            return [], [], reason
        if len(near) < c.length:
            return [self.name(x) for x in near], [repr(self.weight(a, b)) for a, b in zip(near, near[1:], strict=False)], None
        rng = np.random.default_rng([c.seed, number, *self.name(start).encode()])
        nodes, chosen, weights = [start], {start}, []
        stack = [(start, *self.free(start, chosen), None)]
        while stack and len(nodes) < c.length:
            at, free, pull, gone = stack[-1]
            if gone is not None:
                free, pull = np.delete(free, gone), np.delete(pull, gone)
            if not len(free):
                stack.pop()
                continue
            sums = self.chances(pull, rng).cumsum()
            k = int(np.searchsorted(sums / sums[-1], rng.random(), side="right"))
            stack[-1] = at, free, pull, k
            b, weight = self.step(at, int(free[k]))
            if b not in chosen:
                nodes.append(b)
                chosen.add(b)
                weights.append(repr(weight))
                if len(nodes) < c.length:
                    stack.append((b, *self.free(b, chosen), None))
        return [self.name(x) for x in nodes], weights, None


class ArrayWalker(Walker):
    """The same walks over a graph's arrays; nodes are numbers."""

    def __init__(self, g: Compact, config: Walk):
        self.g, self.config, self.degree, self.taken = g, config, np.diff(g.ptr), np.zeros(len(g.names), bool)
        self.less = np.ones(self.degree.max(initial=0) + 1)
        if config.degree_penalty:
            for d in np.unique(self.degree).tolist():
                self.less[d] = log(1 + d) ** config.beta + config.epsilon

    def ends(self, at: int) -> np.ndarray:
        return self.g.near[self.g.ptr[at] : self.g.ptr[at + 1]]

    def reach(self, start: int) -> list[int]:
        seen, edge = {start: 0}, deque([start])
        while edge and len(seen) < self.config.length:
            a = edge.popleft()
            if seen[a] < self.config.hops:
                for b in self.ends(a).tolist():
                    if b not in seen:
                        seen[b] = seen[a] + 1
                        edge.append(b)
        return list(seen)

    def free(self, at: int, chosen: set) -> tuple[np.ndarray, np.ndarray]:
        near, out = self.ends(at), list(chosen)
        self.taken[out] = True
        own = np.flatnonzero(~self.taken[near])
        self.taken[out] = False
        return own, self.g.weight[self.g.ptr[at] + own] / self.less[self.degree[near[own]]]

    def step(self, at: int, i: int) -> tuple[int, float]:
        at = self.g.ptr[at] + i
        return int(self.g.near[at]), float(self.g.weight[at])

    def weight(self, a: int, b: int) -> float:
        found = np.flatnonzero(self.ends(a) == b)
        return float(self.g.weight[self.g.ptr[a] + found[-1]]) if len(found) else 0.0

    def name(self, at: int) -> str:
        return self.g.names[at].as_py()


class Given(dict):
    """The lists that a round was given; asked: the first that it lacked."""

    class Lacks(Exception):
        pass

    def __missing__(self, name: str):
        raise self.Lacks(name)


WALKS = "start string, number int, nodes array<string>, weights array<string>, reason string"


def random_walks(edges: DataFrame, ids: DataFrame, config: Walk = Walk(), most: int = MOST_BYTES) -> DataFrame:
    """(start, number, nodes, weights, reason) from every node and path number, seeded by both: the same however rows are dealt.
    Graphs over `most` bytes are walked by rounds of joins."""
    ways = both_ways(edges.select("u", "v", F.col("weight").cast("double").alias("weight")), "weight")
    starts = ids.select(F.col("id").cast("string").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(config.paths - 1))).alias("number"))
    g = made(ways, ids.select("id"), weight=True, most=most)
    if g is None:
        return walks_by_rounds(ways, ids, starts, config)
    shipped = edges.sparkSession.sparkContext.broadcast(g._replace(names=g.names.cast(pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, kinds = ArrayWalker(shipped.value, config), [pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
        for b in batches:
            at = pc.index_in(b.column(0), value_set=shipped.value.names).to_pylist()
            found = zip(*(walker.walk(i, k) for i, k in zip(at, b.column(1).to_pylist(), strict=True)), strict=True) if b.num_rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((*b.columns, *map(list, found)), kinds, strict=True)], ["start", "number", "nodes", "weights", "reason"])

    return starts.repartition(TASKS, "start", "number").mapInArrow(run, WALKS)


def failed_walks(edges: DataFrame, ids: DataFrame | None = None, config: Walk = Walk(), most: int = MOST_BYTES) -> DataFrame:
    """(start, number, reason): the rows of random_walks() that have a reason, from ids or all ends of edges. Whether a walk fails is
    settled before its first step, by the nodes that are near, so none is walked, and of these no more are looked at than it may lack."""
    config = replace(config, length=min(config.length, config.least_nodes))
    spark = edges.sparkSession
    shipped = compact(edges.select(F.col("u").alias("src"), F.col("v").alias("dst")), ids, most=most, both=True)
    if shipped is None:
        ids = (edges.select(F.explode(F.array("u", "v")).alias("id")) if ids is None else ids.select("id")).distinct()
        starts = ids.select(F.col("id").cast("string").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(config.paths - 1))).alias("number"))
        ways = both_ways(edges.withColumn("weight", F.lit(1.0)), "weight")
        return walks_by_rounds(ways, ids, starts, config, Walker.tried).where("reason is not null").select("start", "number", "reason")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, g = ArrayWalker(shipped.value, config), shipped.value
        names = g.names.cast(pa.string())
        for part, parts in (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            found = [(i, k, reason) for i in np.flatnonzero(g.asked)[part::parts].tolist() if (reason := walker.tried(i, 0)[2]) for k in range(config.paths)]
            at, numbers, reasons = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()), pa.array(reasons, pa.string())], ["start", "number", "reason"])

    return pivot_tasks(spark, len(shipped.value.names)).mapInArrow(run, "start string, number int, reason string")


def walks_by_rounds(ways: DataFrame, ids: DataFrame, starts: DataFrame, config: Walk, walk: Callable = Walker.walk) -> DataFrame:
    """The same walks where no task holds the graph: a round gives each open walk the neighbours of the node that it lacked, and walks
    it anew, as draws are seeded. A walk lacks fewer than twice as many nodes as it may have."""
    degree = ways.groupBy(F.col("src").alias("dst")).agg(F.count("*").cast("int").alias("d"))
    entry = F.struct("dst", F.col("dst").cast("string").alias("n"), "weight", "d")
    lists = ways.join(degree, "dst").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(entry)).alias("l"))
    all_ids = ids.select("id").distinct().join(lists, "id", "full")
    node = F.col("id").cast("string").alias("node")
    near = stored(all_ids.select(node, *(F.coalesce(f"l.{c}", F.array().cast(f"array<{k}>")).alias(c) for c, k in (("n", "string"), ("weight", "double"), ("d", "int")))), "lists")
    kind = f"{WALKS}, lacks string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for start, number, given in zip(b["start"], b["number"], b["given"], strict=True):
                walker = Walker(Given({x["node"]: (list(x["n"]), list(x["weight"]), list(x["d"])) for x in given}), config)
                try:
                    rows.append((start, number, *walk(walker, start, int(number)), None))
                except Given.Lacks as e:
                    rows.append((start, number, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["start", "number", "nodes", "weights", "reason", "lacks"])

    asked, done = starts.select("start", "number", F.col("start").alias("node")), []
    while not asked.isEmpty():
        given = asked.join(near, "node").groupBy("start", "number").agg(F.collect_list(F.struct("node", "n", "weight", "d")).alias("given"))
        made = stored(given.mapInPandas(run, kind), "walked")
        done.append(made.where("lacks is null").drop("lacks"))
        lacks = made.where("lacks is not null").select("start", "number", F.col("lacks").alias("node"))
        asked = stored(asked.join(lacks.select("start", "number"), ["start", "number"], "left_semi").unionByName(lacks), "asked")
    out = done[0] if done else starts.sparkSession.createDataFrame([], WALKS)
    for p in done[1:]:
        out = out.unionByName(p)
    return out


def walk_counters(walks: DataFrame) -> DataFrame:
    """One row: starts, successes, success rate, mean length; and (reason, n, starts) by reason from failures()."""
    ok = F.col("reason").isNull()
    return walks.agg(F.count("*").alias("starts"), F.count_if(ok).alias("successes"), F.round(F.avg(ok.cast("double")), 6).alias("rate"), F.round(F.avg(F.when(ok, F.size("nodes"))), 6).alias("mean_length"))


def failures(walks: DataFrame) -> DataFrame:
    return walks.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("start")).alias("starts"))


def betweenness(edges: DataFrame, ids: DataFrame, config: Graph = Graph(), seed: int = 42, most: int = MOST_BYTES) -> DataFrame:
    """(id, betweenness) by shortest paths from pivots chosen by a hash (all nodes, if there are no more than the pivots);
    partial sums of the tasks' pivots are added up. Graphs over `most` bytes are searched by rounds of joins."""
    spark = edges.sparkSession
    names = stored(ids.select(F.col("id").cast("string").alias("id"), F.col("id").alias("own")), "ids")
    n = names.count()
    k = min(config.pivots, n)
    pivots = names if k == n else names.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k)
    own = (lambda c: c) if len({dict(edges.dtypes)["u"], dict(edges.dtypes)["v"], dict(ids.dtypes)["id"]}) == 1 else lambda c: c.cast("string")
    lean = edges.where("u <> v").select(own(F.col("u")).alias("src"), own(F.col("v")).alias("dst"))
    shipped = compact(lean, pivots.select(own(F.col("own")).alias("id")), most=most, both=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shipped.value
        paths, total, asked = blocks_of(g), np.zeros(len(g.names)), np.flatnonzero(g.asked)
        # where all nodes are pivots, a path and its reverse are counted at once
        later = len(asked) == len(total)
        for part, parts in (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            many = -(-len(asked) // parts)
            size = max(1, -(-many // max(1, -(-many // STARTS))))
            for at in range(part * size, len(asked), parts * size):
                total += paths.shares(asked[at : at + size], later) * (1 + later)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([g.names.take(pa.array(found)).cast(pa.string()), pa.array(total[found])], ["id", "b"])

    if shipped is None:
        ways = stored(both_ways(edges).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).where("src <> dst"), "ways")
        parts = shares_by_rounds(ways, pivots.select("id"))
    else:
        parts = pivot_tasks(spark, k).mapInArrow(run, "id string, b double")
    parts = parts.groupBy("id").agg(F.sum("b").alias("b"))
    scale = (n / k) / ((n - 1) * (n - 2)) if k and n > 2 else 0.0
    return names.join(parts, "id", "left").select("id", F.round(F.coalesce("b", F.lit(0.0)) * scale, 9).alias("betweenness"))


def pivot_tasks(spark: SparkSession, pivots: int) -> DataFrame:
    """(id, of): a row in a task of its own for each part of the pivots, and the number of parts."""
    tasks = max(1, min(pivots, TASKS))
    return spark.range(0, tasks, 1, tasks).withColumn("of", F.lit(tasks))


def shares_by_rounds(ways: DataFrame, pivots: DataFrame) -> DataFrame:
    """(id, b): of the shortest paths from each pivot (id), the share that passes a node; level by level there and back."""
    step = ways.select(F.col("src").alias("node"), F.col("dst").alias("_to"))
    levels = [stored(pivots.select(F.col("id").alias("src"), F.col("id").alias("node"), F.lit(1.0).alias("paths")), "level")]
    while not levels[-1].isEmpty():
        known = levels[-1] if len(levels) < 2 else levels[-1].unionByName(levels[-2])
        came = levels[-1].join(step, "node").groupBy("src", F.col("_to").alias("node")).agg(F.sum("paths").alias("paths"))
        levels.append(stored(came.join(known.select("src", "node"), ["src", "node"], "left_anti"), "level"))
    due = levels[-1].withColumn("due", F.lit(0.0))
    out = due.select(F.col("node").alias("id"), F.col("due").alias("b"))
    for level in levels[-2:0:-1]:
        back = due.select("src", "node", ((1 + F.col("due")) / F.col("paths")).alias("_c")).join(step, "node").groupBy("src", F.col("_to").alias("node")).agg(F.sum("_c").alias("_c"))
        due = stored(level.join(back, ["src", "node"], "left").select("src", "node", "paths", F.coalesce(F.col("paths") * F.col("_c"), F.lit(0.0)).alias("due")), "due")
        out = out.unionByName(due.select(F.col("node").alias("id"), F.col("due").alias("b")))
    return out
