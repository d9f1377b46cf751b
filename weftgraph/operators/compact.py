"""Graphs as arrays of neighbours, which kernels read as a broadcast of counted size, and the kernels."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.ranking import indexed

#: Bytes of neighbours (4 an arc, 12 with weights) and names that may pass the driver; over that, callers take their shuffled way.
MOST_BYTES = 400_000_000
#: Bytes of arcs and nodes that are numbered on the driver; more are numbered and sorted by tasks.
DIRECT = 64_000_000
#: Bytes of a task's bit sets, and tasks that a small graph is dealt to at least.
BITS, TASKS = 64_000_000, 24


class Compact(NamedTuple):
    """names: the nodes in order; asked: which of them were asked for; neighbours of node i: near[ptr[i] : ptr[i + 1]], in order."""

    names: pa.Array
    asked: np.ndarray
    ptr: np.ndarray
    near: np.ndarray
    weight: np.ndarray | None


def packed(ways: DataFrame, ids: DataFrame, weight: bool = False) -> DataFrame:
    """(idx, id, asked, near, weight): every node of ways (src, dst) and ids with its number and those of its neighbours, in order."""
    asked = ids.select("id").distinct().withColumn("asked", F.lit(True))
    nodes = indexed(ways.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(asked, "id", "full"), "id")
    coded = ways.join(nodes.select(F.col("id").alias("src"), F.col("idx").alias("_a")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("idx").cast("int").alias("_b")), "dst")
    entry = F.struct("_b", "weight") if weight else F.struct("_b")
    near = coded.groupBy(F.col("_a").alias("idx")).agg(F.sort_array(F.collect_list(entry)).alias("_n"))
    lists = [F.coalesce("_n._b", F.array().cast("array<int>")).alias("near")] + [F.coalesce("_n.weight", F.array().cast("array<double>")).alias("weight")] * weight
    return nodes.join(near, "idx", "left").select("idx", "id", F.coalesce("asked", F.lit(False)).alias("asked"), *lists)


def gathered(arcs: pa.Table, ids: pa.Table | None, once: bool, both: bool = False) -> Compact:
    """What packed() gives, of tables that are all here; once: equal arcs count once; both: as in made()."""
    src, dst = (arcs.column(c).combine_chunks() for c in ("src", "dst"))
    own = pc.unique(pa.chunked_array([src, dst])).drop_null() if ids is None else ids.column("id").combine_chunks()
    names = pc.unique(pa.chunked_array([own, src, dst]))
    names = names.take(pc.sort_indices(names, null_placement="at_start"))
    n, known = len(names), np.asarray(pc.and_(src.is_valid(), dst.is_valid())).astype(bool)
    a, b = (pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)[known] for x in (src, dst))
    back = np.flatnonzero(a != b) if both else np.zeros(0, np.intp)
    key, weight = np.concatenate([a * n + b, b[back] * n + a[back]]), None
    if "weight" in arcs.column_names:
        weight = arcs.column("weight").to_numpy().astype(float)[known]
        weight = np.concatenate([weight, weight[back]])
        order = np.lexsort((weight, key))
        key, weight = key[order], weight[order]
    else:
        key.sort()
        key = key[np.diff(key, prepend=-1) != 0] if once else key
    ptr = np.concatenate([[0], np.cumsum(np.bincount(key // n, minlength=n))]).astype(np.int64) if n else np.zeros(1, np.int64)
    asked = np.asarray(pc.is_in(names, value_set=pc.unique(own))).astype(bool)
    return Compact(names, asked, ptr, (key % n if n else key).astype(np.int32), weight)


def made(ways: DataFrame, ids: DataFrame | None, weight: bool = False, most: int = MOST_BYTES, once: bool = False, direct: int = DIRECT, both: bool = False) -> Compact | None:
    """The graph of ways (src, dst) and nodes ids (id; None: the ends of the ways); None if it is over `most` bytes. once: equal arcs
    count once; both: ways hold each edge in one direction, the graph in both, loops once."""
    ways, ids = ways.select("src", "dst", *["weight"] * weight), None if ids is None else ids.select("id")
    columns = [(ways, "src"), (ways, "dst")] + [(ids, "id")] * (ids is not None)
    kinds = {dict(df.dtypes)[c] for df, c in columns}
    numeric = kinds <= {"int", "bigint"}
    ends = lambda df: df.agg(F.count("*"), *(f(c) for x, c in columns if x is df and numeric for f in (F.min, F.max))).first()
    (arcs, *far), (nodes, *more) = ends(ways), (0,) if ids is None else ends(ids)
    small = numeric and all(-(2**31) <= x < 2**31 for x in far + more if x is not None)
    a_name = 4 if small else 8 if numeric else 40
    if len(kinds) == 1 and arcs * (1 + both) * (2 * a_name + 8 * weight) + nodes * a_name <= min(direct, most):
        lean = lambda df: df.withColumns({c: F.col(c).cast("int") for x, c in columns if x is df} if small else {}).toArrow()
        g = gathered(lean(ways), None if ids is None else lean(ids), once, both)
        return g._replace(names=g.names.cast(pa.int64())) if small and kinds == {"bigint"} else g
    if both:
        ways = ways.unionByName(ways.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *["weight"] * weight))
        arcs *= 2
    if ids is None:
        ids = ways.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()
        nodes = ids.count()
    if once:
        ways = ways.distinct()
        arcs = ways.count()
    if arcs * (12 if weight else 4) + nodes * 32 > most:
        return None
    t = packed(ways, ids, weight).orderBy("idx").drop("idx").toArrow().combine_chunks()
    whole = lambda c: t[c].combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type)
    near = whole("near")
    numbers = lambda x, kind: x.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    ptr = np.concatenate([[0], np.cumsum([*near.value_lengths().to_numpy(zero_copy_only=False)], dtype=np.int64)]).astype(np.int64)
    asked = whole("asked").to_numpy(zero_copy_only=False).astype(bool)
    g = Compact(whole("id"), asked, ptr, numbers(near, np.int32), numbers(whole("weight"), float) if weight else None)
    del t, near
    pa.default_memory_pool().release_unused()
    return g


def compact(ways: DataFrame, ids: DataFrame | None, weight: bool = False, most: int = MOST_BYTES, once: bool = False, both: bool = False) -> Broadcast[Compact] | None:
    """What made() gives, for all tasks."""
    g = made(ways, ids, weight, most, once, both=both)
    return g and ways.sparkSession.sparkContext.broadcast(g)


# ---- distances: bit sets of the nodes that are reached, for a block of them at a time


#: Fewer nodes than these are joined one by one; and bytes of the bits that are joined at a time, which caches hold.
FEW, CACHED = 32, 256_000


def joined(reach: np.ndarray, near: np.ndarray, first: np.ndarray, degree: np.ndarray) -> np.ndarray:
    """The union of the neighbours' bits, of nodes in falling order of degree: of some nodes at a time all first neighbours at once,
    all second, and so on."""
    out, falling = np.zeros((len(first), reach.shape[1]), np.uint64), -degree
    step = max(2 * FEW, CACHED // (8 * reach.shape[1]))
    for low in range(0, len(first), step):
        new, at, own, k = out[low : low + step], first[low : low + step], falling[low : low + step], 0
        while (m := int(np.searchsorted(own, -k))) >= FEW:
            new[:m] |= reach[near[at[:m] + k]]
            k += 1
        for i in range(m):
            new[i] |= np.bitwise_or.reduce(reach[near[at[i] + k : at[i] - own[i]]], axis=0)
    return out


def levels(g: Compact, low: int, high: int, most: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(distance, nodes, bits): which of the nodes low..high each node reaches at a distance and no sooner."""
    n, words = len(g.names), -(-(high - low) // 64)
    reach, degree, at = np.zeros((n, words), np.uint64), np.diff(g.ptr), np.arange(high - low)
    by_degree = np.argsort(-degree, kind="stable")
    reach[low + at, at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
    yield 0, np.arange(low, high), reach[low:high].copy()
    near, dist = g.near.astype(np.intp), 0
    full = np.bitwise_or.reduce(reach[low:high], axis=0)
    while most is None or dist < most:
        dist += 1
        open_ = by_degree[((reach != full).any(axis=1) & (degree > 0))[by_degree]]
        new = joined(reach, near, g.ptr[open_], degree[open_])
        new &= ~reach[open_]
        some = new.any(axis=1)
        if not some.any():
            return
        open_, new = open_[some], new[some]
        reach[open_] |= new
        yield dist, open_, new


def blocks(spark, n: int) -> tuple[DataFrame, int]:
    """Numbers of blocks, one a task, and the nodes of a block."""
    words = -(-n // 64)
    parts = max(1, min(TASKS, words), -(-words * n * 8 // BITS))
    size = -(-words // parts) * 64
    return spark.range(0, -(-n // size), 1, -(-n // size)), size


def reached(spark, shipped: Broadcast[Compact], kind: str, most: int | None = None) -> DataFrame:
    """(id, eccentricity, reached, total) of every node asked for: its greatest distance, the nodes that it reaches, the sum of distances."""
    n = len(shipped.value.names)
    if not n:
        return spark.createDataFrame([], f"id {kind}, eccentricity long, reached long, total long")
    dealt, size = blocks(spark, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shipped.value
        for low in (k * size for b in batches for k in b.column(0).to_pylist()):
            far, count, total = (np.zeros(n, np.int64) for _ in range(3))
            for dist, at, bits in levels(g, low, min(n, low + size), most):
                more = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
                far[at] = dist
                count[at] += more
                total[at] += dist * more
            own = np.flatnonzero(g.asked & (count > 0))
            yield pa.RecordBatch.from_arrays([g.names.take(pa.array(own)), *(pa.array(x[own]) for x in (far, count, total))], ["id", "e", "n", "t"])

    parts = dealt.mapInArrow(run, f"id {kind}, e long, n long, t long")
    return parts.groupBy("id").agg(F.max("e").alias("eccentricity"), F.sum("n").alias("reached"), F.sum("t").alias("total"))


#: Neighbours of a node that are looked at first, where most have more than twice as many.
SOME = 24


def components(g: Compact) -> np.ndarray:
    """The smallest number of each node's component, of a graph with every edge both ways."""
    label, some = np.arange(len(g.names), dtype=np.int32), np.flatnonzero(np.diff(g.ptr))
    while len(some):
        new = label.copy()
        new[some] = np.minimum(label[some], np.minimum.reduceat(label[g.near], g.ptr[some]))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


class Near:
    """Which of the nodes low..high each node reaches within some hops, of a graph with every edge both ways."""

    def __init__(self, g: Compact, label: np.ndarray, low: int, high: int):
        self.near, self.ptr, self.low, self.degree = g.near, g.ptr, low, np.diff(g.ptr)
        at, own = np.arange(high - low), label[low:high]
        kinds, kind = np.unique(own, return_inverse=True)
        self.words, self.bit = -(-(high - low) // 64), np.uint64(1) << (at % 64).astype(np.uint64)
        #: All that a node of a component can reach; and each node's component, of those that are here.
        self.full = np.zeros((len(kinds), self.words), np.uint64)
        np.bitwise_or.at(self.full, (kind, at // 64), self.bit)
        self.kind = np.minimum(np.searchsorted(kinds, label), len(kinds) - 1)
        rows = np.flatnonzero((kinds[self.kind] == label) & (self.degree > 0))
        self.rows = rows[np.argsort(-self.degree[rows], kind="stable")]

    def first(self, hops: int) -> np.ndarray:
        """The nodes themselves, and after a hop their neighbours."""
        out = np.zeros((len(self.degree), self.words), np.uint64)
        at = np.flatnonzero((self.near >= self.low) & (self.near < self.low + len(self.bit))) if hops else []
        if len(at):
            to = self.near[at] - self.low
            word = (np.searchsorted(self.ptr, at, side="right") - 1) * self.words + to // 64
            new = np.flatnonzero(np.diff(word, prepend=-1))
            out.ravel()[word[new]] = np.bitwise_or.reduceat(self.bit[to], new)
        own = np.arange(len(self.bit))
        out[self.low + own, own // 64] |= self.bit
        return out

    def portions(self) -> Iterator[np.ndarray]:
        step = max(2 * FEW, CACHED // (8 * self.words))
        return (self.rows[i : i + step] for i in range(0, len(self.rows), step))

    def guessed(self, reach: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """A hop more, through some neighbours only."""
        out = reach.copy()
        for rows in self.portions():
            new = reach[rows]
            for r in rng.random((SOME, len(rows))):
                new |= reach[self.near[self.ptr[rows] + (r * self.degree[rows]).astype(np.int64)]]
            out[rows] = new
        return out

    def hop(self, reach: np.ndarray) -> np.ndarray:
        """A hop more, through all neighbours, or as many as it takes until nothing is left to reach."""
        out = reach.copy()
        for rows in self.portions():
            rows = rows[(reach[rows] != self.full[self.kind[rows]]).any(axis=1)]
            new, first, falling, k, check = reach[rows], self.ptr[rows], -self.degree[rows], 0, 4
            while (m := int(np.searchsorted(falling, -k))) >= FEW:
                new[:m] |= reach[self.near[first[:m] + k]]
                k += 1
                if k == check:
                    open_, check = (new != self.full[self.kind[rows]]).any(axis=1), 2 * check
                    out[rows[~open_]] = new[~open_]
                    rows, new, first, falling = (x[open_] for x in (rows, new, first, falling))
            for i in range(m):
                new[i] |= np.bitwise_or.reduce(reach[self.near[first[i] + k : first[i] - falling[i]]], axis=0)
            out[rows] = new
        return out

    def counts(self, hops: int) -> np.ndarray:
        """How many each node reaches. Where nodes have many neighbours, it is seen first whether some of them lead everywhere, since
        then the others can't add anything; else all are looked at."""
        reach = self.first(hops)
        if hops > 2 and self.degree[self.rows].sum() > 2 * SOME * len(self.rows):
            guess, rng = reach, np.random.default_rng(self.low)
            for _ in range(hops - 2):
                guess = self.guessed(guess, rng)
            guess = self.hop(guess)
            if (guess[self.rows] == self.full[self.kind[self.rows]]).all():
                reach, hops = guess, 0
        for _ in range(hops - 1):
            reach = self.hop(reach)
        return np.bitwise_count(reach).sum(axis=1, dtype=np.int64)


def sizes(spark, shipped: Broadcast[Compact], kind: str, hops: int) -> DataFrame:
    """(id, n): how many nodes each node asked for reaches within some hops, of a graph with every edge both ways."""
    n = len(shipped.value.names)
    if not n:
        return spark.createDataFrame([], f"id {kind}, n long")
    dealt, size = blocks(spark, n)
    label = spark.sparkContext.broadcast(components(shipped.value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, total = shipped.value, np.zeros(n, np.int64)
        for low in (k * size for b in batches for k in b.column(0).to_pylist()):
            total += Near(g, label.value, low, min(n, low + size)).counts(hops)
        own = np.flatnonzero(g.asked & (total > 0))
        yield pa.RecordBatch.from_arrays([g.names.take(pa.array(own)), pa.array(total[own])], ["id", "n"])

    return dealt.mapInArrow(run, f"id {kind}, n long").groupBy("id").agg(F.sum("n").alias("n"))


#: Pairs of a batch that leaves a task.
PAIRS = 1_000_000


def distances(spark, shipped: Broadcast[Compact], kind: str, most: int | None = None) -> DataFrame:
    """(src, node, dist) of every node asked for and all that it reaches."""
    n = len(shipped.value.names)
    if not n:
        return spark.createDataFrame([], f"src {kind}, node {kind}, dist int")
    dealt, size = blocks(spark, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shipped.value
        for low in (k * size for b in batches for k in b.column(0).to_pylist()):
            for dist, at, bits in levels(g, low, min(n, low + size), most):
                at, bits = at[g.asked[at]], bits[g.asked[at]]
                step = max(1, PAIRS // size)
                for i in range(0, len(at), step):
                    x, y = np.nonzero(np.unpackbits(bits[i : i + step].view(np.uint8), axis=1, bitorder="little"))
                    yield pa.RecordBatch.from_arrays([g.names.take(pa.array(at[i + x])), g.names.take(pa.array(low + y)), pa.array(np.full(len(x), dist, np.int32))], ["src", "node", "dist"])

    return dealt.mapInArrow(run, f"src {kind}, node {kind}, dist int")


# ---- numbers of shortest paths


#: Nodes whose values a product adds up, and nodes whose values it reads, at a time, which caches hold; starts of a block; edges
#: that are followed one by one at a time, and how many times dearer one of them is than an edge of a product.
PORTION, TILE, STARTS, EDGES, DEARER = 4096, 16384, 32, 1_000_000, 20
#: A float32's relative error, with that of its sums; and the error of a result that it may cause.
ERROR, MAY_ERR = 2.0**-22, 1e-9


class Products:
    """Sums of the neighbours' rows of a matrix, for all nodes: portion by portion of them, tile by tile of their neighbours."""

    def __init__(self, g: Compact, portion: int = PORTION, tile: int = TILE):
        self.n, self.tile, self.portion, self.plan, degree = len(g.names), tile, portion, [], np.diff(g.ptr)
        # rows of as many neighbours together, so that few are left alone
        order = np.argsort(-degree, kind="stable")
        for low in range(0, self.n, portion):
            rows = order[low : low + portion]
            many = degree[rows]
            near = g.near[np.repeat(g.ptr[rows] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            row = np.repeat(np.arange(len(rows), dtype=np.int32), many)
            by_tile = np.argsort(near // tile, kind="stable")
            near, row = near[by_tile], row[by_tile]
            cuts = np.searchsorted(near // tile, np.arange(-(-self.n // tile) + 1))
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if a < b:
                    own, *more = self.dealt(row[a:b], near[a:b], len(rows))
                    self.plan.append((k, rows[own], *more))

    @staticmethod
    def dealt(row: np.ndarray, near: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Rows in falling order of their neighbours here; all first neighbours, all second, and so on; how many these are."""
        many = np.bincount(row, minlength=rows)
        own = np.argsort(-many, kind="stable")[: np.count_nonzero(many)]
        place = np.empty(rows, np.int64)
        place[own] = np.arange(len(own))
        rank = np.arange(len(row)) - (np.cumsum(many) - many)[row]
        return own, near[np.lexsort((place[row], rank))], np.bincount(rank).tolist()

    def sums(self, x: np.ndarray, low: int = 0) -> np.ndarray:
        """For each node, the sum of its neighbours' rows of x, which are 0 before node low."""
        out, new, more = np.zeros_like(x), *(np.empty((self.portion, x.shape[1]), x.dtype) for _ in range(2))
        for k, own, near, many in self.plan:
            if (k + 1) * self.tile <= low:
                continue
            m = at = many[0]
            x.take(near[:m], axis=0, out=new[:m], mode="clip")
            for m in many[1:]:
                part, sums = more[:m], new[:m]
                x.take(near[at : at + m], axis=0, out=part, mode="clip")
                np.add(sums, part, out=sums)
                at += m
            out[own] += new[: len(own)]
        return out


class Blocks:
    """Shortest paths from a block of nodes at a time, of a graph with every edge both ways. Levels of few edges are followed edge by
    edge, from the side with fewer of them; of others, all nodes' neighbours are added up at once."""

    def __init__(self, g: Compact):
        self.g, self.n, self.degree, self.label, self.products = g, len(g.names), np.diff(g.ptr), components(g), Products(g)
        self.kind: type = np.float32

    def ends(self, cells: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The cells of the neighbours in the same columns, and how many each has."""
        at, column = np.divmod(cells, width)
        many = self.degree[at]
        first = self.g.ptr[at] - np.cumsum(many) + many
        return self.g.near[np.repeat(first, many) + np.arange(many.sum())].astype(np.int64) * width + np.repeat(column, many), many

    def portions(self, cells: np.ndarray, width: int) -> Iterator[slice]:
        """Cells with about EDGES edges at a time."""
        total = np.cumsum(self.degree[cells // width])
        cuts = np.searchsorted(total, np.arange(EDGES, total[-1] + EDGES, EDGES)) + 1 if len(cells) else []
        low = 0
        for high in cuts:
            if low < high:
                yield slice(low, min(high, len(cells)))
            low = max(low, high)

    def pushed(self, x: np.ndarray, have: np.ndarray) -> np.ndarray:
        """The sums for all cells, of some cells' values."""
        out, value = np.zeros(x.size), x.ravel()[have]
        for own in self.portions(have, x.shape[1]):
            to, many = self.ends(have[own], x.shape[1])
            out += np.bincount(to, np.repeat(value[own], many), x.size)
        return out.reshape(x.shape)

    def pulled(self, x: np.ndarray, ask: np.ndarray) -> np.ndarray:
        """The sums for some cells; 0 for others."""
        out = np.zeros(x.size)
        for own in self.portions(ask, x.shape[1]):
            to, many = self.ends(ask[own], x.shape[1])
            some = many > 0
            if len(to):
                out[ask[own][some]] = np.add.reduceat(x.ravel()[to].astype(float), (np.cumsum(many) - many)[some])
        return out.reshape(x.shape)

    def edges(self, cells: np.ndarray) -> int:
        return int(np.count_nonzero(cells, axis=1) @ self.degree[: len(cells)])

    def sums(self, x: np.ndarray, have: np.ndarray, ask: np.ndarray, low: int = 0) -> np.ndarray:
        """For each cell of ask, the sum of its neighbours' values in its column, which are 0 but at have; have is mostly from node
        low on."""
        least = len(self.g.near) * x.shape[1] // DEARER
        own, asked = self.edges(have), self.edges(ask)
        if own <= min(asked, least):
            return self.pushed(x, np.flatnonzero(have))
        if asked <= least:
            return self.pulled(x, np.flatnonzero(ask))
        if low and self.edges(have[:low]) <= least:
            before = self.pushed(x, np.flatnonzero(have[:low]))
            x[:low] = 0
            return before + self.products.sums(x, low)
        return self.products.sums(x)

    def shares(self, starts: np.ndarray, later: bool = False) -> np.ndarray:
        """Of every node, the sum over the starts and all their targets of the share of the shortest paths that pass it. later: only
        targets after their start."""
        if self.kind is np.float32:
            found = self.searched(starts, later, np.float32)
            if found is not None and found.max(initial=0.0) * ERROR <= MAY_ERR * len(starts) * self.n:
                return found
            self.kind = np.float64
        return self.searched(starts, later, np.float64)

    def searched(self, starts: np.ndarray, later: bool, kind: type) -> np.ndarray | None:
        """What shares() gives; None where numbers of paths are too large for kind."""
        width = len(starts)
        open_, paths = self.label[:, None] == self.label[starts], np.zeros((self.n, width), kind)
        open_[starts, np.arange(width)], paths[starts, np.arange(width)] = False, 1.0
        dist, last = np.where(open_, np.int8(-1), np.int8(-2)), 0
        dist[starts, np.arange(width)] = 0
        while open_.any():
            at = dist == last
            came = self.sums(np.where(at, paths, kind(0)), at, open_)
            new = (came > 0) & open_
            np.copyto(paths, came, where=new, casting="same_kind")
            if kind is np.float32 and paths.max() >= 2**24:
                return None
            last += 1
            dist = dist.astype(np.int32) if last == 127 else dist
            np.copyto(dist, last, where=new)
            open_ ^= new
        del open_
        targets = np.arange(self.n)[:, None] > starts if later else np.ones((1, width), bool)
        low, total, due = int(starts.min()) if later else 0, np.zeros(self.n), np.zeros((self.n, width), kind)
        for far in range(last, 1, -1):
            at, to = dist == far, dist == far - 1
            due += targets
            value = np.divide(due, paths, out=np.zeros_like(due), where=at)
            due = np.where(to, paths * self.sums(value, value > 0, to, low), 0).astype(kind)
            total += due.sum(axis=1, dtype=float)
        return total


#: The last graph's blocks, which tasks of the same process share.
_BLOCKS: list = []


def blocks_of(g: Compact) -> Blocks:
    if not _BLOCKS or _BLOCKS[0].g is not g:
        _BLOCKS[:] = [Blocks(g)]
    return _BLOCKS[0]
