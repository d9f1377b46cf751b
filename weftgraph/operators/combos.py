"""Concept combinations: canonical form, deduplication, quality, and the seeded sampler that makes them."""

from __future__ import annotations

import random
from collections.abc import Collection, Iterator, Sequence
from contextlib import suppress
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.config import Combine, Quality
from weftgraph.operators.compact import MOST_BYTES, TASKS, made
from weftgraph.operators.ranking import hash_sample, indexed
from weftgraph.storage import stored


def canonical(combo: Column, size: int = Combine.size) -> Column:
    """Distinct names in order, the first `size` of them."""
    return F.slice(F.array_sort(F.array_distinct(combo)), 1, size)


def deduplicated(combos: DataFrame, config: Combine = Combine(), full: bool = True) -> DataFrame:
    """(combo): distinct combinations, whatever their order; full: only those of the whole size."""
    shaped = combos.select((canonical(F.col("combo"), config.size) if config.any_order else F.slice(F.array_distinct("combo"), 1, config.size)).alias("combo"))
    return (shaped.where(F.size("combo") == config.size) if full else shaped).distinct()


def quality(combos: DataFrame, edges: DataFrame, pool: DataFrame, weights: Quality = Quality()) -> DataFrame:
    """(combo, size, uniqueness, connectivity, probability, density, coverage, overall) in one pass over ordered pairs."""
    own = combos.withColumn("_id", F.xxhash64(F.array_join("combo", "\x00")))
    at = own.select("_id", F.explode("combo").alias("src")).distinct()
    pairs = at.join(at.withColumnRenamed("src", "dst"), "_id").where("src <> dst")
    known = pairs.join(edges.select("src", "dst", "prob"), ["src", "dst"]).where("prob > 0").groupBy("_id").agg(F.count("*").alias("_e"), F.sum("prob").alias("_p"))
    n = F.size("combo").cast("double")
    d = n * (n - 1)
    e = F.coalesce("_e", F.lit(0))
    distinct = F.size(F.array_distinct("combo"))
    density = F.when(n < 2, 0.0).otherwise(e / d)
    mean = F.when(e > 0, F.col("_p") / e).otherwise(0.0)
    out = own.join(known, "_id", "left").crossJoin(F.broadcast(pool.agg(F.count("*").alias("_pool")))).select(
        "combo", F.size("combo").alias("size"), F.when(n > 0, distinct / n).otherwise(0.0).alias("uniqueness"),
        F.when(n < 2, 1.0).when(e == 0, 0.0).otherwise((density + mean) / 2).alias("connectivity"),
        mean.alias("probability"), density.alias("density"), F.when(F.col("_pool") > 0, distinct / F.col("_pool")).otherwise(0.0).alias("coverage"),
    )
    overall = sum((w * F.col(c) for c, w in vars(weights).items()), F.lit(0.0))
    return out.withColumn("overall", overall)


def good(rated: DataFrame, least: float = Combine.least_quality) -> DataFrame:
    return rated.where(F.col("overall") >= least)


def quality_report(rated: DataFrame, config: Combine = Combine()) -> DataFrame:
    """One row of averages over a hash sample of combinations, and the distinct names it covers."""
    some = hash_sample(rated.withColumn("_k", F.array_join("combo", "##")), config.sample, "_k", seed=config.seed)
    means = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("connectivity", "probability", "density", "uniqueness", "coverage", "overall")]
    names = some.select(F.explode("combo").alias("x")).agg(F.countDistinct("x").alias("names"))
    return some.agg(F.count("*").alias("sampled"), *means).crossJoin(names)


class Free(Sequence):
    """All names of a pool but those at some places of it; nothing is copied."""

    def __init__(self, pool: Sequence, but: list[int]):
        self.pool, self.but = pool, sorted(but)

    def __len__(self) -> int:
        return len(self.pool) - len(self.but)

    def __getitem__(self, i: int):
        for k in self.but:
            i += k <= i
        return self.pool[i]


class Sampler:
    """Makes combinations from one walk. succ: name to its successors' probabilities, best first (pairs or a dict); pool: all names in
    order. Nothing else is held of an edge."""

    def __init__(self, succ: dict[str, list[tuple[str, float]] | dict[str, float]], pool: list[str], config: Combine):
        self.succ, self.pool, self.config = {a: out if isinstance(out, dict) else dict(out) for a, out in succ.items()}, pool, config

    def prob(self, a: str | None, b: str) -> float:
        return self.succ.get(a, {}).get(b, 0.0)

    def best(self, a: str, but: Collection[str]) -> str | None:
        """The best successor of a name that isn't one of some names."""
        return next((b for b in self.succ.get(a, ()) if b not in but), None)

    def between(self, a: str, b: str) -> list[tuple[str, float]]:
        """The names between two, each with the product of its two probabilities."""
        return [(x, self.prob(a, x) * self.prob(x, b)) for x in self.succ.get(a, ()) if b in self.succ.get(x, ())]

    def free(self, held: set[str]) -> Sequence[str]:
        """The names of the pool that aren't held."""
        return [x for x in self.pool if x not in held]

    def grow(self, path: list[str], rng: random.Random) -> list[str]:
        """Greedy paths from several starts, merged in order."""
        seen: set[str] = set()
        out: dict[str, None] = {}
        for at in rng.sample(path, min(self.config.starts, len(path))):
            own = [at]
            while len(own) <= self.config.steps and (b := self.best(own[-1], seen | set(own))) is not None:
                own.append(b)
            seen.update(own)
            out.update(dict.fromkeys(own))
        return list(out)[: self.config.size]

    def bridge(self, combo: list[str]) -> list[str]:
        """The best node between neighbours that depend on each other weakly."""
        i = 0
        while i < len(combo) - 1:
            a, b = combo[i], combo[i + 1]
            between = [(x, p) for x, p in self.between(a, b) if x not in combo] if self.prob(a, b) < self.config.bridge_below else ()
            if between:
                best = min(between, key=lambda x: (-x[1], x[0]))[0]
                combo = list(dict.fromkeys([*combo[: i + 1], best, *combo[i + 1 :]]))[: self.config.size]
                i += 1
            i += 1
        return combo

    def perturb(self, combo: list[str], path: list[str], rng: random.Random) -> list[str]:
        """Fills up with what depends least on a random member, from the walk and then from all names."""
        if rng.random() >= self.config.perturb:
            return combo
        out = list(combo)
        while len(out) < self.config.size and (free := [x for x in path if x not in out]):
            anchor = rng.choice(out) if out else None
            out.append(min(free, key=lambda x: self.prob(anchor, x)))
        if len(out) < self.config.size:
            free = self.free(set(out))
            out += rng.sample(free, min(len(free), self.config.size - len(out)))
        return out

    def sample(self, path: list[str], number: int, names: list[str] | None = None) -> list[str] | None:
        """One combination; None if it falls short. A walk no longer than a combination is one itself, once. names: what the walk's
        names are called, if they are numbers."""
        c = self.config
        if len(path) <= c.size:
            return sorted(set(path)) if number == 0 else None
        rng = random.Random(f"{c.seed}\x00{number}\x00" + "\x00".join(names or path))
        combo = self.grow(path, rng)
        if c.perturbation and len(combo) < c.size:
            combo = self.perturb(combo, path, rng)
        if c.bridges:
            combo = self.bridge(combo)
        if c.perturbation and len(combo) < c.size:
            combo = self.perturb(combo, path, rng)
        combo = list(dict.fromkeys(combo))
        return (sorted(combo) if c.any_order else combo) if len(combo) == c.size else None


class Arcs(NamedTuple):
    """names in order; neighbours of name i: near[ptr[i] : ptr[i + 1]], in order, with codes of probabilities."""

    ptr: np.ndarray
    near: np.ndarray
    code: np.ndarray

    def row(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.ptr[at], self.ptr[at + 1])
        return self.near[own], self.code[own]


class Shipped(NamedTuple):
    """A graph as arrays: arcs out of names and into them, the probabilities in order, and the places of the pool's names."""

    names: pa.Array
    out: Arcs
    into: Arcs
    probs: np.ndarray
    pool: np.ndarray


class ArraySampler(Sampler):
    """The same combinations over a graph's arrays; names are numbers, those that the graph lacks follow."""

    def __init__(self, g: Shipped, config: Combine):
        self.g, self.config, self.n, self.marked = g, config, len(g.names), np.zeros(len(g.names), bool)

    def prob(self, a: int | None, b: int) -> float:
        if a is None or a >= self.n:
            return 0.0
        near, code = self.g.out.row(a)
        at = int(near.searchsorted(b))
        return float(self.g.probs[code[at]]) if at < len(near) and near[at] == b else 0.0

    def best(self, a: int, but: Collection[int]) -> int | None:
        near, code = self.g.out.row(a) if a < self.n else ((), ())
        if not len(near):
            return None
        if (b := int(near[code.argmax()])) not in but:
            return b
        own = [x for x in but if x < self.n]
        self.marked[own] = True
        left = np.flatnonzero(~self.marked[near])
        self.marked[own] = False
        return int(near[left[code[left].argmax()]]) if len(left) else None

    def between(self, a: int, b: int) -> list[tuple[int, float]]:
        if a >= self.n or b >= self.n:
            return []
        (into, last), near = self.g.into.row(b), self.g.out.row(a)[0]
        self.marked[near] = True
        at = np.flatnonzero(self.marked[into])
        self.marked[near] = False
        # of equal arcs the least counts, which comes first
        at = at[np.flatnonzero(np.diff(into[at], prepend=-1))]
        return [(x, self.prob(a, x) * float(self.g.probs[c])) for x, c in zip(into[at].tolist(), last[at].tolist(), strict=True)]

    def free(self, held: set[int]) -> Sequence[int]:
        ranks = [range(*self.g.pool.searchsorted([x, x + 1]).tolist()) for x in held]
        return Free(self.g.pool, [k for r in ranks for k in r])

    def numbers(self, path: list[str], at: list[int | None]) -> tuple[list[int], list[str]]:
        """A walk's names as numbers, and the names that the graph lacks."""
        more = list(dict.fromkeys(x for x, i in zip(path, at, strict=True) if i is None))
        return [self.n + more.index(x) if i is None else i for x, i in zip(path, at, strict=True)], more

    def named(self, combo: list[int], more: list[str]) -> list[str]:
        return [more[x - self.n] if x >= self.n else self.g.names[int(x)].as_py() for x in combo]


class Given(dict):
    """The records that a round was given; lacks: those that it asked for in vain."""

    class Lacks(Exception):
        pass

    def __init__(self, records: dict):
        super().__init__(records)
        self.lacks: list[str] = []

    def __missing__(self, key: str):
        self.lacks.append(key)
        raise self.Lacks


class Ranked(Sequence):
    """The pool's names, asked for by place; one that isn't given is told as lacking, and the next may still be asked for."""

    def __init__(self, size: int, given: Given):
        self.size, self.given = size, given

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> str:
        if (key := f"#{i}") not in self.given:
            self.given.lacks.append(key)
        return self.given.get(key, key)


class GivenSampler(Sampler):
    """The same combinations over what a round was given: `=name` has successors and predecessors of a name and its places in the
    pool, `#place` the name there."""

    def __init__(self, given: Given, size: int, config: Combine):
        self.given, self.pool, self.config = given, Ranked(size, given), config

    def prob(self, a: str | None, b: str) -> float:
        return 0.0 if a is None else self.given[f"={a}"][0].get(b, 0.0)

    def best(self, a: str, but: Collection[str]) -> str | None:
        return next((b for b in self.given[f"={a}"][0] if b not in but), None)

    def between(self, a: str, b: str) -> list[tuple[str, float]]:
        out, into = self.given[f"={a}"][0], self.given[f"={b}"][1]
        return [(x, p * into[x]) for x, p in out.items() if x in into]

    def free(self, held: set[str]) -> Sequence[str]:
        return Free(self.pool, [k for x in held for k in self.given[f"={x}"][2]])


def shipped_arcs(edges: DataFrame, pool: DataFrame, most: int) -> Shipped | None:
    """The graph of edges (src, dst, prob) and a pool of names as arrays; None if it is over `most` bytes."""
    g = made(edges.select("src", "dst", F.col("prob").cast("double").alias("weight")).where("src is not null and dst is not null"), pool.select(F.col("name").alias("id")), weight=True, most=most)
    if g is None:
        return None
    probs = np.unique(g.weight)
    code = probs.searchsorted(g.weight).astype(np.min_scalar_type(max(0, len(probs) - 1)))
    g = g._replace(weight=None)
    own = pool.select("name").where("name is not null").toArrow().column("name").combine_chunks()
    places = np.sort(pc.index_in(own, value_set=g.names).to_numpy(zero_copy_only=False).astype(np.int32))
    back = np.argsort(g.near, kind="stable")
    src = np.repeat(np.arange(len(g.names), dtype=np.int32), np.diff(g.ptr))[back]
    into = np.concatenate([[0], np.cumsum(np.bincount(g.near, minlength=len(g.names)))]).astype(np.int64)
    return Shipped(g.names, Arcs(g.ptr, g.near, code), Arcs(into, src, code[back]), probs, places)


def generated(walks: DataFrame, edges: DataFrame, pool: DataFrame, config: Combine = Combine(), most: int | None = None, held: int = MOST_BYTES) -> DataFrame:
    """(combo) from walks (nodes): samples of every walk, seeded by walk and number, then deduplicated. Graphs over `held` bytes are
    sampled by rounds of joins. most: more edges and names than these are refused, if it is given."""
    if most is not None and (n := edges.count() + pool.count()) > most:
        raise ValueError(f"{n} edges and names; the sampler broadcasts at most {most}")
    g = shipped_arcs(edges, pool, held)
    if g is None:
        return generated_by_rounds(walks, edges, pool, config)
    shipped = walks.sparkSession.sparkContext.broadcast(g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = ArraySampler(shipped.value, config)
        for b in batches:
            nodes, combos = b.column(0), []
            at = pa.ListArray.from_arrays(nodes.offsets, pc.index_in(nodes.values, value_set=shipped.value.names)).to_pylist()
            for path, places, k in zip(nodes.to_pylist(), at, b.column(1).to_pylist(), strict=True):
                own, more = sampler.numbers(path, places)
                if (combo := sampler.sample(own, k, path)) is not None:
                    named = sampler.named(combo, more)
                    combos.append(sorted(named) if config.any_order or len(path) <= config.size else named)
            yield pa.RecordBatch.from_arrays([pa.array(combos, pa.list_(pa.string()))], ["combo"])

    return tries(walks, config).mapInArrow(run, "combo array<string>").distinct()


def generated_by_rounds(walks: DataFrame, edges: DataFrame, pool: DataFrame, config: Combine = Combine()) -> DataFrame:
    """The same combinations where no task holds the graph: a round gives each open sample the record that it lacked, and samples it
    anew, as draws are seeded."""
    arcs = edges.select("src", "dst", F.col("prob").cast("double").alias("p")).where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("p").alias("p"), F.max("p").alias("_m"))
    out = arcs.groupBy(F.col("src").alias("name")).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_m")).alias("_m"), "dst", "p"))), lambda x: F.struct(x["dst"].alias("n"), x["p"].alias("p"))).alias("succ"))
    into = arcs.groupBy(F.col("dst").alias("name")).agg(F.collect_list(F.struct(F.col("src").alias("n"), "p")).alias("pred"))
    ranks = stored(indexed(pool.select("name").where("name is not null").withColumn("_k", F.monotonically_increasing_id()), "name", "_k"), "ranks")
    size = ranks.count()
    own = ranks.groupBy("name").agg(F.collect_list("idx").alias("ranks"))
    lists = "array<struct<n:string,p:double>>"
    by_name = out.join(into, "name", "full").join(own, "name", "full").select(F.concat(F.lit("="), "name").alias("key"), *(F.coalesce(c, F.array().cast(k)).alias(c) for c, k in (("succ", lists), ("pred", lists), ("ranks", "array<bigint>"))), F.lit(None).cast("string").alias("name"))
    by_rank = ranks.select(F.concat(F.lit("#"), F.col("idx").cast("string")).alias("key"), *(F.array().cast(k).alias(c) for c, k in (("succ", lists), ("pred", lists), ("ranks", "array<bigint>"))), "name")
    records = stored(by_name.unionByName(by_rank), "records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for nodes, k, given in zip(*(b.column(c).to_pylist() for c in ("nodes", "k", "given")), strict=True):
                read = {x["key"]: x["name"] if x["key"][0] == "#" else (*({y["n"]: y["p"] for y in x[c] or ()} for c in ("succ", "pred")), x["ranks"] or ()) for x in given if x["key"] is not None}
                sampler, combo = GivenSampler(Given(read), size, config), None
                with suppress(Given.Lacks):
                    combo = sampler.sample(nodes, k)
                lacks = [*dict.fromkeys(sampler.given.lacks)]
                rows.append((nodes, k, None if lacks else combo, lacks))
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            kinds = [pa.list_(pa.string()), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], ["nodes", "k", "combo", "lacks"])

    kind = "nodes array<string>, k int, combo array<string>, lacks array<string>"
    every, done = tries(walks.distinct(), config), []
    asked = stored(every.select("nodes", "k", F.explode_outer(F.array_distinct(F.transform("nodes", lambda x: F.concat(F.lit("="), x)))).alias("key")), "asked")
    while not asked.isEmpty():
        given = asked.join(records, "key", "left").groupBy("nodes", "k").agg(F.collect_list(F.struct("key", "succ", "pred", "ranks", "name")).alias("given"))
        done.append(stored(given.mapInArrow(run, kind), "sampled"))
        lacks = done[-1].where("size(lacks) > 0").select("nodes", "k", F.explode("lacks").alias("key"))
        asked = stored(asked.join(lacks.select("nodes", "k").distinct(), ["nodes", "k"], "left_semi").unionByName(lacks), "asked")
    found = [x.where("combo is not null").select("combo") for x in done]
    return reduce(DataFrame.unionByName, found).distinct() if found else every.select(F.col("nodes").alias("combo"))


def tries(walks: DataFrame, config: Combine = Combine()) -> DataFrame:
    """(nodes, k): a row for each sample of a walk, dealt to tasks however few hold the walks."""
    return walks.select("nodes", F.explode(F.sequence(F.lit(0), F.lit(config.samples - 1))).alias("k")).repartition(TASKS, "nodes", "k")
