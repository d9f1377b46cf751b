"""Kernels over graphs as arrays against brute force, and the rounds of joins that stand in for them on graphs too large to broadcast."""

from collections import deque

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.config import Combine, Graph, Walk
from weftgraph.operators import cluster, combos, compact, graph, graph_iter, walks
from weftgraph.plans import contract, files_contract
from weftgraph.storage import stored


def random_edges(nodes, edges, seed=1):
    found = {(min(a, b), max(a, b)) for a, b in np.random.default_rng(seed).integers(0, nodes, (edges, 2)).tolist() if a != b}
    return sorted(found) + [(100, 101), (101, 102)]


def near_of(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def searched(near, start):
    """Distance and number of shortest paths of all that start reaches."""
    dist, paths, queue = {start: 0}, {start: 1}, deque([start])
    while queue:
        x = queue.popleft()
        for y in near[x]:
            if y not in dist:
                dist[y], paths[y] = dist[x] + 1, 0
                queue.append(y)
            if dist[y] == dist[x] + 1:
                paths[y] += paths[x]
    return dist, paths


@pytest.fixture(scope="module")
def tables(spark):
    pairs = random_edges(40, 70)
    edges = stored(spark.createDataFrame([(a, b, 1.0 + a) for a, b in pairs], "u long, v long, weight double"), "edges")
    ids = stored(spark.createDataFrame([(x,) for x in [*near_of(pairs), 500]], "id long"), "ids")
    return pairs, edges, ids


@pytest.mark.parametrize("pivots", [7])
def test_betweenness_over_the_size_of_a_broadcast(tables, pivots):
    _, edges, ids = tables
    kernel, rounds = ({r["id"]: r["betweenness"] for r in walks.betweenness(edges, ids, Graph(pivots=pivots), most=m).collect()} for m in (10**9, 0))
    assert rounds == pytest.approx(kernel, abs=1e-9) and len(rounds) == ids.count() and rounds["500"] == 0.0


@pytest.fixture
def no_rows(monkeypatch):
    """Distances that only counts are made of aren't made as rows."""

    def refuse(*_, **__):
        raise AssertionError("rows of all pairs")

    monkeypatch.setattr(graph_iter, "hops", refuse)


def test_distance_profile_without_rows_of_pairs(spark, no_rows):
    pairs = [p for p in random_edges(30, 90) if p[0] < 100]
    near = near_of(pairs)
    far = {x: searched(near, x)[0] for x in near}
    edges = spark.createDataFrame(pairs, "u long, v long")
    got = graph_iter.distance_profile(edges, graph.nodes(edges), below=None).first()
    each = [max(f.values()) for f in far.values()]
    assert (got["nodes"], got["diameter"], got["radius"]) == (len(near), max(each), min(each))
    assert got["mean_distance"] == round(sum(sum(f.values()) for f in far.values()) / (len(near) * (len(near) - 1)), 6)


def directed(pairs):
    """Each edge one way, some both ways, and a node without edges."""
    return [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs if (a + b) % 3]


def reach_of(arcs, ids, depth=None):
    near = {x: [b for a, b in arcs if a == x] for x in {y for arc in arcs for y in arc} | set(ids)}
    return {x: {y: n for y, n in searched(near, x)[0].items() if depth is None or n <= depth} for x in ids}


@pytest.mark.parametrize("most", [10**9, 0])
def test_eccentricity_of_directed_edges(spark, tables, most):
    pairs, _, _ = tables
    arcs, ids = directed(pairs), [*range(0, 40, 3), 100, 500]
    edges, starts = spark.createDataFrame(arcs, "src long, dst long"), spark.createDataFrame([(x,) for x in ids], "id long")
    for depth in (None, 2):
        want = {(x, max(f.values()), len(f), sum(f.values())) for x, f in reach_of(arcs, ids, depth).items()}
        assert {tuple(r) for r in graph_iter.eccentricity(edges, starts, depth=depth, most=most).select("id", "eccentricity", "reached", "total").collect()} == want


@pytest.mark.parametrize("most", [10**9, 0])
def test_distances_of_all_pairs(spark, tables, most):
    pairs, _, _ = tables
    arcs, ids = directed(pairs), [f"{x}" for x in (*range(0, 40, 3), 101, 500)]
    arcs = [(f"{a}", f"{b}") for a, b in arcs]
    edges, starts = spark.createDataFrame(arcs + arcs[:9], "src string, dst string"), spark.createDataFrame([(x,) for x in ids], "id string")
    got = [tuple(r) for r in graph_iter.distances(edges, starts, most=most).select("src", "node", "dist").collect()]
    assert sorted(got) == sorted((x, y, n) for x, f in reach_of(arcs, ids).items() for y, n in f.items())


def test_exact_betweenness_counts_paths(tables):
    pairs, edges, ids = tables
    near = near_of(pairs)
    found = {x: searched(near, x) for x in near}
    want = dict.fromkeys([*near, 500], 0.0)
    for s in near:
        for x in near:
            for t in near:
                (ds, ps), (dx, px) = found[s], found[x]
                if len({s, x, t}) == 3 and x in ds and t in ds and t in dx and ds[t] == ds[x] + dx[t]:
                    want[x] += ps[x] * px[t] / ps[t]
    n = len(want)
    got = walks.betweenness(edges, ids, Graph(pivots=1_000_000))
    assert {r["id"]: r["betweenness"] for r in got.collect()} == pytest.approx({str(x): b / (n - 1) / (n - 2) for x, b in want.items()}, abs=1e-9)


@pytest.mark.parametrize("dearer", [1, 10**9])
@pytest.mark.parametrize("later", [True, False])
def test_paths_of_a_block_of_starts(monkeypatch, dearer, later):
    """Every start was searched by itself, edge by edge; by edges or by products, in either precision, a block gives the same."""
    monkeypatch.setattr(compact, "DEARER", dearer)
    pairs = random_edges(60, 110, 5)
    near = near_of(pairs)
    names = sorted(near)
    a, b = np.array(sorted((names.index(x), names.index(y)) for x in near for y in near[x])).T
    g = compact.Compact(pa.array(names), np.ones(len(names), bool), np.searchsorted(a, np.arange(len(names) + 1)), b.astype(np.int32), None)
    paths, found = compact.Blocks(g), {x: searched(near, x) for x in near}
    paths.products = compact.Products(g, 7, 9)
    starts, want = np.arange(20, 29), np.zeros(len(names))
    for s in (names[i] for i in starts):
        for t in found[s][0]:
            for x in found[s][0]:
                if len({s, x, t}) == 3 and found[s][0][t] == found[s][0][x] + found[x][0][t] and (t > s or not later):
                    want[names.index(x)] += found[s][1][x] * found[x][1][t] / found[s][1][t]
    assert paths.searched(starts, later, np.float64) == pytest.approx(want, abs=1e-12)
    assert paths.searched(starts, later, np.float32) == pytest.approx(want, rel=1e-6)
    assert paths.shares(starts, later) == pytest.approx(want, abs=1e-12) and paths.kind is np.float64


def test_pivots_are_dealt(spark):
    """Few rows of names made one task of all pivots."""
    assert walks.pivot_tasks(spark, 1000).rdd.getNumPartitions() >= 24 and walks.pivot_tasks(spark, 3).count() == 3


def test_neighbourhoods_without_rows_of_pairs(tables, no_rows):
    pairs, edges, ids = tables
    near = near_of(pairs) | {500: set()}
    want = {x: sum(n <= 4 for n in searched(near, x)[0].values()) for x in near}
    assert {r["id"]: r["n"] for r in walks.neighbourhoods(edges, ids).collect()} == want


def test_gate_without_rows_of_pairs(tables, no_rows):
    pairs, edges, ids = tables
    got = {r["id"]: (r["n"], r["action"], r["reason"]) for r in walks.gate(walks.neighbourhoods(edges, ids)).collect()}
    assert got[500] == (1, "fail", "Insufficient neighbors: 1 < 6") and got[101][:2] == (3, "fail") and {a for _, a, _ in got.values()} == {"fail", "walk"}


def test_walks_over_the_size_of_a_broadcast(tables):
    pairs, edges, ids = tables
    kernel, rounds = ({(r["start"], r["number"]): tuple(r) for r in walks.random_walks(edges, ids, Walk(paths=2), most=m).collect()} for m in (10**9, 0))
    assert kernel == rounds and len(kernel) == 2 * ids.count()
    assert rounds["500", 0][4] == "Insufficient neighbors: 1 < 6" and len(rounds["1", 1][2]) == 15
    one = walks.walk_counters(walks.random_walks(edges, ids, most=0)).first()
    assert one["starts"] == ids.count() and one["successes"] == ids.count() - 4


def test_samples_are_dealt_and_the_sampler_is_lean(spark):
    one = spark.createDataFrame([([f"k{i}" for i in range(12)],)], "nodes array<string>").coalesce(1)
    dealt = combos.tries(one)
    assert dealt.count() == 10 and dealt.rdd.getNumPartitions() == 24
    s = combos.Sampler({"a": {"x": 0.6, "b": 0.3}, "x": {"b": 0.6}}, ["a"], Combine())
    assert s.bridge(["a", "b"]) == ["a", "x", "b"] and set(vars(s)) == {"succ", "pool", "config"}


@pytest.mark.parametrize(("held", "config"), [(10**9, Combine(samples=6)), (10**9, Combine(samples=6, any_order=False)), (0, Combine(samples=6, size=5, starts=2, steps=1))])
def test_combinations_of_graphs_of_any_size(spark, held, config):
    """Over 5,000,000 edges and names were refused; arrays, and rounds of joins over their size, give what the sampler over dicts does."""
    rng = np.random.default_rng(3)
    names = [f"k{i}" for i in range(40)]
    arcs = {(names[a], names[b]): float(rng.choice([0.3, 0.6, 0.85])) for a, b in rng.integers(0, 36, (150, 2)).tolist() if a != b}
    paths = [[names[i] for i in rng.permutation(40)[:15]] for _ in range(6)] + [["x", *names[3:14], "w"], ["x", "b", "a"], ["p", *["q", "r"] * 6], [f"z{i}" for i in range(11)], ["y", *"zz" * 6]]
    succ = {}
    for (a, b), p in sorted(arcs.items(), key=lambda e: (e[0][0], -e[1], e[0][1])):
        succ.setdefault(a, {})[b] = p
    sampler = combos.Sampler(succ, sorted(names), config)
    want = {tuple(c) for p in paths for k in range(6) if (c := sampler.sample(p, k))}
    edges = spark.createDataFrame([(a, b, p) for (a, b), p in arcs.items()], "src string, dst string, prob double")
    found, pool = spark.createDataFrame([(p,) for p in paths], "nodes array<string>"), spark.createDataFrame([(x,) for x in names], "name string")
    assert len(want) > 12 and [*sorted(tuple(r["combo"]) for r in combos.generated(found, edges, pool, config, held=held).collect())] == sorted(want)


def test_a_walk_looks_at_few_nodes():
    """All nodes within four hops were searched for every start, though 15 suffice."""
    asked = []

    class Ring(dict):
        def __missing__(self, x):
            asked.append(x)
            near = [f"{(int(x) + d) % 5000}" for d in (*range(1, 9), *range(-8, 0))]
            return near, [1.0] * 16, [16] * 16

    nodes, weights, reason = walks.Walker(Ring(), Walk()).walk("7", 0)
    assert len(set(nodes)) == 15 and len(weights) == 14 and reason is None and len(set(asked)) <= 15


def test_failures_tell_all_that_is_near():
    """A search that stops early still counts all nodes of a small neighbourhood."""
    near = {f"{i}": ([f"{j}" for j in (i - 1, i + 1) if 0 <= j < 9], [1.0] * 2, [2] * 2) for i in range(9)}
    near["0"], near["8"] = (["1"], [1.0], [2]), (["7"], [1.0], [2])
    found = [walks.Walker(near, Walk()).walk(f"{i}", 0) for i in (0, 1, 4)]
    assert [x[2] for x in found] == ["Insufficient neighbors: 5 < 6", None, None] and found[2][0] == [*"435261708"]
    assert walks.Walker(near, Walk(length=3)).reach("4") == ["4", "3", "5"]


def jobs(spark, run):
    """Spark jobs that a call starts."""
    spark.sparkContext.setJobGroup(run.__name__, "")
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(run.__name__))


def test_a_small_graph_comes_in_few_jobs(spark, tables):
    """Sorting, numbering and joining its names took some fifteen jobs."""
    _, edges, ids = tables

    def small():
        compact.made(graph.both_ways(edges, "weight"), ids, weight=True)

    assert jobs(spark, small) <= 8


@pytest.mark.parametrize("kind", ["long", "string"])
def test_graphs_made_here_and_by_tasks_are_equal(spark, kind):
    rows = [(f"{a}", f"{b}", float(w)) for a, b, w in np.random.default_rng(5).integers(0, 30, (200, 3)).tolist()] + [("3", None, 1.0), ("é", "zz", 2.0)] * (kind == "string")
    ways = stored(spark.createDataFrame(rows + rows[:20], "src string, dst string, weight double").withColumns({c: graph.F.col(c).cast(kind) for c in ("src", "dst")}), "ways")
    ids = spark.createDataFrame([("5",), ("77",), ("5",)], "id string").select(graph.F.col("id").cast(kind))
    for weight, once in ((True, False), (False, False), (False, True)):
        here, there = (compact.made(ways, ids, weight=weight, once=once, direct=d) for d in (10**9, 0))
        assert here.names.to_pylist() == there.names.to_pylist()
        for x, y in zip(here[1:], there[1:], strict=True):
            assert (x is None and y is None) or (x.dtype == y.dtype and x.tolist() == y.tolist())


def test_an_empty_graph(spark):
    none = spark.createDataFrame([], "u long, v long, weight double")
    assert walks.random_walks(none, none.selectExpr("u as id")).count() == 0 and walks.neighbourhoods(none, none.selectExpr("u as id")).count() == 0


@pytest.mark.parametrize("few", [1, 4, 1000])
def test_bits_of_neighbours_are_joined_at_once(monkeypatch, few):
    """One call of NumPy for each node made most of the time of distances."""
    monkeypatch.setattr(compact, "FEW", few)
    rng = np.random.default_rng(3)
    degree = np.sort(rng.integers(1, 9, 50))[::-1]
    near, reach = rng.integers(0, 50, degree.sum()), rng.integers(0, 2**63, (50, 3)).astype(np.uint64)
    first = np.cumsum(degree) - degree
    want = [np.bitwise_or.reduce(reach[near[f : f + d]], axis=0).tolist() for f, d in zip(first, degree, strict=True)]
    assert compact.joined(reach, near, first, degree).tolist() == want


def test_equal_arcs_are_not_shuffled_away_first(spark, tables):
    _, edges, ids = tables

    def eccentric():
        graph_iter.eccentricity(graph.both_ways(edges.unionByName(edges)), ids, symmetric=True)

    assert jobs(spark, eccentric) <= 8


def test_lengths_of_vectors_are_taken_once(spark):
    """Inlined by Spark, a vector's length was computed anew for each of its numbers."""
    df = spark.createDataFrame([(i, [float(i), 1.0, 0.5]) for i in range(9)], "id long, vec array<double>")
    dealt, _ = cluster.dealt_blocks(df, "id", "vec", 100)
    assert "aggregate(" not in dealt._jdf.queryExecution().optimizedPlan().toString()
    v = cluster.unit(pa.array([[3.0, 4.0], [0.0, 0.0], [None, 1.0]], pa.list_(pa.float32())))
    assert v[:2].tolist() == [[0.6, 0.8], [0.0, 0.0]] and np.isnan(v[2, 0])
    with pytest.raises(ValueError):
        cluster.unit(pa.array([[1.0], [1.0, 2.0, 3.0]]))


@pytest.mark.parametrize("config", [Walk(paths=2), Walk(degree_penalty=False, disturb=False, length=30), Walk(hops=1, length=6)])
def test_walks_over_arrays_are_those_over_lists(config):
    near = near_of(random_edges(40, 70))
    rows = [(f"{a:03}", f"{b:03}", 1.0 + (a * b) % 7) for a in near for b in near[a]]
    g = compact.gathered(pa.table(dict(zip(("src", "dst", "weight"), map(list, zip(*rows)), strict=True))), pa.table({"id": ["999"]}), False)
    lists = {x: ([], [], []) for x in g.names.to_pylist()}
    for a, b, w in sorted(rows):
        for x, y in zip(lists[a], (b, w, len(near[int(b)])), strict=True):
            x.append(y)
    arrays, by_name = walks.ArrayWalker(g, config), walks.Walker(lists, config)
    found = [by_name.walk(x, 1) for x in lists]
    assert [arrays.walk(i, 1) for i in range(len(lists))] == found and {x[2] is None for x in found} == {True, False}


def test_failures_of_a_graph_come_in_few_jobs(spark, tables):
    _, edges, ids = tables

    def failed():
        assert walks.failures(walks.random_walks(edges, ids)).agg({"n": "sum"}).first()[0] == 4

    assert jobs(spark, failed) <= 14


def test_properties_take_one_product(spark, monkeypatch):
    """Edges were made of the vectors twice: for the walks, and to look at them."""
    taken, near = [], contract.near
    monkeypatch.setattr(contract, "near", lambda *a: taken.append(a) or near(*a))
    rows = files_contract.walk_properties(spark, "/root/testdata/sf0.001").collect()
    assert len(taken) == 1 and all(r["length"] == r["nodes"] == r["linked"] + 1 for r in rows)


def test_gate_in_few_jobs(spark, tables):
    _, edges, ids = tables

    def gated():
        walks.gate(walks.neighbourhoods(edges, ids)).count()

    assert jobs(spark, gated) <= 12


def counted(near, ids, hops):
    return [sum(n <= hops for n in searched(near, x)[0].values()) for x in ids]


@pytest.mark.parametrize("pairs", [random_edges(150, 6000), random_edges(300, 500), [(a, b) for a in range(90) for b in range(a)] + [(a + 1, a) for a in range(90, 99)], [(a, b) for h in (0, 200) for a in range(h, h + 70) for b in range(h, a)]])
def test_sizes_of_dense_sparse_and_parted_graphs(pairs):
    """Dense ones are settled by some neighbours of each node, if these lead everywhere; then the others aren't looked at."""
    near = near_of(pairs)
    arcs = pa.table({"src": [a for a, _ in pairs] + [7], "dst": [b for _, b in pairs] + [7]})
    g = compact.gathered(arcs, pa.table({"id": [999]}), True, both=True)
    near = {x: set(near.get(x, ())) for x in g.names.to_pylist()}
    label, n = compact.components(g), len(g.names)
    assert len(set(label.tolist())) == len({min(searched(near, x)[0]) for x in near})
    for hops in (0, 1, 2, 3, 4):
        got = sum(compact.Near(g, label, low, min(n, low + 64)).counts(hops) for low in range(0, n, 64))
        assert got.tolist() == counted(near, g.names.to_pylist(), hops)


def test_sizes_of_a_dense_graph_look_at_some_neighbours(monkeypatch):
    pairs = [(a, b) for a in range(400) for b in range(a) if (a * b) % 3]
    g = compact.gathered(pa.table(dict(zip(("src", "dst"), map(list, zip(*pairs)), strict=True))), None, True, both=True)
    hops = []
    hop = compact.Near.hop
    monkeypatch.setattr(compact.Near, "hop", lambda self, reach: hops.append(1) or hop(self, reach))
    assert compact.Near(g, compact.components(g), 0, 128).counts(4).tolist() == [128] * len(g.names) and len(hops) == 1


def test_gate_of_edges_alone(spark, tables, no_rows):
    """Edges went to the driver both ways, with a list of their ends, as long integers: check_l was too large for that and was shuffled."""
    pairs, edges, _ = tables
    near = near_of(pairs)
    gated = []

    def gate():
        gated.extend(walks.gate(walks.neighbourhoods(edges)).collect())

    assert jobs(spark, gate) <= 6
    assert {r["id"]: r["n"] for r in gated} == dict(zip(near, counted(near, near, 4), strict=True))
    one, far = edges.selectExpr("u as src", "v as dst"), edges.selectExpr("u + 5000000000 as src", "v + 5000000000 as dst")
    count = edges.count()
    for ways, a_name, first in ((one, 4, min(near)), (far, 8, min(near) + 5_000_000_000)):
        g = compact.made(ways, None, both=True, direct=count * 4 * a_name)
        there = compact.made(ways, None, both=True, direct=0)
        assert g.names[0].as_py() == first and g.names.equals(there.names) and g.near.tolist() == there.near.tolist() and g.ptr.tolist() == there.ptr.tolist() and g.asked.all()


def test_gate_over_the_size_of_a_broadcast(tables):
    _, edges, ids = tables
    for asked in (ids, None):
        kernel, rounds = (sorted(map(tuple, walks.gate(walks.neighbourhoods(edges, asked, most=m)).collect())) for m in (10**9, 0))
        assert kernel == rounds and len(kernel) == ids.count() - (asked is None)


@pytest.mark.parametrize("most", [10**9, 0])
def test_failures_are_told_without_walks(spark, tables, monkeypatch, most):
    """All walks were made, and those that succeeded thrown away."""
    _, edges, ids = tables
    want = {(r["start"], r["number"], r["reason"]) for r in walks.random_walks(edges, ids, Walk(paths=2)).where("reason is not null").collect()}
    for asked in (ids, None):
        got = [tuple(r) for r in walks.failed_walks(edges, asked, Walk(paths=2), most=most).collect()]
        assert len(got) == len(set(got)) and set(got) == {w for w in want if asked or w[0] != "500"}
    assert len(want) == 8
    monkeypatch.setattr(walks, "random_walks", None)
    assert files_contract.walk_failures(spark, "/root/testdata/sf0.001").columns == ["reason", "n", "starts"]


def test_tries_look_no_further_than_failures_need():
    near = near_of(random_edges(40, 70))
    arcs = [(f"{a}", f"{b}") for a in near for b in near[a]]
    g = compact.gathered(pa.table(dict(zip(("src", "dst"), map(list, zip(*arcs)), strict=True))), None, False)
    for config in (Walk(), Walk(hops=1), Walk(hops=2, least_nodes=12), Walk(length=4)):
        tries = walks.ArrayWalker(g, walks.replace(config, length=min(config.length, config.least_nodes)))
        weights = g._replace(weight=np.ones(len(g.near)))
        assert [tries.tried(i, 0)[2] for i in range(len(near))] == [walks.ArrayWalker(weights, config).walk(i, 0)[2] for i in range(len(near))]


def test_rows_of_a_block_meet_later_ones_only(monkeypatch):
    """Of a block with itself the whole square was multiplied, and half of it crossed out."""
    monkeypatch.setattr(cluster, "STRIP", 4)
    vec = np.random.default_rng(2).normal(size=(14, 3))
    t = pa.table({"id": range(14), "vec": vec.tolist(), "_b": [1] * 14, "_t": [3] * 14})
    found, cells = [], 0
    for own, others, sims in cluster.strips(t, 2):
        x, y = np.nonzero(sims > -2)
        found += zip(own[x].tolist(), others[y].tolist(), sims[x, y].tolist(), strict=True)
        cells += sims.size
    unit = vec / np.linalg.norm(vec, axis=1)[:, None]
    assert cells == 4 * (14 + 10 + 6) + 2 * 2
    assert [f[:2] for f in found] == [(a, b) for a in range(14) for b in range(a + 1, 14)] and [f[2] for f in found] == pytest.approx([unit[a] @ unit[b] for a, b, _ in found])
