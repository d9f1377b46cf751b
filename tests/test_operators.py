"""Operators on small hand-made rows, and properties of the seeded ones."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.config import Clustering, Combine, Graph, Model, Walk
from weftgraph.functions import text as X
from weftgraph.operators import cluster, combos, cooccur, deps, graph, graph_iter, knowledge, model, prompts, ranking, walks
from weftgraph.plans import pipeline
from weftgraph.sources import readers, writers
from weftgraph.storage import stored
from weftgraph.streaming import ingest


def col(df, c):
    return [r[0] for r in df.select(c).collect()]


# ---- text


def test_points_split_once_and_blank_names(spark):
    df = spark.createDataFrame([("A - b - c",), ("A",), (" - y",), ("\tA - x \n",)], "p string")
    assert [tuple(r) for r in df.select(X.name_of(F.col("p")), X.description_of(F.col("p"))).collect()] == [("A", "b - c"), ("A", ""), ("", "y"), ("A", "x")]


def test_replies(spark):
    df = spark.createDataFrame([('x ```json\n{"1":"a - b"}\n``` {y}',), ('so {"1":"c"} ok',), ("prose",), ("[1]",), ('{"1":"a","1":"z"}',)], "r string")
    assert [r["m"] for r in df.select(X.points_of(F.col("r")).alias("m")).collect()][:4] == [{"1": "a - b"}, {"1": "c"}, None, None]
    assert [r["point"] for r in X.last_value(df.select("r", X.points_of(F.col("r")).alias("m")), "m", ["r"]).where("r like '%z%'").collect()] == ["z"]


def test_ids_and_questions(spark):
    df = spark.createDataFrame([(None, "", "two"), ("7", "one\t\r\n x", None)], "ID string, question string, problem string")
    assert col(df.select(X.doc_id("set", df, F.lit(1))), "*") == ["{set}{None}", "{set}{7}"]
    assert col(df.select(X.clean_text(X.first_filled(df))), "*") == ["two", "one x"]


def test_walk_lines_round_trip(spark):
    df = spark.createDataFrame([("S", ["a", "b", "a"], ["1.0", "2.0"]), ("T", ["u"], [])], "s string, n array<string>, w array<string>")
    lines = df.select(X.walk_line(F.col("s"), F.col("n"), F.col("w")).alias("value"))
    assert col(lines, "value") == ["Diverse Random Walk from S##@@Ba##b##a##@@BStep Weights: 1.0 -> 2.0", "Diverse Random Walk from T##@@Bu##@@BStep Weights: N/A"]
    assert col(readers.walks(lines.unionByName(spark.createDataFrame([("other",), ("Diverse Random Walk from Q##@@BQ##@@Bx",)], "value string"))), "nodes") == [["S", "a", "b"], ["T", "u"]]


def test_keys(spark):
    df = spark.createDataFrame([('\\alpha "x"',), (' "y" ',)], "k string")
    assert col(df.select(X.clean_key(F.col("k"))), "*") == ['alpha "x', "y"]


# ---- co-occurrence and graph


def test_repeats_and_self_pairs(spark):
    df = spark.createDataFrame([(1, "A"), (1, "A"), (1, "B"), (2, "B"), (2, None)], "g int, x string")
    assert {tuple(r) for r in cooccur.initial(df, "g", "x").collect()} == {("A", "A", 1), ("A", "B", 2)}


def test_aggregation_drops_what_becomes_a_loop(spark):
    pairs = spark.createDataFrame([("M", "R", 3), ("R", "R", 2), ("A", "M", 1), ("A", "R", 4)], "u string, v string, w long")
    mapping = spark.createDataFrame([("M", "R"), ("R", "R")], "name string, representative string")
    assert {tuple(r) for r in cooccur.aggregated(pairs, mapping).collect()} == {("R", "R", 2), ("A", "R", 5)}
    assert {tuple(r) for r in cooccur.aggregated(pairs, mapping, drop_self=True).collect()} == {("A", "R", 5)}


def test_graph_statistics(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 3), ("c", "c", 1), ("a", "d", 0)], "u string, v string, w long")
    built = {(r["u"], r["v"]): (round(r["weight"], 6), r["occurrences"]) for r in graph.weighted_edges(edges).collect()}
    assert built == {("a", "b"): (round(np.log(2) + np.log(4), 6), 2), ("c", "c"): (round(np.log(2), 6), 1)}
    e = graph.weighted_edges(edges, Graph(log_weights=False))
    assert {tuple(r) for r in graph.degrees(e, graph.nodes(e)).collect()} == {("a", 1), ("b", 1), ("c", 2)}
    assert [r["positions"] for r in graph.repeated_edges(edges.withColumn("pos", F.col("w"))).collect()] == [[1, 3]]
    none = e.limit(0)
    assert graph.density(none, graph.nodes(none)).first()["density"] == 0


def test_supernodes_keep_isolates(spark):
    star = spark.createDataFrame([("h", f"n{i}", 1.0) for i in range(30)] + [("x", "y", 1.0)], "u string, v string, weight double")
    gone = graph.supernodes(graph.degrees(star))
    assert col(gone, "id") == ["h"]
    assert graph.without(star, gone).count() == 1 and graph.degrees(graph.without(star, gone), graph.nodes(star)).where("degree = 0").count() == 31


def by_hand_components(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {(x, find(x)) for x in root}


def test_components_strong_components_and_hops(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2)) if a != b] + [(100 + i, 101 + i) for i in range(12)]
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {tuple(r) for r in graph_iter.connected_components(df).collect()} == by_hand_components(pairs)
    assert {tuple(r) for r in graph_iter.connected_components(df, 1000).collect()} == by_hand_components(pairs)
    assert graph_iter.connected_components(df.limit(0)).count() == 0
    reach = {x: {x} for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            reach[a] |= reach[b]
    strong = {(x, min(y for y in reach[x] if x in reach[y])) for x in reach}
    arcs = df.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    assert {tuple(r) for r in graph_iter.strong_components(arcs, df.select(F.explode(F.array("a", "b")).alias("id")).distinct()).collect()} == strong
    assert {tuple(r) for r in graph_iter.strong_components(arcs, df.select(F.explode(F.array("a", "b")).alias("id")).distinct(), 1000).collect()} == strong
    chain = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long")
    assert {(r["node"], r["dist"]) for r in graph_iter.hops(chain, spark.createDataFrame([(0,)], "id long"), 3).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_distances_of_a_connected_graph(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "u long, v long")
    got = graph_iter.distance_profile(edges, graph.nodes(edges)).first()
    assert (got["nodes"], got["components"], got["diameter"], got["radius"], got["mean_distance"]) == (5, 1, 4, 2, 2.0)
    assert graph_iter.distance_profile(edges, graph.nodes(edges), below=5).first()["diameter"] is None


def test_cosine_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<float>")
    n = np.linalg.norm(v.astype(np.float32).astype(float), axis=1)
    n[7] = 1
    u = v.astype(np.float32) / n[:, None]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] > 0.5}
    for block in (2048, 9):
        assert {(r["a"], r["b"]) for r in cluster.similar_pairs(df, 0.5, block=block).collect()} == want
        profile = cluster.similarity_profile(df, (0.5,), block=block).first()
        assert profile["over_50"] == len(want)


def test_hot_groups_meet_in_blocks(spark):
    from weftgraph.operators.meet import met

    rows = [(1, x) for x in range(50)] + [(2, x) for x in range(4)]
    df = spark.createDataFrame(rows, "g long, x long").withColumn("n", F.col("x") + 1)
    want = {(1, a, b) for a in range(50) for b in range(a + 1, 50)} | {(2, a, b) for a in range(4) for b in range(a + 1, 4)}
    for block in (1000, 7, 1):
        found = met(df, "g", "x", "n", block=block).collect()
        assert len(found) == len(want) and {(r["g"], r["a"], r["b"]) for r in found} == want and all((r["a_n"], r["b_n"]) == (r["a"] + 1, r["b"] + 1) for r in found)


def test_bridges_from_either_end(spark):
    rng = np.random.default_rng(5)
    arcs = {(int(a), int(b)): float(p) for a, b, p in zip(rng.integers(0, 15, 120), rng.integers(0, 15, 120), rng.choice([0.3, 0.6, 0.85], 120), strict=True) if a != b}
    edges = spark.createDataFrame([(a, b, p) for (a, b), p in arcs.items()], "src long, dst long, prob double")
    want = {}
    for s, t in arcs:
        ways = [(-round(arcs[s, m] * arcs[m, t], 9), m) for m in range(15) if (s, m) in arcs and (m, t) in arcs and m not in (s, t)]
        if ways:
            want[s, t] = min(ways)[1]
    assert {(r["src"], r["dst"]): r["bridge"] for r in deps.best_bridges(edges, edges).collect()} == want


def test_betweenness_of_a_path(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)], "u string, v string, weight double")
    got = {r["id"]: r["betweenness"] for r in walks.betweenness(edges, graph.nodes(edges)).collect()}
    assert got == {"a": 0.0, "b": pytest.approx(2 / 3), "c": pytest.approx(2 / 3), "d": 0.0}


# ---- order statistics


def test_index_places(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1, 9, 3)], "w int")
    assert ranking.at_shares(df, "w", mid=0.5, high=0.9).first().asDict() == {"mid": 5, "high": 9}
    assert [(r["idx"], r["w"]) for r in ranking.indexed(df, "w").orderBy("idx").collect()] == [(0, 1), (1, 3), (2, 5), (3, 9)]
    one, two = (sorted(col(ranking.hash_sample(spark.range(1000).repartition(k), 10, "id"), "id")) for k in (1, 7))
    assert one == two


# ---- walks, dependencies, combinations


@pytest.fixture(scope="module")
def ring(spark):
    rows = [(f"n{i:02d}", f"n{(i + d) % 24:02d}", 1.0 + i) for i in range(24) for d in (1, 5)]
    rows += [("p0", "p1", 1.0), *[(f"q{i}", f"q{i + 1}", 2.0) for i in range(7)]]
    return stored(spark.createDataFrame(rows, "u string, v string, weight double").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight"), "ring")


def test_walks(spark, ring):
    ids = graph.nodes(ring)
    a = {(r["start"], r["number"]): r for r in walks.random_walks(ring, ids, Walk(paths=2)).collect()}
    near = {}
    for r in ring.collect():
        near.setdefault(r["u"], set()).add(r["v"])
        near.setdefault(r["v"], set()).add(r["u"])
    sizes = {r["id"]: r["n"] for r in walks.neighbourhoods(ring, ids).collect()}
    for (start, _), r in a.items():
        if sizes[start] < 6:
            assert r["reason"] == f"Insufficient neighbors: {sizes[start]} < 6"
        elif sizes[start] < 15:
            assert len(r["nodes"]) == sizes[start]
        else:
            assert len(set(r["nodes"])) == 15 and len(r["weights"]) == 14 and r["nodes"][0] == start
            assert all(near[x] & set(r["nodes"][:i]) for i, x in enumerate(r["nodes"]) if i)
    b = {(r["start"], r["number"]): r for r in walks.random_walks(ring.repartition(5), ids.repartition(3), Walk(paths=2)).collect()}
    assert a == b
    assert walks.walk_counters(walks.random_walks(ring, ids)).first()["starts"] == ids.count()
    assert walks.failures(walks.random_walks(ring, ids)).count() >= 1


def test_shares_of_diverse_weights(ring):
    sums = graph.diverse_weights(ring).groupBy("src").agg(F.sum("p").alias("s"))
    assert all(abs(s - 1) < 1e-6 for s in col(sums, "s"))


def test_dependency_records(spark):
    lines = [
        '{"line_index":0,"knowledge_points":["a","b","z"],"dependencies":[{"from":"a","to":"b","score":3,"reason":"x"},{"from":"a","to":"a","score":5},{"from":"b","to":"c","score":2}]}',
        '{"line_index":1,"knowledge_points":["a"],"dependencies":[{"from":"a","to":"b","score":5.0,"reason":"y"},{"to":"b","score":4},{"from":"c","to":"d"}]}',
        "not json",
    ]
    records = readers.dependency_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [tuple(r) for r in deps.dependency_edges(records).collect()] == [("a", "b", 0.85, 5.0, "y")]
    assert sorted(col(deps.node_pool(records), "name")) == ["a", "b", "z"]


def test_combinations(spark):
    names = [f"k{i:02d}" for i in range(30)]
    edges = spark.createDataFrame([(a, b, 0.6 if (i + d) % 2 else 0.85) for i, a in enumerate(names) for d in (1, 2, 3) if i + d < 30 for b in [names[i + d]]], "src string, dst string, prob double")
    pool = spark.createDataFrame([(n,) for n in names], "name string")
    found = spark.createDataFrame([(names[:15],), (names[8:26],), (["x", "b", "a"],)], "nodes array<string>")
    a = combos.generated(found, edges, pool)
    made = {tuple(c) for c in col(a, "combo")}
    assert ("a", "b", "x") in made and all(len(set(c)) == 10 and list(c) == sorted(c) for c in made if len(c) > 3)
    assert made == {tuple(c) for c in col(combos.generated(found.repartition(3), edges.repartition(4), pool), "combo")}
    rated = combos.quality(a, edges, pool)
    assert rated.where("overall < 0 or overall > 1 or density > 1 or probability > 1").count() == 0
    assert combos.good(rated, 2.0).count() == 0 and combos.quality_report(rated).first()["names"] <= 33
    one = combos.quality(spark.createDataFrame([(["k00"],), (["k00", "k01"],)], "combo array<string>"), edges, pool).orderBy("size").collect()
    assert (one[0]["connectivity"], one[0]["density"]) == (1.0, 0.0) and one[1]["density"] == 0.5
    with pytest.raises(ValueError, match="broadcasts at most"):
        combos.generated(found, edges, pool, most=3)


def test_bridges_and_greedy_paths(spark):
    edges = spark.createDataFrame([("a", "x", 0.6), ("x", "b", 0.85), ("a", "y", 0.85), ("y", "b", 0.6), ("a", "b", 0.3), ("b", "a", 0.3)], "src string, dst string, prob double")
    assert [tuple(r) for r in deps.best_bridges(spark.createDataFrame([("a", "b")], "src string, dst string"), edges).collect()] == [("a", "b", "x", 0.51)]
    assert [tuple(r) for r in deps.greedy_paths(spark.createDataFrame([("a",)], "name string"), edges).collect()] == [("a", ["a", "y", "b"])]
    s = combos.Sampler({"a": [("y", 0.85), ("x", 0.6), ("b", 0.3)], "x": [("b", 0.85)], "y": [("b", 0.6)]}, ["a"], Combine())
    assert s.bridge(["a", "b"]) == ["a", "x", "b"]


# ---- prompts and models


def test_prompts_and_missing(spark):
    words = spark.createDataFrame([("A", "first"), ("B", "second"), ("\\C", "raw")], "name string, description string")
    asked = spark.createDataFrame([(1, ["A", '"B"']), (2, ["A", "\\C", "Q"])], "key long, combo array<string>")
    good, bad = prompts.prompt_rows(asked, words, {"t": "[{concepts}]"}, "c")
    assert [tuple(r) for r in good.collect()] == [("c_line_0000001", "t", "[A - first] and [B - second]")]
    assert [tuple(r) for r in bad.collect()] == [(2, ["A", "\\C", "Q"], ["\\C", "Q"], 2)]
    assert prompts.prompt_rows(asked, words, raw_first=True)[1].first()["missing"] == ["Q"]


def test_only_failures_are_asked_again(spark):
    class Slow:
        def __init__(self):
            self.asked = {}

        def complete(self, p):
            if p == "no":
                raise model.Refused("status 400")
            self.asked[p] = self.asked.get(p, 0) + 1
            return "{}" if self.asked[p] >= len(p) else "prose"

    df = spark.createDataFrame([(1, "a"), (2, "aaa"), (3, "no"), (4, "a" * 9)], "key long, prompt string").coalesce(1)
    got = {r["key"]: (r["raw"], r["attempts"], r["status"]) for r in model.completed(df, Slow, model.has_object).collect()}
    assert got == {1: ("{}", 1, "ok"), 2: ("{}", 3, "ok"), 3: ("status 400", 1, "refused"), 4: ("prose", 6, "unparsed")}


def test_http_client_against_a_server(monkeypatch):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    replies = [(503, b""), (200, b"not json"), (200, json.dumps({"choices": [{"message": {"content": "yes"}}]}).encode()), (450, b""), (500, b""), (500, b"")]
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            code, body = replies.pop(0)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/chat"
        client = model.HttpClient(url, "m", "k", Model(request_tries=3, request_pause=0.0, timeout=5))
        assert client.complete("hello") == "yes" and len(asked) == 3
        assert asked[0][0] == "Bearer k" and asked[0][1]["messages"][0]["content"] == "hello"
        with pytest.raises(model.Refused, match="450"):
            client.complete("again")
        with pytest.raises(model.Refused, match="after 2 tries: status 500"):
            model.HttpClient(url, "m", "k", Model(request_tries=2, request_pause=0.0, timeout=5)).complete("more")
    finally:
        server.shutdown()
    with pytest.raises(model.Refused, match="after 1 tries: URLError"):
        model.HttpClient("http://127.0.0.1:9/none", "m", "k", Model(request_tries=1, timeout=2)).complete("gone")


def test_modes_of_clients(monkeypatch):
    assert model.chosen_mode("auto", {"WEFT_INTERNAL_URL": "a", "WEFT_CHAT_URL": "b"}) == "internal"
    assert model.chosen_mode("auto", {"WEFT_CHAT_URL": "b"}) == "standard" == model.chosen_mode("standard", {"WEFT_CHAT_URL": "b"})
    for mode, settings in (("auto", {}), ("internal", {"WEFT_CHAT_URL": "b"}), ("other", {"WEFT_CHAT_URL": "b"})):
        with pytest.raises(ValueError, match="mode"):
            model.chosen_mode(mode, settings)
    monkeypatch.setenv("WEFT_CHAT_URL", "http://there")
    monkeypatch.setenv("WEFT_CHAT_MODEL", "m")
    made = model.http_client("standard")()
    assert (made.url, made.model, made.key) == ("http://there", "m", "")

    class Dense:
        def encode(self, texts, size):
            return {"dense_vecs": [[float(len(x))] * size for x in texts]}

    assert model.ModelEncoder(Dense, size=2).encode(["ab"]).tolist() == [[2.0, 2.0]]


def test_consolidation(spark):
    lines = [("d", "f", 1, '{"doc_id":"p","knowledge_points":{"1":"A - x","2":" - y","1":"A - z"}}'), ("d", "f", 2, ""), ("d", "f", 3, "[1]"), ("e", "g", 1, '{"knowledge_points":{"1":"B"}}')]
    points, bad = knowledge.parsed_points(spark.createDataFrame(lines, "dataset string, file string, line long, value string"))
    assert sorted((r["doc_id"], r["name"], r["description"]) for r in points.collect()) == [("p", "A", "z"), ("unknown_1", "B", "")]
    assert col(bad, "line") == [3]
    assert knowledge.dataset_statistics(points).where("dataset is null").first()["distinct_items"] == 2


# ---- files


def test_text_forms_round_trip(spark, tmp_path):
    p = str(tmp_path)
    groups = spark.createDataFrame([(0, 0, "A - b"), (0, 1, "C"), (1, 0, "D")], "problem_id long, pos int, kp string")
    writers.blocks(groups.coalesce(1), f"{p}/blocks")
    assert {tuple(r) for r in readers.groups_of_blocks(spark, f"{p}/blocks").collect()} == {tuple(r) for r in groups.collect()}
    pairs = spark.createDataFrame([("a", "b", 3), ("c", "d", 5)], "u string, v string, w long")
    writers.cooccurrence(pairs, f"{p}/pairs")
    lines = spark.read.text(f"{p}/pairs").unionByName(spark.createDataFrame([("x##y",), ("x##y##z - 1",), ("x##y - q",), ("b##a - 0.5",)], "value string"))
    assert {tuple(r) for r in readers.weighted_edges(lines).collect()} == {("a", "b", 3.0), ("c", "d", 5.0)}
    writers.delimited(spark.createDataFrame([("1", "q##@@Br")], "doc_id string, question string"), f"{p}/del", "doc_id", "question")
    numbered = readers.numbered_lines(spark, f"{p}/del")
    assert [tuple(r) for r in readers.extraction_lines(numbered).collect()] == [("1", "q##@@Br")]
    ids, edges = graph.nodes(pairs), pairs.withColumn("weight", F.col("w") * 1.0)
    writers.graph_file(ids, edges, f"{p}/g.gexf")
    n, e = readers.graph_file(spark, f"{p}/g.gexf")
    assert n.count() == 4 and {tuple(r) for r in e.select("u", "v", "weight").collect()} == {("a", "b", 3.0), ("c", "d", 5.0)}
    assert {r["attributes"]["cluster_size"] for r in n.collect()} == {"1"} and {r["attributes"]["w"] for r in e.collect()} == {"3", "5"}
    writers.edge_list(edges, f"{p}/edges")
    writers.combinations(spark.createDataFrame([(["b", "c"],)], "combo array<string>"), f"{p}/combos")
    assert col(readers.combinations(spark.read.text(f"{p}/combos")), "combo") == [["b", "c"]]
    writers.json_lines(pairs, f"{p}/json", first="w")
    assert list(json.loads(spark.read.text(f"{p}/json").first()[0])) == ["w", "u", "v"]
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n\nnope\n{"b":2}\n')
    assert sorted(readers.json_lines(spark, f"{p}/bad.jsonl").where("a is not null or b is not null").columns) == ["a", "b"]
    assert readers.json_rejects(spark.read.text(f"{p}/bad.jsonl")).count() == 1
    assert writers.valid_json(spark.read.text(f"{p}/json")).first().asDict() == {"total": 2, "valid": 2, "invalid": 0}
    clusters = spark.createDataFrame([("[main_keyword: A]##[main_index: 0]##[indices: [0, 2]]##[topics: ['A', 'C']]",)], "value string")
    assert [tuple(r) for r in readers.cluster_lines(clusters).collect()] == [("A", 0, "", [0, 2], [], ["A", "C"])]
    assert readers.groups_of_json(spark.createDataFrame([('[["a","b"],["c"]]',)], "value string")).count() == 3
    assert {tuple(r) for r in readers.json_map(spark.createDataFrame([('{"a":"1","a":"2"}',)], "value string")).collect()} == {("a", "2")}
    assert {r["dataset"] for r in readers.datasets(spark, f"{p}/*.jsonl", [".jsonl"]).collect()} == {"bad"}
    odd = ["Euler's formula", 'both "kinds\' of', "a##b]##[c \\ d", "plain - it's"]
    found = spark.createDataFrame([(i, 0) for i in range(4)], "id long, cluster long")
    record = cluster.cluster_records(found, spark.createDataFrame(list(enumerate(odd)), "id long, name string"))
    writers.clusters(record, f"{p}/clusters")
    got = readers.cluster_lines(spark.read.text(f"{p}/clusters")).first()
    assert (got["main_name"], got["members"], got["descriptions"], got["indices"]) == (odd[0], odd, ["", "", "", "it's"], [0, 1, 2, 3])
    by_double = spark.createDataFrame([("""[main_keyword: "B"]##[main_index: 1]##[main_description: ""]##[indices: [1, 3]]##[descriptions: ['', 'x']]##[topics: [1, 3]]##[contents: ["Euler's", 'C']]""",)], "value string")
    assert readers.cluster_lines(by_double).first()["members"] == ["Euler's", "C"]
    assert readers.file_counts(spark, f"{p}/bad.jsonl").first()[1:] == (4, 3)
    assert readers.explore(pairs, 1)["rows"] == 2
    groups.write.parquet(f"{p}/groups")
    assert readers.saved_groups(spark, f"{p}/groups").count() == readers.saved_groups(spark, f"{p}/blocks", "text").count() == 3
    with pytest.raises(FileNotFoundError, match="gone"):
        readers.require(spark, p, f"{p}/gone")
    many = spark.range(5).select(F.col("id").alias("n"))
    assert writers.report("R", {"many": many}, most=3).splitlines()[-1] == "(2 rows more)" and json.loads(writers.report_json({"many": many}, most=3))["many"][-1] == {"more": 2}
    assert "pairs" in writers.report("R", {"pairs": pairs}) and json.loads(writers.report_json({"pairs": pairs}))["pairs"][0]["u"] == "a"


def test_three_way_sink(spark, tmp_path):
    results = stored(model.completed(spark.createDataFrame([(1, "x\n\nalpha beta")], "key long, prompt string"), model.StubClient, model.has_object), "r")
    writers.three_way(results, str(tmp_path), X.points_of(F.col("raw")))
    assert spark.read.json(f"{tmp_path}/raw").count() == spark.read.json(f"{tmp_path}/parsed").count() == 1
    assert model.skip_done(spark.createDataFrame([(1,), (2,)], "key long"), results, "key").count() == 1


def test_stream_appends_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id":"1","question":"a  b"}\n{"id":"2","question":""}\n')
    for _ in range(2):
        ingest.append_stream(ingest.question_stream(spark, f"{tmp_path}/in", "s"), f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination(60)
    assert [tuple(r)[:2] for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("{s}{1}", "a b")]


def test_pipeline_end_to_end(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron sigma tau upsilon omega".split()
    rng = np.random.default_rng(4)
    rows = [(str(i), " ".join(rng.choice(words, 6))) for i in range(60)]
    r = pipeline.run(spark, spark.createDataFrame(rows, "id string, question string"), "d", asking=Model(pause=0.0), clustering=Clustering(threshold=0.95), building=Graph(supernode_factor=9.0), walking=Walk(hops=2), combining=Combine(samples=3))
    assert r.questions.count() == 60 and r.replies.where("status = 'ok'").count() == 60
    assert r.walks.where("reason is null").count() > 0 and r.dependencies.count() > 0
    assert r.prompts.count() + r.missing.count() >= 1
