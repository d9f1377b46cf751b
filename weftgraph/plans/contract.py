"""A query for each operator over the driver's tables, with its DuckDB oracle.

Stand-ins: an order is a problem and its parts are concepts; vectors with a cosine over 0.35 are similar; parts that meet
twice or more are a graph; a co-occurrence u, v is a dependency of score min(5, 2 + w).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.config import LOCAL_EDGES, Clustering, Graph, Walk
from weftgraph.functions import text as X
from weftgraph.operators import cluster, combos, cooccur, deps, graph, graph_iter, knowledge, model, prompts, ranking, walks
from weftgraph.storage import stored

SIMILAR = 0.35
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- text


@query("SELECT doc_id, '{' || source || '}{' || doc_id || '}' AS built FROM documents")
def docid_build(spark, d):
    docs = t(spark, d, "documents").withColumn("id", F.col("doc_id"))
    return docs.select("doc_id", X.doc_id(F.col("source"), docs, F.lit(0)).alias("built"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS cleaned FROM documents")
def clean_text(spark, d):
    return t(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, coalesce(nullif(lang, 'en'), nullif(text, ''), source) AS question FROM documents")
def question_pick(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("question"), F.col("text").alias("problem"), F.col("source").alias("Problem_"))
    return docs.select("doc_id", F.coalesce(X.first_filled(docs), "Problem_").alias("question"))


LINES = r"(item_id || '##@@B' || trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query(f"SELECT {LINES} AS value FROM benchmark")
def extraction_lines(spark, d):
    return t(spark, d, "benchmark").select(F.concat_ws("##@@B", "item_id", X.clean_text(F.col("text"))).alias("value"))


@query(r"SELECT CAST(item_id AS VARCHAR) AS doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS question FROM benchmark")
def delimiter_roundtrip(spark, d):
    from weftgraph.sources.readers import extraction_lines as read

    return read(extraction_lines(spark, d))


@query("SELECT p_partkey, p_brand AS name, p_name || ' - ' || p_type AS description FROM part")
def name_desc_split(spark, d):
    point = F.concat_ws(" - ", "p_brand", "p_name", "p_type")
    return t(spark, d, "part").select("p_partkey", X.name_of(point).alias("name"), X.description_of(point).alias("description"))


@query("SELECT item_id, replace('" + prompts.EXTRACTION.replace("'", "''") + "', '{text}', text) AS prompt FROM benchmark")
def prompt_fill(spark, d):
    return t(spark, d, "benchmark").select("item_id", X.fill(prompts.EXTRACTION, text=F.col("text")).alias("prompt"))


@query("""SELECT l_orderkey, '[' || string_agg('"' || x || '"', ',' ORDER BY x) || ']' AS points FROM (SELECT DISTINCT l_orderkey, 'p' || l_partkey AS x FROM lineitem) GROUP BY l_orderkey""")
def dependency_prompt(spark, d):
    lists = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("p"), "l_partkey"))).alias("x"))
    return lists.select("l_orderkey", F.replace(X.fill(prompts.DEPENDENCY, points=F.to_json("x")), F.lit(prompts.DEPENDENCY.split("{points}")[0]), F.lit("")).alias("points"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def json_object_extract(spark, d):
    fenced = F.concat(F.lit("Sure.\n```json\n"), "props", F.lit("\n```\nDone {really}."))
    reply = F.when(F.col("event_id") % 2 == 0, fenced).otherwise(F.concat(F.lit("It is "), "props", F.lit(" as asked.")))
    return t(spark, d, "events").select("event_id", F.element_at(X.points_of(reply), "k").cast("long").alias("k"))


@query("SELECT event_id, 'u' || user_id AS src, event_type AS dst, CAST(CAST(props->>'$.k' AS BIGINT) AS DOUBLE) AS score, 'because' AS reason FROM events")
def json_array_extract(spark, d):
    reply = F.concat(F.lit('Here: [{"from":"u'), "user_id", F.lit('","to":"'), "event_type", F.lit('","score":'), F.get_json_object("props", "$.k"), F.lit(',"reason":"because"}] - all.'))
    each = t(spark, d, "events").select("event_id", F.explode(X.dependencies_of(reply)).alias("x"))
    return each.select("event_id", F.col("x.from").alias("src"), F.col("x.to").alias("dst"), "x.score", "x.reason")


@query("SELECT p_partkey, '1' AS point_id, p_type AS point FROM part UNION ALL SELECT p_partkey, '2', p_name || ' - ' || p_brand FROM part")
def map_flatten(spark, d):
    reply = F.concat(F.lit('{"1":"old","2":"'), F.concat_ws(" - ", "p_name", "p_brand"), F.lit('","1":"'), "p_type", F.lit('"}'))
    parts = t(spark, d, "part").select("p_partkey", F.from_json(reply, X.POINTS).alias("m"))
    return X.last_value(parts, "m", ["p_partkey"]).select("p_partkey", "point_id", "point")


@query("SELECT p_partkey, p_name AS plain, p_brand AS clean FROM part")
def key_clean(spark, d):
    messy = lambda c: F.concat(F.lit(" \\"), c, F.lit("\\\t"))
    return t(spark, d, "part").select("p_partkey", X.plain_key(messy(F.col("p_name"))).alias("plain"), X.clean_key(F.concat(F.lit(" \\\"'"), "p_brand", F.lit("\\\"\t"))).alias("clean"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_type END AS description FROM part")
def fuzzy_lookup(spark, d):
    part = t(spark, d, "part").withColumn("name", F.concat(F.lit("n"), "p_partkey"))
    asked = part.select(F.col("p_partkey").alias("key"), F.array(F.concat(F.lit('\\"'), "name", F.lit('"'))).alias("combo"))
    known = part.where(F.col("p_size") % 5 != 0).select("name", F.col("p_type").alias("description"))
    return prompts.looked_up(asked, known).select(F.col("key").alias("p_partkey"), "description")


@query("SELECT doc_id, regexp_replace(source || CASE WHEN doc_id % 2 = 0 THEN '_train.jsonl' ELSE '_final' END, '(?:_train\\.jsonl|_test\\.jsonl)$', '') AS dataset FROM documents")
def suffix_strip(spark, d):
    name = F.concat("source", F.when(F.col("doc_id") % 2 == 0, "_train.jsonl").otherwise("_final"))
    return t(spark, d, "documents").select("doc_id", X.without_suffix(name, ["_train.jsonl", "_test.jsonl"]).alias("dataset"))


@query("SELECT l_orderkey, 'Diverse Random Walk from ' || l_orderkey || '##@@B' || string_agg('p' || l_partkey, '##' ORDER BY l_partkey) || '##@@BStep Weights: N/A' AS value FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey")
def walk_lines(spark, d):
    lists = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("x"))
    return lists.select("l_orderkey", X.walk_line(F.col("l_orderkey").cast("string"), F.transform("x", lambda x: F.concat(F.lit("p"), x)), F.array().cast("array<string>")).alias("value"))


@query("SELECT l_orderkey, CAST(l_orderkey AS VARCHAR) || '>' || string_agg('p' || l_partkey, '>' ORDER BY l_partkey) AS nodes FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey")
def walk_parse(spark, d):
    return walk_lines(spark, d).select("l_orderkey", F.array_join(X.walk_nodes(F.col("value")), ">").alias("nodes"))


# ---- joins, consolidation, statistics


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_antijoin(spark, d):
    return model.skip_done(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id").select("doc_id")


ORDER = "l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice"


@query(f"SELECT l_partkey AS name, arg_max(l_suppkey, ({ORDER})) AS description FROM lineitem GROUP BY l_partkey")
def dict_keep_last(spark, d):
    return knowledge.dictionary(t(spark, d, "lineitem").withColumns({"name": F.col("l_partkey"), "description": F.col("l_suppkey")}), *ORDER.split(", "))


@query('SELECT source, count(*) AS "rows", count(DISTINCT text) AS distinct_items, count(*) FILTER (text IS NULL) AS missing FROM documents GROUP BY ROLLUP (source)')
def dataset_stats_rollup(spark, d):
    return knowledge.dataset_statistics(t(spark, d, "documents"), "source", "text")


@query("SELECT source AS dataset, count(*) AS total, count(*) FILTER (n_chars > 1000) AS ok, count(*) FILTER (n_chars <= 1000) AS failed, round(100.0 * count(*) FILTER (n_chars > 1000) / count(*), 6) AS ok_percent FROM documents GROUP BY ROLLUP (source)")
def status_counts(spark, d):
    return knowledge.status_counts(t(spark, d, "documents").select(F.col("source").alias("dataset"), F.when(F.col("n_chars") > 1000, "ok").otherwise("unparsed").alias("status")))


@query("SELECT l_orderkey AS g, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def group_sizes(spark, d):
    return knowledge.group_sizes(t(spark, d, "lineitem"), "l_orderkey")


@query("""WITH s AS (SELECT count(*) n FROM lineitem GROUP BY l_orderkey), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM s)
SELECT (SELECT count(*) FROM s) AS groups, CAST((SELECT sum(n) FROM s) AS BIGINT) AS items, (SELECT round(avg(n), 6) FROM s) AS mean, (SELECT max(n) FROM s) AS greatest, (SELECT min(n) FROM s) AS least, n AS median FROM r WHERE i = c // 2""")
def upper_median(spark, d):
    return knowledge.group_statistics(group_sizes(spark, d))


@query("""WITH s AS (SELECT count(*) n FROM lineitem GROUP BY l_orderkey) SELECT count(l_partkey) AS instances, count(DISTINCT l_partkey) AS names, CAST((SELECT sum(n * (n - 1) // 2) FROM s) AS BIGINT) AS pairs,
round(100.0 * (count(l_partkey) - count(DISTINCT l_partkey)) / count(l_partkey), 6) AS reuse_percent FROM lineitem""")
def kp_stats(spark, d):
    return knowledge.point_statistics(t(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query("SELECT l_partkey AS name, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def top10_names(spark, d):
    return knowledge.top_names(t(spark, d, "lineitem"), "l_partkey")


@query("SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY size")
def size_histogram(spark, d):
    return ranking.histogram(group_sizes(spark, d).select(F.col("n").alias("size")), "size")


@query("SELECT row_number() OVER (ORDER BY name) - 1 AS idx, name FROM (SELECT DISTINCT text AS name FROM documents WHERE text IS NOT NULL)")
def name_index(spark, d):
    return cluster.name_index(t(spark, d, "documents"), "text")


@query("SELECT a.conv_id AS g, a.turn || a.role AS first, b.turn || b.role AS second FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn")
def ordered_pairs(spark, d):
    return cooccur.ordered_pairs(t(spark, d, "conversations").withColumn("n", F.concat("turn", "role")), "conv_id", "turn", "n")


# ---- co-occurrence

BASKET = "basket AS (SELECT l_orderkey g, l_partkey x, count(*) n FROM lineitem GROUP BY ALL)"
COOC = BASKET + ", cooc AS (SELECT u, v, CAST(sum(w) AS BIGINT) w FROM (SELECT a.x u, b.x v, a.n * b.n w FROM basket a JOIN basket b ON a.g = b.g AND a.x < b.x UNION ALL SELECT x, x, n * (n - 1) // 2 FROM basket WHERE n > 1) GROUP BY u, v)"
AFTER = COOC + """, mapped AS (SELECT u, v, w, u - u % 5 AS ru, v - v % 5 AS rv FROM cooc), aft AS (SELECT least(ru, rv) AS u, greatest(ru, rv) AS v, CAST(sum(w) AS BIGINT) AS w FROM mapped WHERE NOT (ru = rv AND (u <> ru OR v <> rv)) GROUP BY 1, 2)"""


def pairs(spark, d):
    return cooccur.initial(t(spark, d, "lineitem"), "l_orderkey", "l_partkey")


def mapping(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_partkey").alias("name")).distinct().withColumn("representative", F.expr("name - name % 5"))


@query(f"WITH {COOC} SELECT u, v, w FROM cooc")
def cooc_initial(spark, d):
    return pairs(spark, d)


@query(f"WITH {COOC} SELECT u, v, w FROM cooc ORDER BY w DESC, u, v LIMIT 100")
def cooc_topk(spark, d):
    return ranking.top(pairs(spark, d), 100, F.desc("w"), "u", "v")


@query(f"""WITH {COOC}, r AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS i, count(*) OVER () AS c FROM cooc)
SELECT count(*) AS pairs, CAST(sum(w) AS BIGINT) AS total, round(avg(w), 6) AS mean, min(w) AS least, max(w) AS greatest, (SELECT count(DISTINCT x) FROM (SELECT u x FROM cooc UNION ALL SELECT v FROM cooc)) AS names,
(SELECT w FROM r WHERE i = floor(c * 0.5)) AS p50, (SELECT w FROM r WHERE i = floor(c * 0.9)) AS p90, (SELECT w FROM r WHERE i = floor(c * 0.95)) AS p95 FROM cooc""")
def cooc_distribution(spark, d):
    return cooccur.distribution(pairs(spark, d))


@query(f"WITH {COOC} SELECT w, count(*) AS n FROM cooc GROUP BY w")
def cooc_histogram(spark, d):
    return ranking.histogram(pairs(spark, d), "w")


@query(f"WITH {AFTER} SELECT u, v, w FROM aft")
def cooc_aggregated(spark, d):
    return cooccur.aggregated(pairs(spark, d), mapping(spark, d))


@query(f"""WITH {AFTER} SELECT (SELECT count(*) FROM cooc) AS pairs_before, CAST((SELECT sum(w) FROM cooc) AS BIGINT) AS total_before, count(*) AS pairs_after, CAST(sum(w) AS BIGINT) AS total_after,
round(100.0 * ((SELECT count(*) FROM cooc) - count(*)) / (SELECT count(*) FROM cooc), 6) AS pairs_drop_percent FROM aft""")
def clustering_impact(spark, d):
    return cooccur.impact(pairs(spark, d), cooc_aggregated(spark, d))


@query("SELECT representative, string_agg(name, ',' ORDER BY name) AS members, count(*) AS size FROM (SELECT DISTINCT l_partkey AS name, l_partkey - l_partkey % 5 AS representative FROM lineitem) GROUP BY representative HAVING count(*) > 1")
def cluster_members_inverse(spark, d):
    return cooccur.inverse(mapping(spark, d)).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


# ---- similarity and clusters

SIM = "sim AS (SELECT a.vec_id a, b.vec_id b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"
NEAR = SIM + ", near AS (SELECT a, b, s FROM sim WHERE s > 0.35), ways AS (SELECT a src, b dst FROM near UNION ALL SELECT b, a FROM near)"
REACH = NEAR + ", reach(src, node) AS (SELECT src, src FROM ways UNION SELECT r.src, w.dst FROM reach r JOIN ways w ON r.node = w.src), comp AS (SELECT src AS id, min(node) AS cluster FROM reach GROUP BY src)"


def near(spark, d):
    return cluster.similar_pairs(t(spark, d, "embeddings"), SIMILAR, "vec_id", "embedding")


def near_edges(spark, d):
    return near(spark, d).select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("sim").alias("weight"))


@query(f"WITH {NEAR} SELECT a, b, round(s, 6) AS sim FROM near")
def cosine_edges(spark, d):
    return near(spark, d).withColumn("sim", F.round("sim", 6))


@query(f"""WITH {SIM}, p AS (SELECT s FROM sim WHERE s > 0) SELECT count(*) AS positive, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, round(min(s), 6) AS least, round(max(s), 6) AS greatest,
count(*) FILTER (s > 0.4) AS over_40, count(*) FILTER (s > 0.35) AS over_35, count(*) FILTER (s > 0.3) AS over_30 FROM p""")
def similarity_profile(spark, d):
    return cluster.similarity_profile(t(spark, d, "embeddings"), (0.4, 0.35, 0.3), "vec_id", "embedding")


@query(f"WITH RECURSIVE {REACH} SELECT id, cluster FROM comp")
def components(spark, d):
    return cluster.clusters(near(spark, d))


def vector_names(spark, d):
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat_ws(":", F.lit("v"), "vec_id").alias("name"))


@query(f"WITH RECURSIVE {REACH} SELECT cluster AS main_index, 'v:' || cluster AS main_name, string_agg(id, ',' ORDER BY id) AS indices, string_agg('v:' || id, ',' ORDER BY id) AS members FROM comp GROUP BY cluster")
def cluster_records(spark, d):
    found = cluster.cluster_records(components(spark, d), vector_names(spark, d)).drop("main_description", "descriptions")
    return found.withColumns({"indices": F.array_join(F.col("indices").cast("array<string>"), ","), "members": F.array_join("members", ",")})


@query(f"""WITH RECURSIVE {REACH}, s AS (SELECT cluster, count(*) n FROM comp GROUP BY cluster), one AS (SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS clustered, max(n) AS largest, (SELECT count(*) FROM embeddings) AS a FROM s)
SELECT clusters, clustered, largest, a - clustered AS singles, a - clustered + clusters AS points_after, round(clustered / clusters, 6) AS compression FROM one""")
def cluster_summary(spark, d):
    return cluster.cluster_summary(components(spark, d), t(spark, d, "embeddings"))


@query(f"WITH RECURSIVE {REACH} SELECT 'v:' || vec_id AS name, 'v:' || coalesce(cluster, vec_id) AS representative FROM embeddings LEFT JOIN comp ON id = vec_id")
def name_mapping(spark, d):
    return cluster.name_mapping(components(spark, d), vector_names(spark, d))


# ---- graph

SPARSE = COOC + ", edge AS (SELECT u, v, ln(1 + w) AS weight FROM cooc WHERE w >= 2 AND u < v), ends AS (SELECT u id FROM edge UNION ALL SELECT v FROM edge), deg AS (SELECT id, count(*) AS degree FROM ends GROUP BY id)"
DENSE = COOC + ", ends AS (SELECT u id FROM cooc UNION ALL SELECT v FROM cooc), deg AS (SELECT id, count(*) AS degree FROM ends GROUP BY id), lim AS (SELECT avg(degree) + 2 * stddev_pop(degree) AS x FROM deg), super AS (SELECT id, degree FROM deg, lim WHERE degree > x)"


def sparse(spark, d):
    return graph.weighted_edges(pairs(spark, d).where("u < v"), Graph(least_weight=2))


def raw_lines(spark, d):
    """Edges as they come: an order's first part with each of its others, once an order."""
    items = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("pos"), "l_partkey").distinct()
    first = items.groupBy("pos").agg(F.min("l_partkey").alias("u"))
    return items.join(first, "pos").where("l_partkey > u").select("pos", "u", F.col("l_partkey").alias("v"), F.lit(1).cast("long").alias("w"))


RAW = "i AS (SELECT DISTINCT l_orderkey pos, l_partkey v FROM lineitem), f AS (SELECT pos, min(v) u FROM i GROUP BY pos), raw AS (SELECT pos, u, v FROM i JOIN f USING (pos) WHERE v > u)"


@query(f"WITH {RAW} SELECT u, v, round(sum(ln(2)), 6) AS weight, count(*) AS occurrences FROM raw GROUP BY u, v")
def graph_edges_log(spark, d):
    return graph.weighted_edges(raw_lines(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"WITH {RAW} SELECT u, v, count(*) AS occurrences, count(*) AS total, string_agg(pos, ',' ORDER BY pos) AS positions FROM raw GROUP BY u, v HAVING count(*) > 1")
def duplicate_edges(spark, d):
    return graph.repeated_edges(raw_lines(spark, d)).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query("WITH m AS (SELECT DISTINCT l_partkey AS name, l_partkey - l_partkey % 5 AS representative FROM lineitem), s AS (SELECT representative, count(*) AS cluster_size FROM m GROUP BY 1), " + SPARSE + "\nSELECT id, representative, id = representative AS is_representative, cluster_size FROM deg JOIN m ON name = id JOIN s USING (representative)")
def graph_nodes(spark, d):
    return graph.nodes(sparse(spark, d), mapping(spark, d))


@query(f"WITH {DENSE} SELECT id, degree FROM deg")
def degree(spark, d):
    return graph.degrees(pairs(spark, d))


@query(f"WITH {DENSE} SELECT count(*) AS n, round(avg(degree), 6) AS mean, round(stddev_pop(degree), 6) AS std, CAST(min(degree) AS DOUBLE) AS least, CAST(max(degree) AS DOUBLE) AS greatest, round(median(degree), 6) AS median FROM deg")
def degree_stats(spark, d):
    return graph.statistics(degree(spark, d), "degree")


@query(f"WITH {SPARSE} SELECT count(*) AS n, round(avg(weight), 6) AS mean, round(stddev_pop(weight), 6) AS std, min(weight) AS least, max(weight) AS greatest, round(median(weight), 6) AS median FROM (SELECT round(weight, 6) AS weight FROM edge)")
def weight_stats(spark, d):
    return graph.statistics(sparse(spark, d).withColumn("weight", F.round("weight", 6)), "weight")


@query(f"WITH {DENSE} SELECT id, degree FROM super")
def supernodes(spark, d):
    return graph.supernodes(degree(spark, d))


@query(f"WITH {DENSE} SELECT u, v, w FROM cooc WHERE u NOT IN (SELECT id FROM super) AND v NOT IN (SELECT id FROM super)")
def pruned_edges(spark, d):
    edges = stored(pairs(spark, d), "pairs")
    return graph.without(edges, graph.supernodes(graph.degrees(edges)))


@query(f"WITH {SPARSE} SELECT (SELECT count(*) FROM deg) AS nodes, count(*) AS edges, round(2.0 * count(*) / ((SELECT count(*) FROM deg) * ((SELECT count(*) FROM deg) - 1)), 9) AS density FROM edge")
def density(spark, d):
    edges = sparse(spark, d)
    return graph.density(edges, graph.nodes(edges))


@query(f"WITH {SPARSE} SELECT id, round(degree / ((SELECT count(*) FROM deg) - 1), 6) AS centrality FROM deg ORDER BY degree DESC, id LIMIT 10")
def degree_centrality(spark, d):
    own = graph.degrees(sparse(spark, d))
    return ranking.top(graph.degree_centrality(own).join(own, "id"), 10, F.desc("degree"), "id").select("id", "centrality")


@query(f"WITH RECURSIVE {SPARSE}, ways AS (SELECT u s, v e FROM edge UNION ALL SELECT v, u FROM edge), reach(s, e) AS (SELECT s, s FROM ways UNION SELECT r.s, w.e FROM reach r JOIN ways w ON r.e = w.s) SELECT s AS id, min(e) AS label FROM reach GROUP BY s")
def graph_components(spark, d):
    return graph_iter.connected_components(sparse(spark, d).select(F.col("u").alias("a"), F.col("v").alias("b")), LOCAL_EDGES)


HOPS = NEAR + ", hop(src, node, n) AS (SELECT DISTINCT src, src, 0 FROM ways UNION SELECT h.src, w.dst, h.n + 1 FROM hop h JOIN ways w ON h.node = w.src WHERE h.n < 4), size AS (SELECT src AS id, count(DISTINCT node) AS n FROM hop GROUP BY src)"


def ends(edges):
    return edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()


def near_ids(spark, d):
    return ends(near_edges(spark, d))


@query(f"WITH RECURSIVE {HOPS} SELECT id, n FROM size")
def khop_sizes(spark, d):
    return walks.neighbourhoods(stored(near_edges(spark, d), "near"))


@query(f"WITH RECURSIVE {HOPS} SELECT id, n, CASE WHEN n < 6 THEN 'fail' WHEN n < 15 THEN 'take' ELSE 'walk' END AS action, CASE WHEN n < 6 THEN 'Insufficient neighbors: ' || n || ' < 6' END AS reason FROM size")
def walk_gate(spark, d):
    return walks.gate(khop_sizes(spark, d))


BFS = NEAR + ", hop(src, node, n) AS (SELECT DISTINCT src, src, 0 FROM ways UNION SELECT h.src, w.dst, h.n + 1 FROM hop h JOIN ways w ON h.node = w.src WHERE h.n < 30), dist AS (SELECT src, node, min(n) AS dist FROM hop GROUP BY src, node)"


@query(f"WITH RECURSIVE {BFS} SELECT src, node, dist FROM dist")
def bfs_distances(spark, d):
    edges = stored(near_edges(spark, d), "near")
    return graph_iter.distances(graph.both_ways(edges), ends(edges), symmetric=True)


@query(f"WITH RECURSIVE {BFS} SELECT src AS id, CAST(max(dist) AS BIGINT) AS eccentricity, count(*) AS reached, CAST(sum(dist) AS BIGINT) AS total FROM dist GROUP BY src")
def eccentricity(spark, d):
    edges = stored(near_edges(spark, d), "near")
    return graph_iter.eccentricity(graph.both_ways(edges), ends(edges), symmetric=True)


@query(f"""WITH {SPARSE}, ways AS (SELECT u src, v dst, weight FROM edge UNION ALL SELECT v, u, weight FROM edge), x AS (SELECT src, dst, weight / (ln(1 + degree) + 1e-6) AS y FROM ways JOIN deg ON dst = id)
SELECT src, dst, round(y / sum(y) OVER (PARTITION BY src), 9) AS p FROM x""")
def diverse_weights(spark, d):
    return graph.diverse_weights(sparse(spark, d))


def order_paths(spark, d):
    from pyspark.sql import Window as W

    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), pos.alias("pos"), F.col("l_partkey").alias("node"))


@query(f"""WITH {SPARSE}, p AS (SELECT l_orderkey AS path, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem), s AS (SELECT path, pos, node, lead(node) OVER (PARTITION BY path ORDER BY pos) AS nxt FROM p)
SELECT path, string_agg(CASE WHEN weight IS NULL THEN '0' ELSE CAST(CAST(round(weight * 1000000) AS BIGINT) AS VARCHAR) END, ' -> ' ORDER BY pos) AS weights FROM s LEFT JOIN edge ON u = least(node, nxt) AND v = greatest(node, nxt) WHERE nxt IS NOT NULL GROUP BY path""")
def path_weights(spark, d):
    """Weights in millionths, so that texts of them compare."""
    found = graph.path_weights(order_paths(spark, d), sparse(spark, d))
    return found.select("path", F.array_join(F.transform("weights", lambda w: F.round(w * 1000000).cast("long").cast("string")), " -> ").alias("weights"))


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS path, l_partkey AS node FROM lineitem), s AS (SELECT path, count(*) n FROM p GROUP BY path), b AS (SELECT x.path a, y.path b, count(*) c FROM p x JOIN p y ON x.node = y.node AND x.path < y.path GROUP BY 1, 2),
j AS (SELECT c / (sa.n + sb.n - c) AS j FROM b JOIN s sa ON sa.path = a JOIN s sb ON sb.path = b.b), k AS (SELECT count(*) c, count(*) * (count(*) - 1) / 2 AS all_pairs FROM s), m AS (SELECT sum(j) / any_value(all_pairs) AS mean, sum(j * j) / any_value(all_pairs) AS sq FROM j, k)
SELECT count(*) AS paths, round(avg(n), 6) AS mean_length, round(stddev_pop(n), 6) AS std_length, min(n) AS least_length, max(n) AS greatest_length, (SELECT count(DISTINCT node) FROM p) AS nodes,
(SELECT round(mean, 6) FROM m) AS mean_jaccard, (SELECT round(sqrt(sq - mean * mean), 6) FROM m) AS std_jaccard, (SELECT round(1 - mean, 6) FROM m) AS diversity FROM s""")
def path_quality(spark, d):
    return graph.path_quality(order_paths(spark, d).select("path", "node").distinct())


# ---- dependencies and combinations

RECORD = """rec AS (SELECT l_orderkey, l_linenumber, 'p' || l_partkey AS src, 's' || l_suppkey AS dst, CAST(CAST(l_quantity AS BIGINT) % 7 AS DOUBLE) AS score, l_returnflag AS reason FROM lineitem WHERE CAST(l_quantity AS BIGINT) % 7 IN (3, 4, 5)),
dep AS (SELECT src, dst, CASE score WHEN 3 THEN 0.3 WHEN 4 THEN 0.6 ELSE 0.85 END::DOUBLE AS prob, score, reason FROM rec QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY l_orderkey DESC, l_linenumber DESC, score DESC, reason DESC) = 1)"""


def records(spark, d):
    one = F.struct("l_linenumber", F.concat(F.lit("p"), "l_partkey").alias("from"), F.concat(F.lit("s"), "l_suppkey").alias("to"), (F.col("l_quantity").cast("long") % 7).cast("double").alias("score"), F.col("l_returnflag").alias("reason"))
    lists = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("line_index")).agg(F.sort_array(F.collect_list(one)).alias("dependencies"))
    return lists.withColumn("knowledge_points", F.array_distinct(F.concat("dependencies.from", "dependencies.to")))


@query(f"WITH {RECORD} SELECT src, dst, prob, score, reason FROM dep")
def dep_edges(spark, d):
    return deps.dependency_edges(records(spark, d))


@query("SELECT l_orderkey, count(*) FILTER (CAST(l_quantity AS BIGINT) % 7 IN (3, 4, 5) AND l_partkey % 10 <> l_suppkey % 10) AS kept, count(*) AS total FROM lineitem GROUP BY l_orderkey")
def dep_validity(spark, d):
    ok = deps.valid((F.col("l_partkey") % 10).cast("string"), (F.col("l_suppkey") % 10).cast("string"), F.col("l_quantity").cast("long") % 7)
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(ok).alias("kept"), F.count("*").alias("total"))


DEP = COOC + ", dep AS (SELECT u src, v dst, CASE WHEN w = 2 THEN 0.6 ELSE 0.85 END::DOUBLE AS prob FROM cooc WHERE w >= 2 AND u < v)"


def dependencies(spark, d, least: int = 2):
    kept = pairs(spark, d).where((F.col("w") >= least) & (F.col("u") < F.col("v")))
    return kept.select(F.col("u").alias("src"), F.col("v").alias("dst"), deps.probability(F.least(F.lit(5), F.col("w") + 2)).alias("prob"))


@query(f"WITH {DEP}, two AS (SELECT p.src, p.dst, a.dst AS bridge, round(a.prob * b.prob, 6) AS p FROM dep p JOIN dep a ON a.src = p.src JOIN dep b ON b.src = a.dst AND b.dst = p.dst WHERE a.dst <> p.src AND a.dst <> p.dst) SELECT src, dst, bridge, p FROM two QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY p DESC, bridge) = 1")
def bridges_best(spark, d):
    edges = dependencies(spark, d)
    return deps.best_bridges(edges, edges)


@query(f"""WITH {DEP}, nx AS (SELECT src, dst FROM dep QUALIFY row_number() OVER (PARTITION BY src ORDER BY prob DESC, dst) = 1)
SELECT a.src AS start, concat_ws('>', a.src, a.dst, b.dst, c.dst, e.dst) AS path FROM nx a LEFT JOIN nx b ON b.src = a.dst LEFT JOIN nx c ON c.src = b.dst LEFT JOIN nx e ON e.src = c.dst""")
def greedy_extension(spark, d):
    edges = dependencies(spark, d)
    found = deps.greedy_paths(edges.select(F.col("src").alias("name")).distinct(), edges)
    return found.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query(f"WITH {DEP}, q AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT a.l_orderkey, a.l_partkey AS src, b.l_partkey AS dst, coalesce(prob, 0.0) AS prob FROM q a JOIN q b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey LEFT JOIN dep ON src = a.l_partkey AND dst = b.l_partkey")
def pair_probability(spark, d):
    q = t(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    both = q.withColumnRenamed("l_partkey", "src").join(q.withColumnRenamed("l_partkey", "dst"), "l_orderkey").where("src < dst")
    return deps.probabilities(both, dependencies(spark, d)).select("l_orderkey", "src", "dst", "prob")


LISTS = "lists AS (SELECT l_orderkey, list_sort(list_distinct(list('p' || l_partkey))) AS l FROM lineitem GROUP BY l_orderkey)"


def order_lists(spark, d):
    return t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit("p"), "l_partkey")).alias("combo"))


@query(f"WITH {LISTS} SELECT DISTINCT array_to_string(l[1:10], '##') AS combo FROM lists WHERE len(l) >= 10")
def combos_dedup(spark, d):
    return combos.deduplicated(order_lists(spark, d)).select(F.array_join("combo", "##").alias("combo"))


@query(f"WITH {LISTS} SELECT DISTINCT array_to_string(l[1:10], '##') AS combo FROM lists")
def combos_any_size(spark, d):
    return combos.deduplicated(order_lists(spark, d), full=False).select(F.array_join("combo", "##").alias("combo"))


RATED = COOC + f""", {LISTS}, c AS (SELECT DISTINCT l[1:10] AS l FROM lists WHERE len(l) >= 10), k AS (SELECT array_to_string(l, '##') AS combo, unnest(l) AS x FROM c),
dep AS (SELECT 'p' || u AS src, 'p' || v AS dst, CASE w WHEN 1 THEN 0.3 WHEN 2 THEN 0.6 ELSE 0.85 END::DOUBLE AS prob FROM cooc WHERE u < v),
e AS (SELECT a.combo, count(*) AS e, sum(prob) AS p FROM k a JOIN k b ON a.combo = b.combo AND a.x <> b.x JOIN dep ON src = a.x AND dst = b.x GROUP BY a.combo),
m AS (SELECT combo, e / 90 AS density, p / e AS probability, 10.0 / (SELECT count(DISTINCT l_partkey) FROM lineitem) AS coverage FROM e),
rated AS (SELECT combo, density, probability, coverage, (density + probability) / 2 AS connectivity, .3 * (density + probability) / 2 + .25 * probability + .25 * density + .1 + .1 * coverage AS overall FROM m)"""


def rated(spark, d):
    pool = t(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("name")).distinct()
    edges = dependencies(spark, d, 1).withColumns({"src": F.concat(F.lit("p"), "src"), "dst": F.concat(F.lit("p"), "dst")})
    return combos.quality(combos.deduplicated(order_lists(spark, d)), edges, pool)


@query(f"WITH {RATED} SELECT combo, round(connectivity, 6) AS connectivity FROM rated")
def connectivity_score(spark, d):
    return rated(spark, d).select(F.array_join("combo", "##").alias("combo"), F.round("connectivity", 6).alias("connectivity"))


@query(f"WITH {RATED} SELECT combo, round(density, 6) AS density, round(probability, 6) AS probability, round(coverage, 6) AS coverage, round(overall, 6) AS overall FROM rated")
def combo_quality(spark, d):
    return rated(spark, d).select(F.array_join("combo", "##").alias("combo"), *(F.round(c, 6).alias(c) for c in ("density", "probability", "coverage", "overall")))


@query(f"WITH {RATED} SELECT combo FROM rated WHERE overall >= 0.45")
def quality_filter(spark, d):
    return combos.good(rated(spark, d), 0.45).select(F.array_join("combo", "##").alias("combo"))


@query(f"WITH {RATED} SELECT count(*) AS sampled, round(avg(connectivity), 6) AS mean_connectivity, round(avg(overall), 6) AS mean_overall FROM rated")
def quality_report(spark, d):
    """The sample holds all combinations while there are no more than it asks for."""
    return combos.quality_report(rated(spark, d), combos.Combine(sample=1_000_000)).select("sampled", "mean_connectivity", "mean_overall")


NAMES = "asked AS (SELECT DISTINCT l_orderkey AS key, 'part ' || l_partkey AS name FROM lineitem), dict AS (SELECT 'part ' || p_partkey AS name, p_name AS description FROM part WHERE p_size % 10 <> 0), hit AS (SELECT key, asked.name, description FROM asked LEFT JOIN dict USING (name))"


def prompt_parts(spark, d):
    asked = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_set(F.concat(F.lit("part "), "l_partkey"))).alias("combo"))
    known = t(spark, d, "part").where("p_size % 10 <> 0").select(F.concat(F.lit("part "), "p_partkey").alias("name"), F.col("p_name").alias("description"))
    return prompts.prompt_rows(asked, known)


@query(f"WITH {NAMES} SELECT format('combinations_line_{{:07d}}', key) AS doc_id, 'synthesis' AS method, replace('{prompts.TEMPLATES['synthesis']}', '{{concepts}}', string_agg(name || ' - ' || description, '] and [' ORDER BY name)) AS prompt FROM hit GROUP BY key HAVING count(*) = count(description)")
def prompt_rows(spark, d):
    return prompt_parts(spark, d)[0]


@query(f"WITH {NAMES} SELECT key, string_agg(name, '##' ORDER BY name) AS combo, string_agg(name, '##' ORDER BY name) FILTER (description IS NULL) AS missing, CAST(count(*) - count(description) AS INTEGER) AS missing_count FROM hit GROUP BY key HAVING count(*) > count(description)")
def missing_rows(spark, d):
    return prompt_parts(spark, d)[1].withColumns({"combo": F.array_join("combo", "##"), "missing": F.array_join("missing", "##")})


@query(f"""WITH {NAMES}, g AS (SELECT key, count(*) = count(description) AS ok FROM hit GROUP BY key) SELECT count(*) FILTER (ok) AS prompts, count(*) FILTER (ok) AS combos, count(*) FILTER (NOT ok) AS missing, round(100.0 * count(*) FILTER (ok) / count(*), 6) AS ok_percent FROM g""")
def prompt_totals(spark, d):
    return prompts.prompt_totals(*prompt_parts(spark, d))


@query("""WITH a AS (SELECT DISTINCT source FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT source FROM documents WHERE n_chars > 10000) SELECT 'both' AS part, source FROM (SELECT source FROM a INTERSECT SELECT source FROM b) UNION ALL SELECT 'only', source FROM (SELECT source FROM a EXCEPT SELECT source FROM b) UNION ALL SELECT 'any', source FROM (SELECT source FROM a UNION SELECT source FROM b)""")
def set_algebra(spark, d):
    docs = t(spark, d, "documents")
    a, b = docs.where("lang = 'en'").select("source"), docs.where("n_chars > 10000").select("source")
    tag = lambda name, df: df.select(F.lit(name).alias("part"), "source")
    return tag("both", a.intersect(b)).unionByName(tag("only", a.distinct().exceptAll(b.distinct()))).unionByName(tag("any", a.union(b).distinct()))


DIRECTED = NEAR + ", arc AS (SELECT a AS src, b AS dst FROM near UNION ALL SELECT b, a FROM near WHERE s > 0.37), ids AS (SELECT src AS id FROM arc UNION SELECT dst FROM arc), r(src, node) AS (SELECT id, id FROM ids UNION SELECT r.src, arc.dst FROM r JOIN arc ON r.node = arc.src)"


@query(f"WITH RECURSIVE {DIRECTED} SELECT x.src AS id, min(x.node) AS label FROM r x JOIN r y ON x.src = y.node AND x.node = y.src GROUP BY x.src")
def strong_components(spark, d):
    e = near(spark, d)
    arcs = e.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(e.where("sim > 0.37").select(F.col("b").alias("src"), F.col("a").alias("dst")))
    return graph_iter.strong_components(arcs, arcs.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), LOCAL_EDGES)


@query(f"WITH RECURSIVE {DIRECTED}, m AS (SELECT x.src AS id, min(x.node) AS label FROM r x JOIN r y ON x.src = y.node AND x.node = y.src GROUP BY x.src), c AS (SELECT (SELECT count(*) FROM ids) AS nodes, (SELECT count(*) FROM arc) AS edges) SELECT nodes, edges, round(edges / (nodes * (nodes - 1)), 9) AS density, (SELECT count(*) FROM embeddings) AS pool, round(edges / nodes, 6) AS mean_in, round(edges / nodes, 6) AS mean_out, (SELECT count(DISTINCT cluster) FROM (SELECT w.src, min(w.node) AS cluster FROM wk w GROUP BY w.src)) AS weak, (SELECT count(DISTINCT label) FROM m) AS strong FROM c".replace(", m AS", ", wk(src, node) AS (SELECT id, id FROM ids UNION SELECT k.src, w.dst FROM wk k JOIN ways w ON k.node = w.src), m AS"))
def dep_stats(spark, d):
    e = near(spark, d)
    arcs = e.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(e.where("sim > 0.37").select(F.col("b").alias("src"), F.col("a").alias("dst")))
    return deps.dependency_statistics(arcs, t(spark, d, "embeddings").select(F.col("vec_id").alias("name")))


@query("WITH m AS (SELECT DISTINCT l_partkey AS name, l_partkey - l_partkey % 5 AS representative FROM lineitem) SELECT count(*) AS names, count(DISTINCT representative) AS representatives, count(*) FILTER (name <> representative) AS moved, round(100.0 * (count(*) - count(DISTINCT representative)) / count(*), 6) AS reduction_percent FROM m")
def mapping_stats(spark, d):
    return cooccur.mapping_statistics(mapping(spark, d))


@query("WITH m AS (SELECT DISTINCT l_partkey AS name, l_partkey - l_partkey % 5 AS representative FROM lineitem) SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM m GROUP BY representative) GROUP BY size")
def mapping_sizes(spark, d):
    return cooccur.mapping_sizes(mapping(spark, d))


STEPS = f"""WITH {SPARSE}, p AS (SELECT l_orderkey AS path, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem), s AS (SELECT path, pos, node, lead(node) OVER (PARTITION BY path ORDER BY pos) AS nxt FROM p),
st AS (SELECT weight AS w FROM s JOIN edge ON u = least(node, nxt) AND v = greatest(node, nxt) WHERE nxt IS NOT NULL)"""


@query(f"{STEPS} SELECT count(*) AS n, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std, round(min(w), 6) AS least, round(max(w), 6) AS greatest FROM st")
def step_weights(spark, d):
    found = graph.step_weights(graph.path_weights(order_paths(spark, d), sparse(spark, d)))
    return found.withColumns({"least": F.round("least", 6), "greatest": F.round("greatest", 6)})


@query(f"{STEPS} SELECT round_even(w, 2) AS w, count(*) AS n FROM st GROUP BY 1")
def step_weight_histogram(spark, d):
    return graph.step_weight_histogram(graph.path_weights(order_paths(spark, d), sparse(spark, d)))


@query(f"WITH RECURSIVE {REACH}, s AS (SELECT cluster, count(*) n FROM comp GROUP BY cluster) SELECT CAST(sum(n) AS BIGINT) AS nodes, count(*) AS components, max(n) AS largest, CAST(NULL AS BIGINT) AS diameter, CAST(NULL AS BIGINT) AS radius, CAST(NULL AS DOUBLE) AS mean_distance FROM s")
def distance_profile(spark, d):
    """The graph isn't connected: its components are told instead of distances."""
    return graph_iter.distance_profile(near_edges(spark, d), near_ids(spark, d))


# ---- seeded and external operators: properties are tested, rows are counted


@query()
def hash_sample(spark, d):
    return ranking.hash_sample(t(spark, d, "part"), 100, "p_partkey").select("p_partkey")


@query()
def betweenness(spark, d):
    edges = stored(near_edges(spark, d), "near")
    return walks.betweenness(edges, ends(edges))


@query()
def random_walks(spark, d):
    edges = stored(near_edges(spark, d), "near")
    return walks.random_walks(edges, ends(edges), Walk())


@query()
def combos_generated(spark, d):
    edges = stored(near_edges(spark, d), "near")
    found = walks.random_walks(edges, ends(edges), Walk()).where("reason is null").select("nodes")
    arcs = edges.select(F.col("u").cast("string").alias("src"), F.col("v").cast("string").alias("dst"), F.lit(0.6).alias("prob"))
    return combos.generated(found, arcs, ends(edges).select(F.col("id").cast("string").alias("name")))


@query()
def embeddings_stub(spark, d):
    return model.embedded(t(spark, d, "part").select(F.col("p_name").alias("name")).distinct(), model.HashEncoder)


@query()
def lexical_weights(spark, d):
    named = model.lexical_weights(t(spark, d, "part").select(F.col("p_name").alias("name")).distinct())
    return named.select("name", F.explode("lex").alias("word", "weight"))


@query()
def model_stub(spark, d):
    return model.completed(prompt_fill(spark, d).withColumnRenamed("item_id", "key"), model.StubClient, model.has_object)


@query()
def concept_pipeline(spark, d):
    from weftgraph.plans.pipeline import run

    return run(spark, t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question")), "benchmark", clustering=Clustering(threshold=0.8)).prompts
