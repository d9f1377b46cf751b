"""All stages in order: problems to prompts. Stages are functions of frames; what a model was paid for and what was sampled is
stored, so that nothing is asked or drawn twice."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.config import Clustering, Combine, Graph, Ingest, Model, Walk
from weftgraph.functions import text as X
from weftgraph.operators import cluster, combos, cooccur, deps, graph, knowledge, model, prompts, walks
from weftgraph.operators.ranking import indexed
from weftgraph.sources import readers, writers
from weftgraph.storage import stored


def extraction_job(
    spark: SparkSession, glob: str, out: str, client: Callable[[], model.ModelClient] = model.StubClient, asking: Model = Model(pause=0.0),
    suffixes: tuple[str, ...] = (".txt",), include: list[str] | None = None, exclude: tuple[str, ...] = (), most: int | None = None,
) -> DataFrame:
    """(dataset, total, ok, failed, ok_percent) of files of `doc_id##@@Bquestion` lines, by dataset and over all (dataset null).

    Raw replies, parsed points and errors are appended under out, by dataset; what has points from an earlier run isn't asked again.
    most: only the first lines of each file.
    """
    files = readers.datasets(spark, glob, suffixes, include, exclude)
    lines = readers.numbered_lines(spark, glob).join(files.select("file", "dataset"), "file")
    asked = readers.extraction_lines(lines, most=most, keep=("dataset",)).withColumn("key", F.concat_ws("\x1f", "dataset", "doc_id"))
    if readers.there(spark, f"{out}/parsed"):
        asked = model.skip_done(asked, spark.read.schema("dataset string, doc_id string").json(f"{out}/parsed").select(F.concat_ws("\x1f", "dataset", "doc_id").alias("key")), "key")
    work = stored(asked.select("dataset", "doc_id", "key", X.fill(prompts.EXTRACTION, text=F.col("question")).alias("prompt")).dropDuplicates(["key"]), "asked")
    replies = model.completed(work, client, model.has_object, asking).join(work.select("key", "dataset", "doc_id"), "key").drop("key")
    replies = stored(replies, "replies")
    writers.three_way(replies, out, X.points_of(F.col("raw")))
    return knowledge.status_counts(replies)


@dataclass
class Result:
    questions: DataFrame
    replies: DataFrame
    points: DataFrame
    dictionary: DataFrame
    mapping: DataFrame
    pairs: DataFrame
    edges: DataFrame
    walks: DataFrame
    dependencies: DataFrame
    combinations: DataFrame
    prompts: DataFrame
    missing: DataFrame


def run(
    spark: SparkSession,
    problems: DataFrame,
    dataset: str,
    client: Callable[[], model.ModelClient] = model.StubClient,
    encoder: Callable[[], model.Encoder] = model.HashEncoder,
    ingest: Ingest = Ingest(),
    asking: Model = Model(pause=0.0),
    clustering: Clustering = Clustering(),
    building: Graph = Graph(),
    walking: Walk = Walk(),
    combining: Combine = Combine(),
) -> Result:
    named = problems.withColumn("doc_id", X.doc_id(dataset, problems, F.monotonically_increasing_id(), ingest.id_columns))
    questions = named.select("doc_id", X.clean_text(X.first_filled(problems, ingest.question_columns)).alias("question")).where("question <> ''")
    asked = questions.select(F.col("doc_id").alias("key"), X.fill(prompts.EXTRACTION, text=F.col("question")).alias("prompt"))
    replies = stored(model.completed(asked, client, model.has_object, asking), "replies")
    lists = replies.where("status = 'ok'").select(F.col("key").alias("doc_id"), X.points_of(F.col("raw")).alias("m"))
    points = X.last_value(lists, "m", ["doc_id"]).withColumns({"name": X.name_of(F.col("point")), "description": X.description_of(F.col("point"))}).where("name <> ''")
    points = stored(points, "points")
    words = knowledge.dictionary(points, "doc_id", "pos")
    names = stored(cluster.name_index(points, "name"), "names")
    vectors = stored(model.embedded(names, encoder), "vectors")
    similar = cluster.similar_pairs(vectors, clustering.threshold, "idx", "vec", clustering.block)
    mapping = stored(cluster.name_mapping(cluster.clusters(similar), names.withColumnRenamed("idx", "id")), "mapping")
    pairs = stored(cooccur.aggregated(cooccur.initial(points, "doc_id", "name"), mapping), "pairs")
    whole = graph.weighted_edges(pairs.where("u <> v"), building)
    edges = stored(graph.without(whole, graph.supernodes(graph.degrees(whole), building.supernode_factor)), "graph")
    found = stored(walks.random_walks(edges, graph.nodes(edges), walking), "walks")
    good = found.where("reason is null")
    numbered = indexed(good.select("start", "number", "nodes"), "start", "number", out="line_index")
    wanted = numbered.select(F.col("line_index").alias("key"), X.fill(prompts.DEPENDENCY, points=F.to_json("nodes")).alias("prompt"))
    answers = stored(model.completed(wanted, client, model.has_array, asking), "answers")
    records = answers.where("status = 'ok'").select(F.col("key").alias("line_index"), X.dependencies_of(F.col("raw")).alias("dependencies"))
    records = records.join(numbered.select("line_index", F.col("nodes").alias("knowledge_points")), "line_index").where("dependencies is not null")
    arcs = stored(deps.dependency_edges(records, combining), "dependencies")
    made = stored(combos.generated(good.select("nodes"), arcs, deps.node_pool(records), combining), "combinations")
    keyed = indexed(made.withColumn("_l", F.array_join("combo", "##")), "_l", out="key").select((F.col("key") + 1).alias("key"), "combo")
    rows, missing = prompts.prompt_rows(keyed, words)
    return Result(questions, replies, points, words, mapping, pairs, edges, found, arcs, made, rows, missing)
