"""Questions as a stream of files: each batch is cleaned and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.functions import text as X


def question_stream(spark: SparkSession, folder: str, dataset: str, schema: str = "id string, question string") -> DataFrame:
    """(doc_id, question) of JSONL files as they come."""
    raw = spark.readStream.schema(schema).json(folder)
    named = raw.select(X.doc_id(dataset, raw, F.lit(0)).alias("doc_id"), X.clean_text(X.first_filled(raw)).alias("question"))
    return named.where("question <> ''")


def append_stream(stream: DataFrame, out: str, progress: str) -> StreamingQuery:
    """Writes what has come to Parquet, a folder for each batch; a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()
