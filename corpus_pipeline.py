"""From raw documents to packed sequences: quality rules, language, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of
documents. run() writes each stage's rows to the shared folder and reads them again, and deletes what a stage has no more use for.

Null texts fail the quality rules; repeated rows with one doc_id and text leave one row, and so do ties of the smallest doc_id;
rows with a null doc_id stay as long as their text does. Empty tables give no rows. Columns beside doc_id, text, lang and
n_chars may have any name and are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import released, stored, table
from weftgraph.llm.jaccard_join import Join, one_of_each
from weftgraph.llm.language_crf import fitted_model, identified_rows, sampled
from weftgraph.llm.packing import packed, pieces
from weftgraph.llm.quality_risk import kept_rows
from weftgraph.llm.secret_scan import redacted

#: Near duplicates share five-word shingles at a similarity of 0.8 or more.
NEAR = Join(words=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or a risk-controlled cutoff reject."""
    return kept_rows(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language that the labelled rows teach; code-switched text of learned languages stays."""
    return identified_rows(docs, fitted_model(sampled(docs, F.lit(True))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates."""
    return one_of_each(docs, NEAR)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; n_chars follows."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences."""
    return packed(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        docs = stored(stage(spark, docs, sf_dir), name)
        if n:
            released(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
