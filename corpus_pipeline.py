"""Stages over the documents table, each written as Parquet and read again by the next.

Defined results: without documents every stage gives an empty table.  Null and empty texts, and texts
without letters, have no language and go in the first stage.  Repeated rows of one id are judged alike,
so they stay or go together; of equal texts under several ids the smallest id stays, and a row without an
id is no copy of anything.  Equal scores of languages go to the one that sorts first.  Texts of any length
are read whole.  Extra columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.llm import decontaminate, language_id, near_dedup, sentencepiece_nbest, substring_dedup
from latticeflow.llm.common import delete, scratch_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike every learned language, go."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    found = near_dedup.near_duplicates(docs, num=80)
    return docs.join(found.filter(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut from the text."""
    return substring_dedup.cut_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its edit budget, go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document that is left."""
    return sentencepiece_nbest.encode(docs, n_best=2)


STAGES = [
    ("identify_language", identify_language),
    ("drop_near_duplicates", drop_near_duplicates),
    ("cut_repeated_passages", cut_repeated_passages),
    ("drop_contaminated", drop_contaminated),
    ("encode_pieces", encode_pieces),
]

#: Language profiles, edit distances and piece lattices are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents and returns the last one's rows; a stage's table goes when
    the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{scratch_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            delete(spark, f"{base}/{before}")
        before = name
    return docs
