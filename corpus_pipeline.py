"""The corpus pipeline: documents go through five stages, each on all that its predecessor kept.

Toxic documents go; documents whose language can't be told go; of each group of near duplicates the first
document stays (rows without an id come last); sources are mixed to their target weights (a document may come twice); the mixture is
encoded to token ids and decoded again. Each stage is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, common, langid, mixing, simhash, toxicity

#: A document goes if its toxicity reaches this.
TOXIC = 0.3


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labelled documents among docs, held-out fold left out."""
    common.small_batches(spark)
    labels = common.read(spark, sf_dir, "labels")
    score = toxicity.scorer(spark, toxicity.fit(docs, labels, "toxic", common.fold(F.col("doc_id"), 4) != 2))
    return docs.where(score("text") < TOXIC)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are marked, so that equal and null ids need no join: the decision rides along as a row."""
    tagged = docs.select(F.struct(*common.columns(docs)).alias("_row"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    return langid.identify(tagged).where("kept").select("_row.*")


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.unique(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES = [("toxicity", not_toxic), ("language", known_language), ("near_duplicates", near_unique), ("mixing", mixed), ("bpe", encoded)]

#: Fitted models, seeded fingerprints and the library's vocabulary are not SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    base = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
