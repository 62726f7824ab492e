"""From raw documents to shards: the corpus pipeline.

Each stage takes the documents that its predecessor kept and returns documents
with the same columns; the last adds ``shard`` and ``slot``. Between stages the
documents are written as Parquet to shared storage and read again, so a lost
executor costs no more than the stage it is lost in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from settlegrid.llm.common import read_table, shared_dir
from settlegrid.llm.decontam import drop_contaminated
from settlegrid.llm.mixing import mix
from settlegrid.llm.near_dup import drop_near_duplicates
from settlegrid.llm.sharding import shard_documents
from settlegrid.llm.toxicity import drop_toxic, train_on

SHARDS = 40
#: Documents as similar as this, in percent of their five-word shingles, are near duplicates.
NEAR = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model learns from the labelled rows outside the held-out third."""
    return drop_toxic(docs, train_on(docs, read_table(spark, sf_dir, "labels"), modulus=3, remainder=1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id."""
    return drop_near_duplicates(docs, percent=NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it, not at all to three times."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its ``shard`` and ``slot``; each shard holds the sources in proportion."""
    return shard_documents(docs, SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Trained scores and similarity joins have no SQL; tests hold run() against a plain-Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is read from what the last stage wrote."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/corpus/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
