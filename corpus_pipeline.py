"""From raw documents to sharded training data: toxicity, near-duplicates, benchmark passages, mixing, sharding.

Every stage takes what the one before kept, and acts on it: rejected documents are gone, of each group of near-duplicates one
is left, mixed documents stand there as often as they are to be read, and the last stage gives each row its shard.

In all stages null ids, null and empty texts, repeated rows and null sources are rows like any other, each with the result that its operator's docstring
states; columns besides doc_id, text and source, whatever their names, are passed on until the last stage. Empty documents give no rows, empty labels reject nothing, an empty benchmark removes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm.decontaminate import drop_contaminated
from quire.llm.mixing import mix_documents
from quire.llm.near_dedup import drop_near_duplicates
from quire.llm.sharding import shard
from quire.llm.shared import cut, read, remove, shared_folder
from quire.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject. Those without text aren't toxic by what they say and go only if the labels call nearly everything toxic."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and all others; rows without a word are in no group and all stay, also when repeated."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; those without text have none."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources have their target weights; a null source is one of its own, and one without any text has rate 0."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, shard) of every row; equal texts, null ones too, are together."""
    return shard(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Classifier and signatures aren't for SQL; tests/llm holds the pipeline against a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result of the last stage. Between stages, documents are written as Parquet to the shared checkpoint folder and read again; once the result is written there too, they are removed."""
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        remove(spark, folder)
